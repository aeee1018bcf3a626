from datetime import date

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import clean, keys
from quarrystone.operators import classify, dedupe, scd2, sinks, temporal


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_fiscal_year(spark):
    for raw, want in (("FY25", 2025), ("2024", 2024), ("2023-2024", 2024), (" fy07 ", 2007), ("24", None), (None, None), ("", None)):
        assert one(spark, raw, clean.fiscal_year("x")) == want


def test_dates_never_raise(spark):
    formats = ("yyyy-MM-dd", "MM/dd/yyyy")
    for raw, want in (("2024-01-15", date(2024, 1, 15)), ("06/23/2025", date(2025, 6, 23)), ("2025-02-30", None), ("x", None),
                      ("", None), (None, None)):
        assert one(spark, raw, clean.date_of("x", formats)) == want
    assert one(spark, "1705276800000", clean.date_of("x", formats, epoch_millis=True)) == date(2024, 1, 15)


def test_currency_status_and_slug(spark):
    assert float(one(spark, "$1,234.50", clean.currency("x"))) == 1234.5
    assert one(spark, "abc", clean.currency("x")) is None
    assert one(spark, " In Transit ", clean.mapped("x", {"in transit": "in_transit"})) == "in_transit"
    assert one(spark, "lost", clean.mapped("x", {"in transit": "in_transit"})) is None
    assert one(spark, "https://e.org/openings/Sicilian-Defense", clean.slug_words("x", r"^https?://[^ ]*/openings/")) == "Sicilian Defense"


def test_tier_edges(spark):
    for value, want in ((199.99, "Low"), (200.0, "Medium"), (499.99, "Medium"), (500.0, "High")):
        assert one(spark, value, clean.spend_tier("x"), "double") == want


def test_identifier_guard():
    assert clean.identifier("a.b_c") == "`a`.`b_c`"
    for bad in ("a;b", "", "a.b.c.d", "1a", "a`b"):
        with pytest.raises(ValueError):
            clean.identifier(bad)


def test_null_takes_a_place_in_keys(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(keys.record_hash("x", "y").alias("h"))
    assert df.distinct().count() == 2


def test_reasons_keep_their_order_and_null_conditions_pass(spark):
    df = spark.createDataFrame([(None, -1), (1, 2)], "a int, b int")
    good, bad = classify.classify(df, [("no_a", F.col("a").isNull()), ("big_a", F.col("a") > 5), ("negative_b", F.col("b") < 0)])
    assert [r["quarantine_reasons"] for r in bad.collect()] == [["no_a", "negative_b"]]
    assert good.count() == 1 and good.columns == ["a", "b"]


def test_known_does_not_fan_out(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    got = {r["k"]: r["ok"] for r in classify.known(facts, "k", dim, "id", "ok").collect()}
    assert got == {1: True, 2: False, None: False}


def test_conflicts_leave_as_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    clean_rows, conflicts = dedupe.split_conflicts(df, ["k"])
    assert [r["k"] for r in clean_rows.collect()] == ["b"] and conflicts.count() == 2


def test_precedence(spark):
    a = spark.createDataFrame([(1, "json")], "k int, s string")
    b = spark.createDataFrame([(1, "csv"), (2, "csv")], "k int, s string")
    assert {r["k"]: r["s"] for r in dedupe.by_precedence([a, b], ["k"]).collect()} == {1: "json", 2: "csv"}


def test_scd2_two_seasons(spark):
    first = spark.createDataFrame([(1, "LAL", 23, "SF")], "player_id int, team string, jersey int, position string")
    second = spark.createDataFrame([(1, "BOS", 23, "SF"), (2, "BOS", 0, "PG")], first.schema)
    tracked = ["team", "jersey", "position"]
    dim = scd2.apply_snapshot(scd2.empty_dimension(first, "player_id", tracked), first, "player_id", tracked, "2023-10-01")
    dim = scd2.apply_snapshot(dim, second, "player_id", tracked, "2024-10-01")
    rows = dim.collect()
    assert len(rows) == 3
    old = [r for r in rows if r["team"] == "LAL"][0]
    assert str(old["effective_end"]) == "2024-10-01" and not old["is_current"]
    assert sorted(r["player_id"] for r in rows if r["is_current"]) == [1, 2]
    again = scd2.apply_snapshot(dim, second, "player_id", tracked, "2024-10-01")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    with pytest.raises(ValueError):
        scd2.apply_snapshot(dim, first, "player_id", tracked, "2023-10-01")


def test_versions_compare_nulls_equal(spark):
    snaps = spark.createDataFrame([(1, "2024-01-01", None), (1, "2024-04-01", None), (1, "2024-07-01", "x")], "k int, d string, v string")
    got = scd2.versions_from_snapshots(snaps, "k", "d", ["v"]).orderBy("effective_start").collect()
    assert [(r["effective_start"], r["effective_end"], r["version_rank"]) for r in got] == [
        ("2024-01-01", "2024-07-01", 1), ("2024-07-01", None, 2)]


def test_point_in_time_falls_back_to_the_first_version(spark):
    versions = spark.createDataFrame([("p", "2024-01-01", "2024-06-01", 1), ("p", "2024-06-01", None, 2)],
                                     "k string, effective_start string, effective_end string, version_rank int")
    facts = spark.createDataFrame([(1, "p", "2023-01-01"), (2, "p", "2024-06-01"), (3, "p", "2024-05-31")], "id int, k string, d string")
    got = temporal.point_in_time(facts, versions, "id", "k", "d")
    assert {r["id"]: r["version_rank"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}", "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t.create_if_absent(df)
    assert t.read().count() == 0
    t.insert_only(df.unionByName(df), ["k"])
    t.insert_only(spark.createDataFrame([(2, "z"), (3, "c")], df.schema), ["k"])
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "a", 2: "b", 3: "c"}
    t.upsert(spark.createDataFrame([(2, "z")], df.schema), ["k"])
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "a", 2: "z", 3: "c"}
    with pytest.raises(ValueError):
        t.upsert(df.unionByName(df), ["k"])
    t.sync(spark.createDataFrame([(9, "n")], df.schema), ["k"])
    assert [r["k"] for r in t.read().collect()] == [9]


def test_two_writers_and_a_failing_second_table(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, again = sinks.VersionedTable(spark, root, "a"), sinks.VersionedTable(spark, root, "a")
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    a.append(one)
    at = again.latest()
    folder = again.stage(one)
    a.append(one.withColumn("k", F.lit(2)))
    with pytest.raises(RuntimeError):  # it would lose what the other one added
        again.promote(folder, at)
    assert sorted(r["k"] for r in a.read().collect()) == [1, 2] and len(a.folders(a.latest())) == 2
    b = sinks.VersionedTable(spark, root, "b")
    b.append(one)
    before = (a.latest(), b.latest())

    def audit(frames):  # someone else publishes the second table meanwhile
        b.append(one)
        return []

    with pytest.raises(RuntimeError):
        sinks.publish([(a, one.limit(1)), (b, one)], audit)
    assert a.latest() == before[0] and sorted(r["k"] for r in a.read().collect()) == [1, 2]
    assert b.latest() == before[1] + 1 and b.read().count() == 2
    a.overwrite(one)
    assert a.vacuum() == 2 and a.read().count() == 1 and a.vacuum() == 0
    sinks.create_database(spark, "quarry_db")
    assert spark.catalog.databaseExists("quarry_db")
    spark.sql("DROP DATABASE quarry_db")


def test_publish_holds_warns_and_cleans_up(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}", "g")
    good = spark.createDataFrame([(1,)], "k int")
    assert sinks.publish([(t, good)], lambda f: [])["status"] == "PUBLISHED"
    assert sinks.publish([(t, good.limit(0))], lambda f: [])["codes"] == ["EMPTY:g"]
    assert sinks.publish([(t, good)], lambda f: ["BAD"])["status"] == "HELD"
    assert sinks.publish([(t, good)], lambda f: ["BAD"], policy="warn") == {"status": "PUBLISHED", "codes": ["BAD"]}
    with pytest.raises(RuntimeError):
        sinks.publish([(t, good)], lambda f: (_ for _ in ()).throw(RuntimeError()))
    assert len(list((tmp_path / "g").glob("v=*"))) == 2


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
