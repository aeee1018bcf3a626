import pytest
from pyspark.sql import types as T

from quarrystone.governance import contract, profile, runner
from quarrystone.serving import dashboard
from quarrystone.sources import api

DOCUMENT = {"layers": {"gold": {"version": 1, "required_fields": {"category": {"type": "string", "nullable": False},
            "record_count": {"type": "bigint", "nullable": False}}, "additive_columns": {"metric_p95": {"type": "double", "nullable": True}}}}}


def schema(*fields):
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k], null) for n, k, null in fields])


GOOD = schema(("category", "string", False), ("record_count", "bigint", False))


@pytest.mark.parametrize("fields,code", [
    ([("category", "string", False)], "MISSING_REQUIRED_FIELD"),
    ([("category", "string", False), ("record_count", "double", False)], "INCOMPATIBLE_DATA_TYPE"),
    ([("category", "string", True), ("record_count", "bigint", False)], "INVALID_NULLABILITY_CHANGE"),
    ([("category", "string", False), ("record_count", "bigint", False), ("surprise", "string", True)], "UNDECLARED_ADDITIVE_COLUMN"),
    ([("category_old", "string", False), ("record_count", "bigint", False)], "UNDECLARED_RENAME"),
])
def test_incompatible_schemas(fields, code):
    c = contract.parse(DOCUMENT, "gold")
    found = contract.compare(c, schema(*fields))
    assert code in [d.code for d in found] and not contract.compatible(found)


def test_compatible_schemas():
    c = contract.parse(DOCUMENT, "gold")
    assert contract.compare(c, GOOD) == []
    wider = contract.compare(c, schema(("category", "string", False), ("record_count", "bigint", False), ("metric_p95", "double", True)), GOOD)
    assert [d.code for d in wider] == ["ALLOWED_ADDITIVE_COLUMN"] and contract.compatible(wider)
    gone = contract.compare(c, GOOD, schema(("category", "string", False), ("record_count", "bigint", False), ("old", "string", True)))
    assert [d.code for d in gone] == ["REMOVED_EXISTING_FIELD"]
    assert contract.report_rows(c, [], "r")[0][4] == "NO_DIFFERENCES"


def test_bad_contracts():
    for bad in ({}, {"layers": {"gold": {"version": 0}}}, {"layers": {"gold": {"version": 1, "required_fields": {"a": {"type": "x"}}}}}):
        with pytest.raises(ValueError):
            contract.parse(bad, "gold")


def test_failure_codes_in_order():
    c = profile.QualityContract(("business_id",), 1, 0, 0, 0.1)
    assert profile.failure_codes(c, ["business_id"], 0, 2, 1, 0.2) == [
        "ROW_COUNT_BELOW_MINIMUM", "DUPLICATE_BUSINESS_KEY", "NULL_BUSINESS_KEY", "REJECTED_RATE_EXCEEDED"]
    assert profile.failure_codes(c, ["x"]) == ["MISSING_BUSINESS_KEY_COLUMN"]
    with pytest.raises(ValueError):
        profile.QualityContract(("a",), sample_size=21)


def test_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "business_id string")
    got = profile.evaluate(df, profile.QualityContract(("business_id",), maximum_rejected_rate=1.0, safe_sample_columns=("business_id",)), rejected=1)
    assert (got["distinct_keys"], got["duplicate_keys"], got["null_keys"], got["rejected_rate"]) == (1, 1, 1, 0.25)
    assert len(got["sample"]) == 3


def test_publication_decision_order():
    assert profile.publication_decision(["x"], 0, False, 1, 1) == ("HELD", "SCHEMA_INCOMPATIBLE")
    assert profile.publication_decision([], 0, False, 1, 1) == ("HELD", "EMPTY_GOLD")
    assert profile.publication_decision([], 5, True, 0, 1) == ("HELD", "DUPLICATE_GRAIN")
    assert profile.publication_decision([], 5, True, 0, 0) == ("PUBLISHED", "ALL_CHECKS_PASSED")


def test_stage_plan():
    assert runner.stage_plan({}) == ["bronze", "silver", "gold"]
    assert runner.stage_plan({"bronze": "SUCCEEDED", "silver": "FAILED", "gold": "SUCCEEDED"}) == ["silver", "gold"]
    assert runner.stage_plan(dict.fromkeys(runner.STAGES, "SUCCEEDED")) == []
    assert runner.stage_plan(dict.fromkeys(runner.STAGES, "SUCCEEDED"), force=True, last="silver") == ["bronze", "silver"]
    with pytest.raises(ValueError):
        runner.stage_plan({}, "gold", "bronze")


def test_runner_resumes_and_records(spark, tmp_path):
    ledger, who = runner.Ledger(spark, f"file://{tmp_path}/ledger"), runner.Identity("f", "c", "s")
    calls = []

    def fails():
        raise KeyError("x")

    with pytest.raises(KeyError):
        runner.run_stages(ledger, "r1", who, {"bronze": lambda: calls.append("b"), "silver": fails, "gold": lambda: calls.append("g")})
    assert ledger.statuses(who) == {"bronze": "SUCCEEDED", "silver": "FAILED"}
    assert runner.run_stages(ledger, "r2", who, {"silver": lambda: None, "gold": lambda: "late"}) == {"silver": "SUCCEEDED", "gold": "HELD"}
    assert calls == ["b"] and ledger.events().where("reason = 'KeyError'").count() == 1


def test_identity_and_substitution(tmp_path):
    (tmp_path / "a.txt").write_text("1")
    one = runner.fingerprint(tmp_path)
    (tmp_path / "a.txt").write_text("2")
    assert runner.fingerprint(tmp_path) != one
    assert runner.config_hash({"a": 1, "b": 2}) == runner.config_hash({"b": 2, "a": 1})
    assert runner.substituted({"x": ["${A:-d}", "${B}"]}, {"B": "v"}) == {"x": ["d", "v"]}


def test_reading_a_source_resumes_where_it_stopped(spark, tmp_path):
    progress = api.ProgressTable(spark, str(tmp_path / "progress"))
    book = {None: api.Answer([1, 2], "b", {"etag": "x"}), "b": api.Answer([3], "c"), "c": api.Answer([4, 5, 6])}
    asked, kept, waits = [], [], []
    broken = {"b": 1, "c": 9}

    def ask(cursor, validators):
        asked.append((cursor, dict(validators)))
        if broken.get(cursor, 0):
            broken[cursor] -= 1
            raise TimeoutError
        return book[cursor]

    def sink(rows):
        kept.extend(rows)
        return len(rows)

    retry = api.Retry(wait=waits.append)
    assert progress.latest("s") is None
    with pytest.raises(TimeoutError):
        api.read_source("s", ask, sink, progress, retry=retry)
    assert kept == [1, 2, 3] and waits == [1, 1, 2] and progress.latest("s")["cursor"] == "c"
    broken.clear()
    assert api.read_source("s", ask, sink, progress, retry=retry) == {"pages": 1, "rows": 3, "unchanged": 0, "complete": True}
    assert kept == [1, 2, 3, 4, 5, 6] and progress.latest("s")["complete"] and progress.latest("other") is None
    assert api.read_source("s", lambda c, v: api.Answer(None), sink, progress) == {"pages": 1, "rows": 0, "unchanged": 1, "complete": True}
    assert api.read_source("t", ask, sink, progress, most_pages=1)["complete"] is False and asked[-1] == (None, {})


def test_a_source_that_leads_back_is_an_error_and_retries_end():
    with pytest.raises(RuntimeError):
        list(api.answers(lambda c: api.Answer([], "again")))
    waits = []

    def never(cursor):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        next(api.answers(never, retry=api.Retry(tries=6, wait=waits.append)))
    assert waits == [1, 2, 4, 8, 8]


def test_recent_answers_expire_and_are_bounded():
    clock, asked = [0.0], []
    recent = api.Recent(seconds=10, most=2, now=lambda: clock[0])

    def get(cursor):
        return recent.through(cursor, lambda: asked.append(cursor) or api.Answer([cursor]))

    get("a"), get("a"), get("b"), get("c"), get("a")
    assert asked == ["a", "b", "c", "a"]
    clock[0] = 11
    get("c")
    assert asked[-1] == "c" and len(asked) == 5


def test_bronze_records(spark):
    from datetime import datetime

    now = datetime(2024, 1, 1)
    responses = [{"kind": "games", "endpoint": "/g", "status": 200, "payload": {"games": [{"url": "u1"}, {"url": "u2"}]}, "etag": "e1"},
                 {"kind": "games", "endpoint": "/g", "status": 304, "payload": {}}]
    df = api.bronze_records(spark, responses, "r", now)
    assert df.count() == 2 and api.latest_etags(df).first()["source_etag"] == "e1"


def test_dashboard():
    class Figure:
        def to_html(self, full_html, include_plotlyjs):
            return f"<i>{include_plotlyjs}</i>"

    page = dashboard.render("T", {"A": [("a", "x", Figure()), ("b", "y", Figure())], "B": [("c", "z", "<p>1</p>")]})
    assert page.count("<i>cdn</i>") == 1 and page.count('class="card"') == 3
    with pytest.raises(ValueError):
        dashboard.render("T", {"A": [("a", "x", "1"), ("a", "y", "2")]})
