from datetime import datetime

from quarrystone.plans import cases, inventory, shipments, workforce
from quarrystone.serving import catalog

EVENTS = "trans_id string, store_id int, date_time string, change_type_id int, items array<struct<item_id:int,quantity:int>>, bopis_order_id string"
SNAPS = "id int, item_id int, employee_id int, store_id int, date_time string, quantity int"


def refs(spark):
    stores = spark.createDataFrame([(1,), (2,), (3,), (99,)], "store_id int")
    items = spark.createDataFrame([(1001, "Rice", "food", 12), (1002, "Maize", "food", 13)],
                                  "item_id int, item_name string, category string, safety_stock_quantity int")
    kinds = spark.createDataFrame([(1, "sale", "negative"), (2, "restock", "positive"), (3, "shrinkage", "negative"), (4, "bopis", "negative")],
                                  "change_type_id int, change_type string, expected_sign string")
    return stores, items, kinds


def classified(spark, rows):
    return inventory.classify_changes(inventory.explode_changes(spark.createDataFrame(rows, EVENTS)), *refs(spark))


def test_change_reasons(spark):
    t = "2026-07-01 10:00:00"
    rows = [("T1", 1, t, 1, [(1001, -1)], None), ("T1", 1, t, 1, [(1001, -1)], None), ("T2", 1, None, 1, [(1001, -1)], None),
            ("T3", None, t, 1, [(1001, -1)], None), ("T4", 1, t, 1, [(9999, -1)], None), ("T5", 1, t, 2, [(1001, -5)], None),
            ("T6", 99, t, 1, [(1001, -1), (1002, 0)], None)]
    good, bad = classified(spark, rows)
    assert sorted((r["trans_id"], r["item_id"]) for r in good.collect()) == [("T1", 1001), ("T6", 1001), ("T6", 1002)]
    assert {r["trans_id"]: r["quarantine_reasons"] for r in bad.collect()} == {
        "T2": ["missing_date_time"], "T3": ["missing_store_id"], "T4": ["unknown_item_id"], "T5": ["invalid_quantity_sign"]}


def test_snapshot_reasons_and_latest(spark):
    stores, items, _ = refs(spark)
    rows = [(1, 1001, 1, None, "2026-07-01 00:00:00", 1), (2, 9999, 1, 1, "2026-07-01 00:00:00", 1), (3, 1001, 1, 1, "2026-07-01 00:00:00", -3),
            (9, 1001, 1, 1, "2026-06-30 00:00:00", 20), (4, 1001, 1, 1, "2026-07-02 00:00:00", 40), (5, 1001, 1, 1, "2026-07-01 00:00:00", 30)]
    good, bad = inventory.classify_snapshots(spark.createDataFrame(rows, SNAPS), stores, items)
    assert {r["id"]: r["quarantine_reasons"] for r in bad.collect()} == {
        1: ["missing_store_id"], 2: ["unknown_item_id"], 3: ["negative_snapshot_quantity"]}
    assert [(r["id"], r["quantity"]) for r in inventory.latest_snapshots(good).collect()] == [(4, 40)]


def test_online_leg_of_a_paired_order_does_not_count(spark):
    stores, items, _ = refs(spark)
    t = "2026-07-02 10:00:00"
    good, _ = classified(spark, [("P", 1, t, 4, [(1001, -3)], "B1"), ("O", 99, t, 4, [(1001, -3)], "B1"), ("S", 99, t, 1, [(1001, -2)], None),
                                 ("E", 1, "2026-06-01 00:00:00", 1, [(1001, -9)], None)])
    snaps, _ = inventory.classify_snapshots(spark.createDataFrame(
        [(1, 1001, 1, 1, "2026-07-01 00:00:00", 50), (2, 1001, 1, 99, "2026-07-01 00:00:00", 20), (3, 1002, 1, 2, "2026-07-01 00:00:00", 10)], SNAPS), stores, items)
    got = {(r["store_id"], r["item_id"]): r for r in inventory.current_stock(snaps, good, items).collect()}
    assert (got[1, 1001]["change_quantity"], got[1, 1001]["current_quantity"]) == (-3, 47)
    assert (got[99, 1001]["change_quantity"], got[99, 1001]["current_quantity"]) == (-2, 18)
    quiet = got[2, 1002]
    assert quiet["change_quantity"] == 0 and quiet["below_safety_stock"] and quiet["last_movement_at"] == datetime(2026, 7, 1)


def test_shipments_quarantine(spark):
    columns = "SHIPMENT_ID string, WAREHOUSE_ID string, PROGRAMME_ID string, ITEM_CODE string, QUANTITY string, SHIP_DATE string, STATUS string, UNIT_COST string"
    row = ("S1", "WH1", "P1", "I1", "5", "2024-01-15", "Delivered", "$1,000.50")
    rows = [row, row, ("S2", "WH9", "P1", "I1", "5", "06/23/2025", "x", "2"), ("S3", "WH1", "P1", "I1", "", "10-SEP-24", "pending", "2"),
            ("S4", "WH1", None, "I1", "many", "not-a-date", "pending", "2"), ("S5", "WH1", "P1", "I1", "5", "2024-01-15", "pending", "2"),
            ("S5", "WH1", "P1", "I1", "6", "2024-01-15", "pending", "2"), ("S6", "WH1", "P1", "I1", "-1", "10-SEP-24", "pending", "2")]
    one = lambda c, v: spark.createDataFrame([(v,)], f"{c} string")
    good, bad = shipments.classify_shipments(shipments.clean_shipments(spark.createDataFrame(rows, columns)), one("WAREHOUSE_ID", "WH1"),
                                             one("PROGRAMME_ID", "P1"), one("ITEM_CODE", "I1"))
    assert [(r["shipment_id"], float(r["unit_cost"]), r["status"]) for r in good.collect()] == [("S1", 1000.5, "delivered")]
    assert {(r["shipment_id"], "; ".join(r["quarantine_reasons"])) for r in bad.collect()} == {
        ("S2", "missing_warehouse"), ("S3", "missing_quantity"), ("S4", "missing_programme; invalid_quantity; invalid_ship_date"),
        ("S5", "conflicting_duplicate"), ("S6", "non_positive_quantity")}


CIOMS = "\n".join([cases.CIOMS_TITLE, "Case reference", "C1", "Report type", "INITIAL", "Date of report", "2024-01-01", "Seriousness", "Serious",
                   "Reaction(s)", "Rash, Fever", "No.", *cases.CIOMS_PRODUCT_HEADER, "1", "Aspirin", "ASA", "5", "oral", "pain", "2", "Dose", "X",
                   "1", "iv", "flu", "III. CONCOMITANT"])
FOLLOW = "\n".join([cases.FOLLOW_UP_TITLE, "Manufacturer case number", "C1", "Report date", "2024-02-01", "Suspect products", *cases.PRODUCT_HEADER,
                    "Suspect", "Aspirin", "ASA", "1", "Concomitant", "B", "C", "1", "Reported events", *cases.EVENT_HEADER, "Rash", "Skin", "Serious", "Recovered",
                    "Assessment and workflow notes"])


def test_cells_equal_to_headers_survive():
    got = cases.parse_text(CIOMS)
    assert got["products"] == [("Aspirin", "ASA"), ("Dose", "X")]
    assert [r[0] for r in got["reactions"]] == ["Rash", "Fever"]
    back = cases.parse_text(FOLLOW)
    assert back["products"] == [("Aspirin", "ASA")] and back["reactions"] == [("Rash", "Serious", "Recovered")]
    assert cases.parse_text(None)["document_format"] == "unknown"


def test_case_child_rows_parse_once_and_join_nothing(spark):
    plan = catalog.case_child_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_case_assembly(spark):
    rows = [("D1", CIOMS), ("D2", CIOMS), ("D3", FOLLOW), ("D4", FOLLOW.replace("C1", "C2")), ("D5", ""), ("D6", "a letter"),
            ("D7", CIOMS.replace("Case reference\nC1\n", ""))]
    docs = cases.classify_documents(cases.parse_documents(spark.createDataFrame(rows, "document_id string, text string")))
    kinds = {r["document_id"]: (r["classification"], r["extraction_confidence"]) for r in docs.collect()}
    assert kinds == {"D1": ("case_report", 1.0), "D2": ("case_report", 1.0), "D3": ("follow_up", 1.0), "D4": ("follow_up", 1.0),
                     "D5": ("unreadable", 0.0), "D6": ("supporting_document", 0.3), "D7": ("unreadable", 0.4)}
    numbered = cases.case_documents(docs)
    assert {r["document_id"]: r["version_number"] for r in numbered.collect()} == {"D1": 1, "D2": None, "D3": 2}
    links = {(r["document_id"], r["link_type"], r["target_document_id"]) for r in cases.document_links(numbered).collect()}
    assert ("D2", "duplicate_of", "D1") in links and len(links) == 3
    assert {r["document_id"]: r["reason_code"] for r in cases.review_queue(docs).collect()} == {
        "D4": "follow_up_without_initial", "D5": "unreadable_no_text_or_low_confidence", "D6": "non_case_supporting_document",
        "D7": "unreadable_no_text_or_low_confidence"}
    versions = cases.case_versions(numbered)
    assert cases.case_products(versions).count() == 3 and cases.check_versions(versions)[1].count() == 0


def test_signal_order_of_patterns(spark):
    texts = spark.createDataFrame([("s1", "memo", "O1", "U", "R", "Data integration demand is increasing"), ("s2", "memo", "O1", "U", "R", "No evidence of climate demand"),
                                   ("s3", "memo", "O1", "U", "R", None)], "source_id string, document_type string, office_id string, country string, region string, evidence_text string")
    got = {r["source_id"]: (r["skill_id"], r["demand_direction"], r["negated"]) for r in workforce.signals(texts).collect()}
    assert got == {"s1": ("SK001", "increasing", False), "s2": ("SK005", "stable", True)}
