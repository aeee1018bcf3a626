import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import documents, readers
from quarrystone.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n01, x \n2,\n")
    raw = readers.load(spark, f"file://{tmp_path}/a.csv", "csv")
    assert dict(raw.dtypes) == {"id": "string", "name": "string"} and raw.first()["id"] == "01"
    row = readers.stamped(raw, "r1").first()
    assert row["_source"] == "a.csv" and row["_run_id"] == "r1"
    assert readers.typed_csv(spark, f"file://{tmp_path}/a.csv", {"id": "int"}).first()["id"] == 1
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1, "b": {"c": [1]}}]))
    assert readers.load(spark, f"file://{tmp_path}/b.json", "json").select("b.c").first()["c"] == [1]
    with pytest.raises(ValueError):
        readers.load(spark, "x", "xml")
    seen = {}
    counts = readers.ingest(spark, [readers.Source("a", f"file://{tmp_path}/a.csv")], "r",
                            lambda n, df: seen.update({n: df.collect()}))
    assert counts == {"a": 2}


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets><sheet name='Employee Master'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Employee ID</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_documents(spark, tmp_path):
    book = xlsx("<row><c r='A1' t='s'><v>0</v></c><c r='C1' t='inlineStr'><is><t>Age</t></is></c></row>"
                "<row></row><row><c r='C3'><v>7</v></c><c r='A3' t='s'><v>1</v></c></row>")
    (tmp_path / "staff_2024Q3.xlsx").write_bytes(book)
    (tmp_path / "note.txt").write_text("hello")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    files = documents.discover(spark, f"file://{tmp_path}", ("xlsx", "txt", "pdf"))
    rows = documents.structured_rows(files).collect()
    assert [(r["sheet_key"], r["row_number"], json.loads(r["row_json"])) for r in rows] == [
        ("employee_master", 3, {"employee_id": "Ann", "age": "7"})]
    text = {r["file_name"]: (r["text"], r["extraction_method"]) for r in documents.extract_text(files).collect()}
    assert text["note.txt"] == ("hello", "text") and text["scan.pdf"] == ("", "pdf_unavailable")
    got = files.select(documents.reporting_period("path").alias("p"), documents.document_type("path").alias("t"), "file_name")
    assert {r["file_name"]: r["p"] for r in got.collect()}["staff_2024Q3.xlsx"] == "2024Q3"
    manifest = spark.createDataFrame([("note.txt", "mail")], "`﻿file_name` string, channel string")
    assert {r["file_name"]: r["channel"] for r in documents.with_manifest(files, manifest).collect()}["note.txt"] == "mail"


def test_file_stream_reads_each_file_once(spark, tmp_path):
    inbox, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    inbox.mkdir()
    line = {"trans_id": "T1", "store_id": 1, "date_time": "2026-07-01 10:00:00", "change_type_id": 1, "items": [{"item_id": 1, "quantity": -1}]}
    (inbox / "a.json").write_text(json.dumps(line) + "\n")
    run = lambda: ingest.append_available(ingest.json_stream(spark, f"file://{inbox}"), f"file://{ck}", f"file://{out}")
    run()
    run()
    (inbox / "b.json").write_text(json.dumps(line | {"trans_id": "T2", "channel": "web"}) + "\n")
    run()
    got = spark.read.parquet(f"file://{out}")
    assert sorted((r["trans_id"], r["channel"]) for r in got.collect()) == [("T1", None), ("T2", "web")]


def test_batches_and_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    seen = []
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    ingest.run_available(ingest.expectations(stream, "e", {"positive": F.col("value") > 0}), f"file://{tmp_path}/ck",
                         lambda df, k: seen.append(df.count()))
    assert sum(seen) == events.count()
    batch = ingest.hourly_counts(events).agg(F.sum("n_events")).first()[0]
    assert batch == events.count()
    assert ingest.sessions(events).count() > 0
    assert ingest.distinct_events(events.unionByName(events), ["event_id"]).count() == events.count()
