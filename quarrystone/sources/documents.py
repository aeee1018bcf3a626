"""Document files: discovery, manifests, text of text, DOCX and XLSX, and path metadata."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "jpg", "jpeg", "png")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def discover(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """Files below ``root`` by extension: path, file_name, checksum, size, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        "path", name.alias("file_name"), F.sha2("content", 256).alias("checksum_sha256"),
        F.col("length").alias("size_bytes"), "content", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
    ).where(F.col("extension").isin(*extensions))


def with_manifest(files: DataFrame, manifest: DataFrame, key: str = "file_name") -> DataFrame:
    """Arrival metadata beside each file; a byte-order mark before the first header is ignored."""
    clean = manifest.toDF(*[c.lstrip("﻿").strip() for c in manifest.columns])
    return files.join(clean.dropDuplicates([key]), key, "left")


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def text_of(content: bytes, extension: str) -> tuple[str, str]:
    """(text, method).  Nothing is ever made up: formats without a reader give no text and say so."""
    try:
        if extension in ("txt", "md", "csv"):
            return content.decode("utf-8-sig", "replace"), "text"
        if extension == "docx":
            return docx_text(content), "docx"
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return "", f"{extension}_unreadable"
    return "", f"{extension}_unavailable"


def extract_text(files: DataFrame) -> DataFrame:
    """``content`` replaced by ``text`` and ``extraction_method``."""
    @F.pandas_udf("text string, extraction_method string")
    def read(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        out = [text_of(bytes(c), e) for c, e in zip(content, extension)]
        return pd.DataFrame(out, columns=["text", "extraction_method"])

    return files.withColumn("_t", read("content", "extension")).select(
        *[c for c in files.columns if c != "content"], "_t.text", "_t.extraction_method")


def header_key(text: str) -> str:
    """A header as a key: lower case, other characters to single underscores."""
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


def _column_index(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(content: bytes):
    """(sheet name, row number from 2, {header key: text}) of every row that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        for k, sheet in enumerate(sheets, 1):
            part = f"xl/worksheets/sheet{k}.xml"
            if part not in names:
                continue
            header: dict[int, str] = {}
            for number, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{_S}row"), 1):
                cells = {}
                for place, cell in enumerate(row.iter(f"{_S}c")):
                    value = cell.find(f"{_S}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    elif value is None or value.text is None:
                        text = ""
                    elif cell.get("t") == "s":
                        text = shared[int(value.text)]
                    else:
                        text = value.text
                    cells[_column_index(cell.get("r")) if cell.get("r") else place] = text
                if number == 1:
                    header = {i: header_key(t) for i, t in cells.items() if t.strip()}
                elif any(t.strip() for t in cells.values()):
                    yield sheet, number, {h: cells.get(i, "") for i, h in header.items()}


def structured_rows(files: DataFrame) -> DataFrame:
    """Rows of all workbooks: source_id, source_file, sheet_name, sheet_key, row_number, row_json."""
    import json

    def read(frames):
        for f in frames:
            out = []
            for ident, name, content in zip(f["source_id"], f["file_name"], f["content"]):
                for sheet, number, row in xlsx_rows(bytes(content)):
                    out.append((ident, name, sheet, header_key(sheet), number, json.dumps(row, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["source_id", "source_file", "sheet_name", "sheet_key", "row_number", "row_json"])

    books = files.where("extension = 'xlsx'").withColumn("source_id", source_id("path"))
    return books.select("source_id", "file_name", "content").mapInPandas(
        read, "source_id string, source_file string, sheet_name string, sheet_key string, row_number long, row_json string")


def source_id(path: Column | str) -> Column:
    return F.concat(F.lit("SRC-"), F.substring(F.sha1(path), 1, 12))


def reporting_period(path: Column | str) -> Column:
    """``2024Q3`` if the path has a quarter, else its years joined by underscores."""
    path = F.col(path) if isinstance(path, str) else path
    quarter = F.regexp_extract(path, r"(20\d{2}Q[1-4])", 1)
    years = F.array_join(F.regexp_extract_all(path, F.lit(r"(20\d{2})"), F.lit(1)), "_")
    return F.when(quarter != "", quarter).otherwise(years)


def document_type(path: Column | str) -> Column:
    """The kind of document that a path's words say."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return (F.when(p.endswith(".xlsx"), "structured_workbook")
            .when(p.contains("country_programme") | p.contains("country-programme"), "country_programme_document")
            .when(p.contains("workplan"), "office_workplan").when(p.contains("survey"), "workforce_planning_survey")
            .otherwise("supporting_document"))
