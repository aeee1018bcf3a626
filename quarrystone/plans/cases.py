"""Case documents: parsing of two text forms, classification, versions, mapping and quality.

Texts are parsed in Arrow batches; everything after that is relational.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import stable_id
from quarrystone.operators.classify import classify, joined_reasons

# Titles and markers of the two forms.
CIOMS_TITLE = "CIOMS FORM - SUSPECT ADVERSE REACTION REPORT"
INITIAL_TITLE = "PHARMACOVIGILANCE CASE REPORT - INITIAL"
FOLLOW_UP_TITLE = "PHARMACOVIGILANCE CASE REPORT - FOLLOW-UP"
CIOMS_PRODUCT_HEADER = ("Reported product", "Active ingredient", "Dose", "Route", "Indication")
PRODUCT_HEADER = ("Product role", "Reported product", "Standard ingredient", "Dose / route")
EVENT_HEADER = ("Reported term", "Category", "Serious", "Outcome")
CIOMS_LABELS = {"case_reference": "Case reference", "report_type": "Report type", "report_date": "Date of report",
                "received_date": "Date received", "patient_age": "Age", "patient_sex": "Sex", "facility": "Facility",
                "district": "District", "seriousness": "Seriousness", "seriousness_criterion": "Criterion",
                "outcome": "Outcome", "reporter_type": "Reporter type"}
REQUIRED = ("case_reference", "report_type", "report_date", "products", "reactions")



class Lines:
    """The lines of a text, without blank ones, and what can be asked of them."""

    def __init__(self, text: str):
        self.all = [x.strip() for x in text.splitlines() if x.strip()]

    def after(self, label: str) -> str | None:
        """The line below the last line that is the label."""
        found = [k for k, x in enumerate(self.all[:-1]) if x == label]
        return self.all[found[-1] + 1] if found else None

    def find(self, start: int, *marks: str, whole: bool = False) -> int:
        """The first place from ``start`` on whose line begins with (or is) a mark; the end if none does."""
        for k in range(start, len(self.all)):
            if self.all[k] in marks if whole else self.all[k].startswith(marks):
                return k
        return len(self.all)

    def rows(self, mark: str, ends: tuple[str, ...], header: tuple[str, ...], width: int) -> list[list[str]]:
        """Whole rows of the table below a mark; its header is known by place, so equal cells stay."""
        begin = self.find(0, mark)
        if begin == len(self.all):
            return []
        block = self.all[begin + 1:self.find(begin + 1, *ends)]
        if tuple(block[:len(header)]) == header:
            del block[:len(header)]
        return [block[k:k + width] for k in range(0, len(block) - width + 1, width)]


def _cioms(lines: Lines) -> dict:
    out = {name: lines.after(label) for name, label in CIOMS_LABELS.items()}
    table = lines.rows("No.", ("III. CONCOMITANT", "IV. MANUFACTURER"), CIOMS_PRODUCT_HEADER, 6)
    out["products"] = [(r[1], r[2]) for r in table if r[0].isdigit()]
    terms = (lines.after("Reaction(s)") or "").split(",")
    out["reactions"] = [(t.strip(), out["seriousness"], out["outcome"]) for t in terms if t.strip()]
    begin = lines.find(0, "Narrative:")
    story = lines.all[begin:lines.find(begin + 1, "II. SUSPECT")]
    out["narrative"] = " ".join([story[0].removeprefix("Narrative:").strip(), *story[1:]]).strip() if story else None
    return out


def _manufacturer(lines: Lines) -> dict:
    products = lines.rows("Suspect products", ("Reported events",), PRODUCT_HEADER, 4)
    events = lines.rows("Reported events", ("Assessment and workflow notes",), EVENT_HEADER, 4)
    begin = lines.find(0, "Case narrative", whole=True) + 1
    out = {"case_reference": lines.after("Manufacturer case number"), "report_date": lines.after("Report date"),
           "received_date": lines.after("Receipt date"), "reporter_type": lines.after("Source"),
           "report_type": "FOLLOW-UP" if lines.all[0] == FOLLOW_UP_TITLE else "INITIAL",
           "narrative": " ".join(lines.all[begin:lines.find(begin, "Suspect products", whole=True)]),
           "products": [(r[1], r[2]) for r in products if r[0] == "Suspect"],
           "reactions": [(r[0], r[2], r[3]) for r in events]}
    if out["reactions"]:
        _, out["seriousness"], out["outcome"] = out["reactions"][0]
    return out


FIELDS = tuple(CIOMS_LABELS)
PARSED = ("document_format string, products array<struct<reported_product:string,active_ingredient:string>>, "
          "reactions array<struct<reaction_term:string,seriousness:string,outcome:string>>, narrative string, "
          + ", ".join(f"{n} string" for n in FIELDS))


def parse_text(text: str | None) -> dict:
    """The fields of one text; a text of no known form has none, and nothing ever raises."""
    lines = Lines(text or "")
    title = lines.all[0] if lines.all else ""
    if title == CIOMS_TITLE:
        form, found = "cioms", _cioms(lines)
    elif title in (INITIAL_TITLE, FOLLOW_UP_TITLE):
        form, found = "manufacturer", _manufacturer(lines)
    else:
        form, found = "unknown", {}
    blank = dict.fromkeys(FIELDS) | {"products": [], "reactions": [], "narrative": None}
    return {"document_format": form} | blank | {k: (v if v != "" else None) for k, v in found.items()}


def parse_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the fields of their form, by one Arrow-batched function over the text alone."""
    @F.pandas_udf(PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        names = ["document_format", "products", "reactions", "narrative", *FIELDS]
        rows = [parse_text(t) for t in texts]
        out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
        for n, keys in (("products", ("reported_product", "active_ingredient")),
                        ("reactions", ("reaction_term", "seriousness", "outcome"))):
            out[n] = out[n].map(lambda v, keys=keys: [dict(zip(keys, x)) for x in v])
        return out

    # as if not deterministic: a filter on a field that moves below the parsing would parse every text once more
    df = docs.withColumn("_p", parse.asNondeterministic()(text)).select(*docs.columns, "_p.*")
    lacks = [F.when(F.size(n) == 0 if n in ("products", "reactions") else F.col(n).isNull(), F.lit(n)) for n in REQUIRED]
    return df.withColumn("missing_fields", F.filter(F.array(*lacks), lambda x: x.isNotNull()))


def classify_documents(parsed: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``classification`` and ``extraction_confidence`` (0 to 1, three decimals)."""
    n = F.size("missing_fields")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"\S")
    follow = F.upper("report_type") == "FOLLOW-UP"
    kind = (F.when(blank, "unreadable").when(F.col("document_format") == "unknown", "supporting_document")
            .when(follow, "follow_up").when(n > 0, "unreadable").otherwise("case_report"))
    sure = (F.when(blank, 0.0).when(F.col("document_format") == "unknown", 0.3).when(follow, 1.0 - 0.15 * n)
            .when(n > 0, F.greatest(F.lit(0.0), 0.5 - 0.1 * n)).otherwise(1.0))
    return parsed.withColumn("classification", kind).withColumn(
        "extraction_confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3))


def review_queue(classified: DataFrame) -> DataFrame:
    """Documents that no case takes, with why."""
    is_case = F.col("classification").isin("case_report", "follow_up")
    reference = F.nullif(F.col("case_reference"), F.lit(""))
    initial = F.max(is_case & (F.upper("report_type") == "INITIAL")).over(Window.partitionBy(reference))
    reason = (F.when(F.col("classification") == "unreadable", "unreadable_no_text_or_low_confidence")
              .when(~is_case, "non_case_supporting_document").when(reference.isNull(), "missing_case_reference")
              .when(~F.col("_initial"), "follow_up_without_initial"))
    return classified.withColumn("_initial", initial).select(
        "document_id", F.when(is_case, reference).alias("case_reference"), reason.alias("reason_code"),
        stable_id("RQ", "document_id", reason).alias("review_id"), F.lit("PENDING").alias("status")).where("reason_code IS NOT NULL")


def case_documents(classified: DataFrame) -> DataFrame:
    """Documents of cases that have an initial report, numbered: the initial, then follow-ups by date.

    ``version_number`` is null for repeated initial reports, which are links.
    Ids come from content, so a rerun makes the same ones.
    """
    docs = classified.where("classification IN ('case_report', 'follow_up') AND coalesce(case_reference, '') <> ''").withColumn(
        "_kind", F.upper("report_type")).where("_kind IN ('INITIAL', 'FOLLOW-UP')")
    by = Window.partitionBy("case_reference")
    numbered = docs.withColumn("_has", F.max(F.col("_kind") == "INITIAL").over(by)).where("_has").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("case_reference", "_kind").orderBy(
            F.when(F.col("_kind") == "INITIAL", F.lit("")).otherwise(F.coalesce("report_date", F.lit(""))), "document_id")))
    number = F.when(F.col("_kind") == "FOLLOW-UP", F.col("_nth") + 1).when(F.col("_nth") == 1, 1)
    first = F.min_by("document_id", F.when(F.col("_kind") == "INITIAL", F.col("_nth"))).over(by)
    return numbered.withColumn("version_number", number).withColumn("canonical_document_id", first).withColumn(
        "case_version_id", F.when(number.isNotNull(), stable_id("CV", "case_reference", "document_id"))).drop("_has", "_nth", "_kind")


def case_versions(cases: DataFrame) -> DataFrame:
    return cases.where("version_number IS NOT NULL")


def document_links(cases: DataFrame) -> DataFrame:
    kind = F.when(F.col("version_number").isNull(), "duplicate_of").otherwise("source_of_version")
    return cases.select(
        stable_id("DL", "document_id", kind).alias("link_id"), "document_id", "case_reference", kind.alias("link_type"),
        F.when(F.col("version_number").isNull(), F.col("canonical_document_id")).alias("target_document_id"))


def case_products(versions: DataFrame) -> DataFrame:
    return versions.select("case_version_id", "case_reference", "document_id", F.explode("products").alias("p")).select(
        "case_version_id", "case_reference", "document_id", "p.*")


def case_reactions(versions: DataFrame) -> DataFrame:
    return versions.select("case_version_id", "case_reference", F.explode("reactions").alias("r")).select(
        "case_version_id", "case_reference", "r.*")


def case_summary(cases: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, "version_number")
    return cases.groupBy("case_reference").agg(
        F.min_by("report_date", "version_number").alias("first_report_date"), last("report_date").alias("latest_report_date"),
        last("case_version_id").alias("latest_case_version_id"), F.count("version_number").alias("version_count"),
        F.count_if(F.col("version_number").isNull()).alias("duplicate_document_count"),
        last("seriousness").alias("current_seriousness"), last("outcome").alias("current_outcome"))


def _key(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def mapped_to(df: DataFrame, column: str, reference: DataFrame, name: str, ident: str, target: str) -> DataFrame:
    """``target``: the reference id whose name is the column's text, case and outer spaces aside."""
    r = reference.select(_key(name).alias("_name"), F.col(ident).alias(target)).where("_name <> ''").dropDuplicates(["_name"])
    return df.join(r, _key(column) == r["_name"], "left").drop("_name")


def map_products(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Standard names first, then brands."""
    df = mapped_to(products, "reported_product", dictionary, "standard_product_name", "product_id", "_by_name")
    df = mapped_to(df, "reported_product", dictionary, "example_brand", "product_id", "_by_brand")
    return df.withColumn("standard_product_id", F.coalesce("_by_name", "_by_brand")).drop("_by_name", "_by_brand")


def mapping_exceptions(products: DataFrame, reactions: DataFrame, versions: DataFrame) -> DataFrame:
    """Typed rows for what no reference has; versions carry ``facility_id`` and ``district_id``."""
    def rows(df, kind, ident, raw, given=False):
        test = F.col(ident).isNull()
        if given:
            test &= F.coalesce(raw, F.lit("")) != ""
        return df.where(test).select("case_reference", F.lit(kind).alias("exception_type"), F.col(raw).alias("raw_value"))

    return (rows(products, "unmapped_product", "standard_product_id", "reported_product")
            .unionByName(rows(reactions, "unmapped_reaction", "standard_reaction_id", "reaction_term"))
            .unionByName(rows(versions, "unmapped_facility", "facility_id", "facility", True))
            .unionByName(rows(versions, "unmapped_district", "district_id", "district", True)))


def check_versions(versions: DataFrame):
    """``(accepted, quarantined)`` by mandatory fields; quarantined versions do not reach the gold tables."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    accepted, rejected = classify(versions, [
        *[(f"missing_{c}", empty(c)) for c in ("case_reference", "report_type", "report_date")],
        ("no_suspect_product", F.size("products") == 0), ("no_reaction_term", F.size("reactions") == 0)])
    return accepted, rejected.select("case_version_id", "case_reference", joined_reasons(",").alias("reason_code"))


def case_overview(current: DataFrame, historical: DataFrame) -> DataFrame:
    """Cases by district, seriousness and status over new cases and ready historical events."""
    new = current.select("case_reference", "district", F.col("current_seriousness").alias("seriousness"), F.when(
        F.col("version_count") > 1, "FOLLOW-UP").otherwise("INITIAL").alias("report_status"),
        (F.col("duplicate_document_count") > 0).cast("int").alias("is_duplicate"))
    old = historical.where(READY).select(
        F.col("case_id").alias("case_reference"), "district", "seriousness",
        F.when(F.col("follow_up_flag") == "True", "FOLLOW-UP").otherwise("INITIAL").alias("report_status"),
        (F.col("duplicate_flag") == "True").cast("int").alias("is_duplicate"))
    return new.unionByName(old).groupBy("district", "seriousness", "report_status").agg(
        F.count_distinct("case_reference").alias("case_count"), F.sum("is_duplicate").cast("bigint").alias("duplicate_count"))


READY = "processing_status = 'READY_FOR_DASHBOARD'"


def product_reactions(historical: DataFrame) -> DataFrame:
    """Cases and serious events by product, ingredient, class, reaction and its category."""
    return historical.where(READY).groupBy(
        "standard_product_name", "active_ingredient", "product_class", "reaction_term", "reaction_category").agg(
        F.count_distinct("case_id").alias("distinct_case_count"),
        F.count_if(F.col("seriousness") == "Serious").alias("serious_event_count"))


def facility_reporting(historical: DataFrame) -> DataFrame:
    """Cases and mean timeliness, completeness and confidence by place and reporter; text that is no number counts as none."""
    mean = lambda c: F.avg(F.col(c).try_cast("double")).alias(f"avg_{c}")
    return historical.where(READY).groupBy(
        "district", "region", "facility_name", "facility_type", "report_source", "reporter_type").agg(
        F.count_distinct("case_id").alias("distinct_case_count"), mean("days_to_report"), mean("completeness_score"),
        mean("extraction_confidence"))


def pipeline_health(classified: DataFrame, versions: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents by classification beside the totals; the totals are one row, joined on."""
    totals = versions.agg(F.count(F.lit(1)).alias("version_count")).crossJoin(
        queue.agg(F.count(F.lit(1)).alias("review_count")))
    return classified.groupBy("classification").agg(
        F.count(F.lit(1)).alias("document_count"), F.round(F.avg("extraction_confidence"), 3).alias("avg_confidence")
    ).crossJoin(F.broadcast(totals))
