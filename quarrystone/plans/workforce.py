"""Workforce evidence: skill mentions in texts, supply from staff rows, and the gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.clean import tier
from quarrystone.functions.keys import record_hash
from quarrystone.operators.classify import classify

# Skills with the words that mention them ("ai " ends in a space).
SKILLS = (
    ("SK001", "Data engineering", ("data engineering", "data integration", "pipeline")),
    ("SK002", "Artificial intelligence and machine learning",
     ("artificial intelligence", "machine learning", "ai ", "predictive")),
    ("SK003", "Digital product management", ("product ownership", "product manager")),
    ("SK004", "Monitoring and evaluation", ("monitoring", "evaluation", "results")),
    ("SK005", "Climate resilience", ("climate", "resilience", "adaptation")),
    ("SK006", "Gender analysis", ("gender", "inclusion")),
    ("SK011", "Cybersecurity", ("cybersecurity", "information security", "security")),
    ("SK017", "Programme management", ("programme management", "portfolio delivery")),
    ("SK020", "Crisis response", ("crisis", "surge", "emergency")),
)
# Patterns tried in this order on lower-case text.
NEGATED = "no evidence|do not|not currently|no shortage|adequate"
DECREASING = "declin|less demand"
INCREASING = "increase|rising|expansion|required|shortage|gap|priority|demand"
URGENT = "urgent|critical|shortage|surge|emergency|risk"
SOON = "next two quarters|planned|increasing|required"
STRATEGIC = "Climate|Data|Artificial|Digital|Cybersecurity"

# Fixed value: the note beside each gap, before the number of contributors at high retention risk.
MODEL_NOTE = ("Supply uses proficiency-adjusted active staff, mobility readiness, retention risk and funding-weighted planned positions; "
              "high retention-risk contributors=")


def hashed(df: DataFrame, columns: list[str], run_id: str) -> DataFrame:
    """Bronze rows with their content hash and audit columns."""
    return df.select("*", F.lit(run_id).alias("_run_id"), F.current_timestamp().alias("_ingested_at"),
                     record_hash(*columns).alias("_record_hash"))


def evidence(register: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of documents and survey answers in one layout."""
    columns = ["source_id", "document_type", "office_id", "country", "region", "evidence_text"]
    documents = register.where("document_type <> 'structured_workbook' AND coalesce(evidence_text, '') <> ''").select(*columns)
    j = lambda k: F.get_json_object("row_json", f"$.{k}")
    answers = rows.where("sheet_key = 'survey_responses'").select(
        "source_id", F.lit("workforce_planning_survey").alias("document_type"), j("office_id").alias("office_id"),
        j("country").alias("country"), j("region").alias("region"), j("narrative_response").alias("evidence_text"))
    return documents.unionByName(answers)


def signals(texts: DataFrame) -> DataFrame:
    """A row for each skill that a text mentions.

    The few skills are tried on each row and the hits exploded: no join at all.
    """
    low = F.lower(F.coalesce("evidence_text", F.lit("")))
    skills = F.array(*[F.struct(F.lit(i).alias("skill_id"), F.lit(n).alias("skill_name"),
                                F.array(*map(F.lit, words)).alias("words")) for i, n, words in SKILLS])
    hit = F.filter(skills, lambda s: F.exists(s["words"], lambda w: F.instr(F.col("_low"), w) > 0))
    matched = texts.withColumn("_low", low).withColumn("_skill", F.explode(hit))
    t = F.col("_low")
    return matched.select(
        "source_id", "document_type", "office_id", "country", "region", "_skill.skill_id", "_skill.skill_name",
        F.when(t.rlike(NEGATED), "stable").when(t.rlike(DECREASING), "decreasing")
        .when(t.rlike(INCREASING), "increasing").otherwise("unclear").alias("demand_direction"),
        F.when(t.rlike(URGENT), "high").when(t.rlike(SOON), "medium").otherwise("low").alias("urgency"),
        F.substring("evidence_text", 1, 750).alias("evidence_text"),
        F.when(F.col("document_type") == "workforce_planning_survey", 0.85)
        .when(F.col("document_type").isin("country_programme_document", "office_workplan"), 0.75)
        .otherwise(0.60).alias("confidence"), t.rlike(NEGATED).alias("negated"))


def classify_signals(found: DataFrame):
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return classify(found, [("missing_office", empty("office_id")), ("missing_skill", empty("skill_id")),
                            ("missing_evidence", empty("evidence_text")), ("negated_demand", F.col("negated"))])


def supply(employees: DataFrame, skills: DataFrame, talent: DataFrame, planned: DataFrame) -> DataFrame:
    """Full-time equivalents by office and skill: weighted staff and planned positions.

    Weights are decimals, so sums do not depend on the order of rows.
    """
    d = lambda x: F.lit(x).cast("decimal(3,2)")
    t = talent.select("employee_id", "mobility_readiness", "retention_risk").dropDuplicates(["employee_id"])
    e = employees.select("employee_id", "country", "region", "employment_status").dropDuplicates(["employee_id"])
    staff = skills.where("skill_id IS NOT NULL").join(e, "employee_id", "left").join(t, "employee_id", "left")
    fifth = F.coalesce(F.col("assessed_proficiency").cast("decimal(8,4)"), F.lit(0)) * F.lit("0.2").cast("decimal(1,1)")
    weight = (F.when(F.col("employment_status") == "Active", d("1.00")).otherwise(d("0.35")) * fifth
              * F.when(F.col("retention_risk") == "High", d("0.65")).when(F.col("retention_risk") == "Medium", d("0.85")).otherwise(d("1.00"))
              * F.when(F.col("mobility_readiness") == "Ready now", d("1.05"))
              .when(F.col("mobility_readiness") == "Ready in 6-12 months", d("0.90")).otherwise(d("0.75")))
    now = staff.groupBy("office_id", "country", "region", "skill_id", "skill_name").agg(
        F.count_distinct("employee_id").alias("employees_with_skill"), F.sum(weight).alias("current_supply_fte"),
        F.count_if(F.col("mobility_readiness") == "Ready now").alias("ready_now_count"),
        F.count_if(F.col("retention_risk") == "High").alias("high_retention_risk_count"))
    chance = F.col("funding_probability").cast("decimal(8,6)")
    share = F.when(F.col("position_status") == "Approved", chance * d("1.00")).when(
        F.col("position_status") == "Planned", chance * d("0.55")).otherwise(F.lit(0))
    later = planned.groupBy("office_id", "skill_id").agg(F.sum(share).alias("planned_supply_fte"))
    both = now.join(later, ["office_id", "skill_id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    fte = lambda c: zero(c).cast("decimal(28,12)")
    return both.select(
        "office_id", "country", "region", "skill_id", "skill_name", zero("employees_with_skill").alias("employees_with_skill"),
        fte("current_supply_fte").alias("current_supply_fte"), fte("planned_supply_fte").alias("planned_supply_fte"),
        (fte("current_supply_fte") + fte("planned_supply_fte")).cast("decimal(28,12)").alias("supply_fte"),
        zero("ready_now_count").alias("ready_now_count"),
        zero("high_retention_risk_count").alias("high_retention_risk_count"))


def gap(accepted: DataFrame, supplied: DataFrame) -> DataFrame:
    """Demand against supply by office and skill; supply is summed first, so rows never fan out.

    Scores are compared as decimals and leave as doubles, rounded once.
    """
    sure = F.col("confidence").cast("decimal(8,4)")
    urgency = F.when(F.col("urgency") == "high", 3).when(F.col("urgency") == "medium", 2).otherwise(1)
    demand = accepted.where("NOT negated").groupBy("office_id", "country", "region", "skill_id", "skill_name").agg(
        F.count_distinct("source_id").alias("source_count"), F.max(urgency).alias("urgency_score"),
        F.sum(sure).alias("sure"), F.count("confidence").alias("n_sure"),
        F.sum(F.when(F.col("demand_direction") == "increasing", sure).otherwise(F.lit(0))).alias("raw_demand"),
        F.concat_ws(" ", F.array_sort(F.collect_set(F.substring("evidence_text", 1, 180)))).alias("evidence_summary"))
    s = supplied.groupBy("office_id", "skill_id").agg(
        F.sum("supply_fte").alias("supply_fte"), F.sum("ready_now_count").alias("ready_now_count"),
        F.sum("high_retention_risk_count").alias("high_retention_risk_count"))
    d = demand.join(s, ["office_id", "skill_id"], "left").select(
        "*", F.round(F.col("raw_demand") + F.col("urgency_score") * F.lit("0.5").cast("decimal(2,1)"), 2).alias("score"),
        F.round(F.coalesce("supply_fte", F.lit(0)), 2).alias("supply"))
    d = d.withColumn("g", F.greatest(F.col("score") - F.col("supply"), F.lit(0)))
    risky = F.coalesce("high_retention_risk_count", F.lit(0)).cast("string")
    ready = F.coalesce("ready_now_count", F.lit(0))
    g = F.col("g")
    return d.select(
        "office_id", "country", "region", "skill_id", "skill_name", F.col("score").cast("double").alias("demand_score"),
        F.col("supply").cast("double").alias("supply_fte"), g.cast("double").alias("gap_value"),
        F.round(F.col("sure").cast("double") / F.col("n_sure"), 4).alias("avg_confidence"),
        F.when(g > 0, tier(g, ((3, "Critical"), (1.5, "High")), "Moderate")).otherwise("Covered").alias("gap_severity"),
        F.when(F.col("urgency_score") == 3, "high").when(F.col("urgency_score") == 2, "medium").otherwise("low").alias("urgency"),
        F.when(F.col("skill_name").rlike(STRATEGIC), "high").when(F.col("source_count") >= 2, "medium")
        .otherwise("targeted").alias("strategic_alignment"), "source_count",
        F.when((g >= 3) & (ready == 0), "Recruit").when((g >= 2) & (ready > 0), "Mobilize talent")
        .when((F.col("urgency_score") == 3) & (g >= 1), "Temporary surge support").when(g > 0, "Capability development")
        .otherwise("Monitor").alias("recommended_action"), F.substring("evidence_summary", 1, 900).alias("evidence_summary"),
        F.concat(F.lit(MODEL_NOTE), risky, F.lit(".")).alias("assumption_or_model_note"))
