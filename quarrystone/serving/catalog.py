"""The query catalogue: every plan as a named query over the fixture tables, with its SQL.

The fixture tables play the parts of the layered pipelines: order lines are
sales, suppliers franchises, customers customers, part types products, and
events stock movements and games.  The SQL text of a query is an independent
statement of the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import clean, keys
from quarrystone.governance import checks, profile
from quarrystone.operators import classify, dedupe, scd2, temporal
from quarrystone.plans import cases, funding, games, inventory, league, retail, shipments, workforce
from quarrystone.sources.readers import stamped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query and its SQL.  ``dates`` (and times) leave as text, the same on both sides."""
    def register(fn):
        if dates:
            @wraps(fn)
            def run(spark, sf):
                df = fn(spark, sf)
                return df.withColumns({c: F.col(c).cast("string") for c in dates})
        else:
            run = fn
        QUERIES[fn.__name__] = run
        if sql is not None:
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            SQL[fn.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return run
    return register


# --- sales -----------------------------------------------------------------

SALES = """
WITH sales AS (
  SELECT l.l_orderkey AS transactionID, o.o_custkey AS customerID, l.l_suppkey AS franchiseID, o.o_orderdate AS dateTime,
         CAST(p.p_type AS VARCHAR) AS product, CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))) AS totalPrice,
         l.l_returnflag AS paymentMethod, s.s_name AS franchise_name, sn.n_name AS city, sr.r_name AS district,
         sn.n_name AS country, concat('size_', CAST(s.s_nationkey % 3 AS VARCHAR)) AS store_size,
         s.s_nationkey * 7.25 AS longitude, s.s_suppkey % 90 + 0.5 AS latitude,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) / CAST(l.l_quantity AS BIGINT) AS DECIMAL(18,6)) AS unitPrice, c.c_name AS customer_name,
         c.c_mktsegment AS gender, cn.n_name AS customer_country, cr.r_name AS customer_continent,
         CAST(o.o_orderdate AS DATE) AS transaction_date, strftime(o.o_orderdate, '%Y-%m') AS transaction_month
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  WHERE l.l_orderkey IS NOT NULL AND l.l_extendedprice * (1 - l.l_discount) > 0 AND l.l_quantity > 0)
"""
M = "CAST(CAST(round(sum(totalPrice), 2) AS DECIMAL(18,2)) AS DOUBLE)"
AVG = "CAST(CAST(round(CAST(avg(totalPrice) AS DECIMAL(20,6)), 2) AS DECIMAL(18,2)) AS DOUBLE)"


def _transactions(spark, sf) -> DataFrame:
    li, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"], "left").select(
        F.col("l_orderkey").alias("transactionID"), F.col("o_custkey").alias("customerID"),
        F.col("l_suppkey").alias("franchiseID"), F.col("o_orderdate").alias("dateTime"),
        F.col("p_type").cast("string").alias("product"), F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("bigint")).cast("decimal(18,6)").alias("unitPrice"), price.alias("totalPrice"),
        F.col("l_returnflag").alias("paymentMethod"))


def _places(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def _franchises(spark, sf) -> DataFrame:
    s, n = table(spark, sf, "supplier"), _places(spark, sf)
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        F.col("s_suppkey").alias("franchiseID"), F.col("s_name").alias("franchise_name"), F.col("n_name").alias("city"),
        F.col("r_name").alias("district"), F.col("n_name").alias("country"),
        F.concat(F.lit("size_"), (F.col("s_nationkey") % 3).cast("string")).alias("size"),
        F.col("s_nationkey").alias("supplierID"), (F.col("s_nationkey") * 7.25).cast("double").alias("longitude"),
        (F.col("s_suppkey") % 90 + 0.5).cast("double").alias("latitude"))


def _customers(spark, sf) -> DataFrame:
    c, n = table(spark, sf, "customer"), _places(spark, sf)
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        F.col("c_custkey").alias("customerID"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("gender"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


def _sales(spark, sf) -> DataFrame:
    return retail.enriched(_transactions(spark, sf), _franchises(spark, sf), _customers(spark, sf))


@query("SELECT r_regionkey, r_name, 'region' AS _source, 'run-1' AS _run_id FROM region")
def bronze_stamp_sources(spark, sf):
    return stamped(table(spark, sf, "region"), "run-1", "region").select("r_regionkey", "r_name", "_source", "_run_id")


@query(SALES + """SELECT transactionID, customerID, franchiseID, product, quantity, CAST(totalPrice AS DOUBLE) AS total_price,
  paymentMethod, franchise_name, city, district, country, store_size, CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude,
  customer_name, gender, customer_country, customer_continent, transaction_date, transaction_month, CAST(hour(dateTime) AS BIGINT) AS transaction_hour FROM sales""", dates=("transaction_date",))
def silver_sales_enriched(spark, sf):
    return _sales(spark, sf).select(
        "transactionID", "customerID", "franchiseID", "product", "quantity", F.col("totalPrice").cast("double").alias("total_price"),
        "paymentMethod", "franchise_name", "city", "district", "country", "store_size", "longitude", "latitude", "customer_name", "gender",
        "customer_country", "customer_continent", "transaction_date", "transaction_month",
        F.col("transaction_hour").cast("bigint").alias("transaction_hour"))


@query("""SELECT s.s_suppkey AS franchiseID, s.s_name AS franchise_name, n.n_name AS country, s.s_nationkey AS supplierID,
  r.r_name AS supplier_name, CAST(r.r_regionkey AS VARCHAR) AS ingredient, r.r_regionkey > 1 AS approved
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON s.s_nationkey = r.r_regionkey""")
def supplier_details(spark, sf):
    r = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("supplierID"), F.col("r_name").alias("name"),
        F.col("r_regionkey").cast("string").alias("ingredient"), (F.col("r_regionkey") > 1).alias("approved"))
    return retail.supplier_details(_franchises(spark, sf), r)


@query("""SELECT count(*) FILTER (l_orderkey IS NULL) AS valid_id, count(*) FILTER (NOT (l_extendedprice > 1000)) AS valid_total,
  count(*) FILTER (NOT (l_quantity > 10)) AS valid_quantity, count(*) FILTER (NOT (l_discount > 0)) AS valid_unit_price FROM lineitem""")
def expectation_counts(spark, sf):
    return retail.expectation_counts(table(spark, sf, "lineitem"), {
        "valid_id": "l_orderkey IS NOT NULL", "valid_total": "l_extendedprice > 1000", "valid_quantity": "l_quantity > 10",
        "valid_unit_price": "l_discount > 0"})


def _avg(c: str, places: int = 2) -> str:
    return f"CAST(CAST(round(CAST(avg({c}) AS DECIMAL(20,6)), {places}) AS DECIMAL(18,2)) AS DOUBLE)"


def _sum(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


DAILY = SALES + f""", daily AS (SELECT {", ".join(retail.DAILY)}, {M} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
  count(transactionID) AS transaction_count, {AVG} AS avg_transaction_value FROM sales GROUP BY ALL)
"""
RANKING = SALES + f""", ranking AS (SELECT * REPLACE (CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude) FROM (
  SELECT {", ".join(retail.STORE)}, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
  count(transactionID) AS transaction_count, {AVG} AS avg_basket_size, count(DISTINCT customerID) AS unique_customers,
  CAST(rank() OVER (ORDER BY sum(totalPrice) DESC) AS BIGINT) AS revenue_rank, {M} AS total_revenue FROM sales GROUP BY {", ".join(retail.STORE)}))
"""
SEGMENTS = SALES + f""", spend AS (SELECT customerID, product, sum(totalPrice) AS spent FROM sales GROUP BY ALL),
fav AS (SELECT customerID, product AS favourite_product FROM (SELECT *, row_number() OVER (
  PARTITION BY customerID ORDER BY spent DESC, product) AS n FROM spend) WHERE n = 1),
seg AS (SELECT {", ".join(retail.CUSTOMER)}, {M} AS total_spend, count(transactionID) AS visit_count, {AVG} AS avg_spend_per_visit,
  count(DISTINCT franchiseID) AS stores_visited, count(DISTINCT transaction_date) AS active_days, any_value(favourite_product) AS favourite_product,
  CASE WHEN sum(totalPrice) >= 500 THEN 'High' WHEN sum(totalPrice) >= 200 THEN 'Medium' ELSE 'Low' END AS spend_tier
  FROM sales LEFT JOIN fav USING (customerID) GROUP BY {", ".join(retail.CUSTOMER)})
"""
PRODUCTS = SALES + f""", products AS (SELECT product, {M} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_units_sold, count(transactionID) AS transaction_count,
  {_avg("unitPrice")} AS avg_unit_price, {AVG} AS avg_transaction_value, count(DISTINCT customerID) AS unique_customers,
  round(CAST(sum(totalPrice) AS DOUBLE) / CAST((SELECT sum(totalPrice) FROM sales) AS DOUBLE), 4) AS revenue_share FROM sales GROUP BY product)
"""


@query(DAILY + "SELECT * FROM daily", dates=("transaction_date",))
def daily_revenue(spark, sf):
    return retail.daily_revenue(_sales(spark, sf))


@query(PRODUCTS + "SELECT * FROM products")
def product_revenue_share(spark, sf):
    return retail.product_performance(_sales(spark, sf))


@query(PRODUCTS + """SELECT product, total_revenue, total_units_sold, avg_unit_price, avg_transaction_value, unique_customers,
  round(revenue_share * 100, 2) AS revenue_share_pct FROM products""")
def product_dashboard(spark, sf):
    return retail.product_performance(_sales(spark, sf)).select(
        "product", "total_revenue", "total_units_sold", "avg_unit_price", "avg_transaction_value", "unique_customers",
        F.round(F.col("revenue_share") * 100, 2).alias("revenue_share_pct"))


@query(RANKING + "SELECT * FROM ranking")
def franchise_ranking(spark, sf):
    return retail.franchise_ranking(_sales(spark, sf))


TOP = ("revenue_rank", "franchise_name", "city", "country", "store_size", "total_revenue", "transaction_count", "unique_customers",
       "avg_basket_size")


@query(RANKING + f"SELECT {', '.join(TOP)} FROM ranking ORDER BY revenue_rank, franchise_name LIMIT 10")
def top10_franchises(spark, sf):
    return retail.franchise_ranking(_sales(spark, sf)).select(*TOP).orderBy("revenue_rank", "franchise_name").limit(10)


@query(RANKING + f"SELECT {', '.join(TOP)}, longitude, latitude FROM ranking ORDER BY revenue_rank, franchise_name LIMIT 20")
def top20_franchises_on_map(spark, sf):
    return retail.franchise_ranking(_sales(spark, sf)).select(*TOP, "longitude", "latitude").orderBy(
        "revenue_rank", "franchise_name").limit(20)


@query(SEGMENTS + "SELECT * FROM seg")
def customer_segments(spark, sf):
    return retail.customer_segments(_sales(spark, sf))


@query(SEGMENTS + f"""SELECT spend_tier, count(customerID) AS customer_count, {_avg("CAST(total_spend AS DECIMAL(18,2))")} AS avg_spend,
  {_avg("visit_count", 1)} AS avg_visits, {_avg("active_days", 1)} AS avg_active_days, {_avg("stores_visited", 1)} AS avg_stores_visited
  FROM seg GROUP BY spend_tier""")
def tier_summary(spark, sf):
    return retail.tier_summary(retail.customer_segments(_sales(spark, sf)))


@query(SEGMENTS + f"""SELECT gender, favourite_product, count(*) AS customer_count, {_avg("CAST(total_spend AS DECIMAL(18,2))")} AS avg_spend
  FROM seg GROUP BY ALL""")
def favourite_by_segment(spark, sf):
    return retail.favourites(retail.customer_segments(_sales(spark, sf)))


@query(SEGMENTS + """SELECT customerID, customer_name, customer_country, total_spend, visit_count, spend_tier FROM seg
  ORDER BY total_spend DESC, customerID LIMIT 20""")
def top20_customers(spark, sf):
    return retail.top_n(retail.customer_segments(_sales(spark, sf)).select(
        "customerID", "customer_name", "customer_country", "total_spend", "visit_count", "spend_tier"), 20, "total_spend", "customerID")


@query(SALES + f"""SELECT count(DISTINCT transactionID) AS total_transactions, count(DISTINCT customerID) AS unique_customers,
  count(DISTINCT franchiseID) AS active_franchises, {M} AS total_revenue, {AVG} AS avg_basket_size,
  round(CAST(sum(totalPrice) AS DOUBLE) / count(DISTINCT transaction_date), 2) AS avg_daily_revenue FROM sales""")
def sales_kpis(spark, sf):
    return retail.kpis(_sales(spark, sf))


def _daily_by(key: str) -> str:
    return DAILY + f"""SELECT {key}, {_sum("total_revenue")} AS daily_revenue, CAST(sum(total_units_sold) AS BIGINT) AS daily_units,
      CAST(sum(transaction_count) AS BIGINT) AS daily_transactions FROM daily GROUP BY {key}"""


@query(_daily_by("transaction_date"), dates=("transaction_date",))
def revenue_by_day(spark, sf):
    return retail.revenue_by(retail.daily_revenue(_sales(spark, sf)), "transaction_date")


@query(_daily_by("transaction_month"))
def revenue_by_month(spark, sf):
    return retail.revenue_by(retail.daily_revenue(_sales(spark, sf)), "transaction_month")


def _stores_by(key: str, count: str) -> str:
    return RANKING + f"""SELECT {key}, count(DISTINCT franchiseID) AS {count}, {_sum("total_revenue")} AS total_revenue,
      CAST(sum(transaction_count) AS BIGINT) AS total_transactions, {_avg("CAST(avg_basket_size AS DECIMAL(18,2))")} AS avg_basket_size
      FROM ranking GROUP BY {key}"""


@query(_stores_by("country", "franchise_count"))
def revenue_by_country(spark, sf):
    return retail.stores_by(retail.franchise_ranking(_sales(spark, sf)), "country", "franchise_count")


@query(_stores_by("store_size", "store_count"))
def revenue_by_size(spark, sf):
    return retail.stores_by(retail.franchise_ranking(_sales(spark, sf)), "store_size", "store_count")


@query(SALES + f"""SELECT paymentMethod, count(transactionID) AS transaction_count, {M} AS total_revenue, {AVG} AS avg_basket_size,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct_of_transactions FROM sales GROUP BY paymentMethod""")
def payment_mix(spark, sf):
    return retail.payment_mix(_sales(spark, sf))


@query(SALES + f"""SELECT CAST(hour(dateTime) AS BIGINT) AS transaction_hour, count(transactionID) AS transaction_count, {M} AS total_revenue,
  {AVG} AS avg_basket_size FROM sales GROUP BY 1""")
def hourly_sales(spark, sf):
    return retail.hourly(_sales(spark, sf)).withColumn("transaction_hour", F.col("transaction_hour").cast("bigint"))


@query("""SELECT CAST(hour(ts) AS BIGINT) AS activity_hour, count(*) AS n_events, count(DISTINCT user_id) AS n_users
  FROM events GROUP BY 1""")
def hourly_activity(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").cast("bigint").alias("activity_hour")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"))


@query(SALES + f"""SELECT product, {M} AS total_revenue FROM sales WHERE lower(country) = 'nation_3' OR lower(customer_continent) = 'asia'
  GROUP BY product""")
def filtered_products(spark, sf):
    sales = _sales(spark, sf)
    return sales.where(clean.same_text("country", "NATION_3") | clean.same_text("customer_continent", "Asia")).where(
        clean.same_text("product", "All")).groupBy("product").agg(retail.money(F.sum("totalPrice")).alias("total_revenue"))


# --- duplicates and quarantine ----------------------------------------------

@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_per_user(spark, sf):
    return dedupe.latest(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select(
        "user_id", "event_id", "event_type", "value")


LINE_ORDER = "l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS n FROM lineitem) WHERE n = 1""")
def latest_line_version(spark, sf):
    order = [F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return dedupe.latest(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def exact_duplicates_removed(spark, sf):
    return dedupe.exact(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) WHERE n > 1""")
def conflicting_duplicates(spark, sf):
    rows = dedupe.exact(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return dedupe.split_conflicts(rows, ["l_orderkey", "l_linenumber"])[1]


@query("""SELECT o_orderkey, o_custkey, 'odd' AS source FROM orders WHERE o_custkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 'all' FROM orders WHERE o_custkey % 3 <> 0""")
def cross_batch_precedence(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return dedupe.by_precedence([o.where("o_custkey % 3 = 0").withColumn("source", F.lit("odd")),
                                 o.withColumn("source", F.lit("all"))], ["o_orderkey"])


@query("""SELECT checksum, min(c_custkey) AS canonical_id, count(*) - 1 AS n_duplicates FROM (
  SELECT sha256(concat(c_mktsegment, '|', CAST(c_nationkey AS VARCHAR))) AS checksum, c_custkey FROM customer) GROUP BY checksum""")
def checksum_canonical(spark, sf):
    c = table(spark, sf, "customer").withColumn("checksum", keys.record_hash("c_mktsegment", "c_nationkey", separator="|"))
    keep, copies = dedupe.canonical(c, "checksum", ["c_custkey"])
    n = copies.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"))
    return keep.join(n, "checksum", "left").select(
        "checksum", F.col("c_custkey").alias("canonical_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_duplicates"))


@query("""SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name,
  sha256(concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '"}')) AS f FROM customer) ORDER BY f LIMIT 7""")
def deterministic_sample(spark, sf):
    return dedupe.deterministic_sample(table(spark, sf, "customer"), 7, ["c_custkey", "c_name"])


LINES = """WITH marked AS (
  SELECT l_orderkey, l_linenumber, list_filter([
    CASE WHEN s.s_suppkey IS NULL THEN 'unknown_supplier' END, CASE WHEN p.p_partkey IS NULL THEN 'unknown_part' END,
    CASE WHEN l_quantity < 5 THEN 'small_quantity' END, CASE WHEN l_discount > 0.08 THEN 'deep_discount' END], lambda x: x IS NOT NULL) AS reasons
  FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0) s ON l_suppkey = s.s_suppkey
  LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) p ON l_partkey = p.p_partkey)
"""


def _line_classes(spark, sf):
    li = table(spark, sf, "lineitem")
    df = classify.known(li, "l_suppkey", table(spark, sf, "supplier").where("s_suppkey % 10 <> 0"), "s_suppkey", "_s")
    df = classify.known(df, "l_partkey", table(spark, sf, "part").where("p_partkey % 7 <> 0"), "p_partkey", "_p")
    return classify.classify(df, [("unknown_supplier", ~F.col("_s")), ("unknown_part", ~F.col("_p")),
                                  ("small_quantity", F.col("l_quantity") < 5), ("deep_discount", F.col("l_discount") > 0.08)])


@query(LINES + "SELECT l_orderkey, l_linenumber, array_to_string(reasons, '; ') AS reasons FROM marked WHERE len(reasons) > 0")
def order_quarantine(spark, sf):
    return _line_classes(spark, sf)[1].select("l_orderkey", "l_linenumber", classify.joined_reasons().alias("reasons"))


@query(LINES + "SELECT l_orderkey, l_linenumber FROM marked WHERE len(reasons) = 0")
def order_accepted(spark, sf):
    return _line_classes(spark, sf)[0].select("l_orderkey", "l_linenumber")


@query(LINES + "SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM marked) GROUP BY reason")
def quarantine_reason_counts(spark, sf):
    return classify.reason_counts(_line_classes(spark, sf)[1])


@query(LINES + """, moves AS (SELECT list_filter([CASE WHEN user_id % 20 = 7 THEN 'unknown_store_id' END,
    CASE WHEN event_id % 50 >= 45 THEN 'unknown_item_id' END], lambda x: x IS NOT NULL) AS reasons FROM events)
SELECT quality_rule, count(*) AS n_rows FROM (SELECT unnest(reasons) AS quality_rule FROM marked UNION ALL SELECT unnest(reasons) FROM moves)
  GROUP BY quality_rule ORDER BY n_rows DESC, quality_rule LIMIT 10""")
def failed_rules_top(spark, sf):
    return inventory.failed_rules([_line_classes(spark, sf)[1], _changes(spark, sf)[1]])


@query(LINES + """SELECT (SELECT count(*) FROM lineitem) AS source_rows, count(*) FILTER (len(reasons) = 0) AS accepted_rows,
  count(*) FILTER (len(reasons) > 0) AS quarantined_rows, true AS balanced FROM marked""")
def reconciliation(spark, sf):
    accepted, rejected = _line_classes(spark, sf)
    return classify.reconcile(source=table(spark, sf, "lineitem"), accepted=accepted, quarantined=rejected)


@query(LINES + """SELECT count(*) FILTER (len(reasons) > 0) AS quarantined, count(*) AS total,
  round(count(*) FILTER (len(reasons) > 0) / count(*), 4) AS quarantine_rate FROM marked""")
def quarantine_rate(spark, sf):
    accepted, rejected = _line_classes(spark, sf)
    both = accepted.select(F.lit(0).alias("q")).unionByName(rejected.select(F.lit(1).alias("q")))
    return both.agg(F.sum("q").cast("bigint").alias("quarantined"), F.count(F.lit(1)).alias("total"),
                    F.round(F.sum("q") / F.count(F.lit(1)), 4).alias("quarantine_rate"))


# --- cleaning -----------------------------------------------------------------

@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'in_transit' WHEN 1 THEN 'delivered' WHEN 2 THEN 'pending' END AS status FROM orders""")
def status_normalised(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " In Transit").when(k == 1, "DELIVERED ").when(k == 2, "pending").otherwise("lost")
    return table(spark, sf, "orders").select("o_orderkey", clean.mapped(raw, shipments.STATUSES).alias("status"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(2000 + year(o_orderdate) % 100 AS INTEGER)
  ELSE CAST(year(o_orderdate) AS INTEGER) END AS fiscal_year FROM orders""")
def fiscal_year_normalised(spark, sf):
    o = table(spark, sf, "orders")
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    raw = (F.when(k == 0, y.cast("string")).when(k == 1, F.concat_ws("-", (y - 1).cast("string"), y.cast("string")))
           .when(k == 2, F.concat(F.lit("FY"), F.lpad((y % 100).cast("string"), 2, "0"))).otherwise("unknown"))
    return o.select("o_orderkey", clean.fiscal_year(raw).alias("fiscal_year"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate))
  ELSE CAST(o_orderdate AS DATE) END AS order_day FROM orders""", dates=("order_day",))
def multi_format_dates(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
           .when(k == 4, F.date_format("o_orderdate", "dd-MMM-yy")).when(k == 2, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise("2025-02-30"))
    return table(spark, sf, "orders").select("o_orderkey", clean.date_of(raw, funding.DATE_FORMATS, epoch_millis=True).alias("order_day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS amount FROM orders")
def currency_clean(spark, sf):
    text = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", clean.currency(raw, "decimal(12,2)").cast("double").alias("amount"))


@query("""SELECT c_custkey, upper(c_name) AS name, upper(c_mktsegment) AS segment, CAST(NULL AS VARCHAR) AS channel, c_acctbal AS balance FROM customer""")
def cross_schema_layout(spark, sf):
    c = table(spark, sf, "customer").withColumn("C_NAME", F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")))
    wide = clean.renamed(c, {"c_custkey": ("C_CUSTKEY", "bigint"), "name": ("c_name", "string"), "segment": ("c_mktsegment", "string"),
                             "channel": ("channel", "string"), "balance": ("c_acctbal", "double")})
    return clean.trimmed(wide).withColumn("segment", F.upper("segment"))


@query("SELECT min(c_custkey) AS c_custkey, c_mktsegment FROM customer GROUP BY c_mktsegment")
def conformed_dimension(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    padded = c.withColumn("c_mktsegment", F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    return clean.conform(padded.unionByName(padded), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), c_name, '')) AS record_hash,
  md5(concat_ws('|', c_mktsegment, CAST(c_nationkey AS VARCHAR))) AS sk FROM customer""")
def content_keys(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", keys.record_hash("c_custkey", "c_name", F.lit(None)).alias("record_hash"),
        keys.surrogate_key("c_mktsegment", "c_nationkey").alias("sk"))


@query("""SELECT p_partkey, replace(CAST(p_brand AS VARCHAR), '#', ' ') AS opening FROM part""")
def slug_words(spark, sf):
    url = F.concat(F.lit("https://www.example.org/openings/"), F.replace(F.col("p_brand").cast("string"), F.lit("#"), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", clean.slug_words(url, r"^https?://[^ ]*/openings/").alias("opening"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events""")
def map_props(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), F.size(m).cast("bigint").alias("n_keys"))


# --- stock ledger ---------------------------------------------------------------
# Events: purchases sell, signups restock; every user is a store, k of the props an item.

STOCK = """WITH moves AS (
  SELECT 'T' || event_id AS trans_id, CAST(user_id % 20 AS INTEGER) AS store_id, CAST(ts AS TIMESTAMP) AS date_time,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS change_type_id,
    CAST(event_id % 50 AS INTEGER) AS item_id, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END * CAST(floor(value) + 1 AS INTEGER) AS quantity,
    CASE WHEN event_id % 9 = 0 THEN 'B' || event_id END AS bopis_order_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'shop' END AS channel
  FROM events),
ok AS (SELECT m.*, CASE change_type_id WHEN 1 THEN 'sale' WHEN 2 THEN 'restock' WHEN 3 THEN 'shrinkage' ELSE 'bopis' END AS change_type
  FROM moves m WHERE store_id <> 7 AND item_id < 45),
snap AS (SELECT store_id, item_id, 1000 AS quantity, TIMESTAMP '2024-01-10 00:00:00' AS date_time FROM
  (SELECT CAST(range AS INTEGER) AS store_id FROM range(20)) CROSS JOIN (SELECT CAST(range AS INTEGER) AS item_id FROM range(45)) WHERE store_id <> 7),
moved AS (SELECT s.store_id, s.item_id, sum(o.quantity) AS change_quantity, max(o.date_time) AS last_at FROM snap s JOIN ok o
  ON s.store_id = o.store_id AND s.item_id = o.item_id AND o.date_time >= s.date_time
  WHERE NOT (o.store_id = 19 AND o.bopis_order_id IS NOT NULL) GROUP BY ALL),
stock AS (SELECT s.store_id, s.item_id, 'item ' || s.item_id AS item_name, 'cat ' || (s.item_id % 4) AS category, s.quantity AS snapshot_quantity,
  CAST(coalesce(m.change_quantity, 0) AS BIGINT) AS change_quantity, CAST(s.quantity + coalesce(m.change_quantity, 0) AS BIGINT) AS current_quantity,
  995 + s.item_id % 7 AS safety_stock_quantity, s.quantity + coalesce(m.change_quantity, 0) < 995 + s.item_id % 7 AS below_safety_stock,
  coalesce(greatest(s.date_time, m.last_at), s.date_time) AS last_movement_at
  FROM snap s LEFT JOIN moved m USING (store_id, item_id))
"""


def _movements(spark, sf) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "purchase", 1).when(e == "signup", 2).when(e == "error", 3).otherwise(4)
    amount = F.when(e == "signup", 1).otherwise(-1) * (F.floor("value") + 1).cast("int")
    store = (F.col("user_id") % 20).cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("T"), "event_id").alias("trans_id"), F.when(store == 19, 99).otherwise(store).alias("store_id"),
        F.col("ts").cast("string").alias("date_time"), kind.alias("change_type_id"),
        F.array(F.struct((F.col("event_id") % 50).cast("int").alias("item_id"), amount.alias("quantity"))).alias("items"),
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("B"), "event_id")).alias("bopis_order_id"),
        F.when(F.col("event_id") % 2 == 0, "web").otherwise("shop").alias("channel"))


def _stock_refs(spark):
    stores = spark.range(20).where("id <> 7").select(F.when(F.col("id") == 19, 99).otherwise(F.col("id")).cast("int").alias("store_id"))
    items = spark.range(45).select(
        F.col("id").cast("int").alias("item_id"), F.concat(F.lit("item "), "id").alias("item_name"),
        F.concat(F.lit("cat "), (F.col("id") % 4).cast("string")).alias("category"),
        (995 + F.col("id") % 7).cast("int").alias("safety_stock_quantity"))
    kinds = spark.createDataFrame([(1, "sale", "negative"), (2, "restock", "positive"), (3, "shrinkage", "negative"),
                                   (4, "bopis", "negative")], "change_type_id int, change_type string, expected_sign string")
    return stores, items, kinds


def _changes(spark, sf):
    return inventory.classify_changes(inventory.explode_changes(_movements(spark, sf)), *_stock_refs(spark))


def _stock(spark, sf) -> DataFrame:
    stores, items, kinds = _stock_refs(spark)
    base = stores.crossJoin(F.broadcast(items.select("item_id"))).select(
        "store_id", "item_id", F.lit(1000).alias("quantity"))
    newer = base.select(F.lit(2).alias("id"), "*", F.lit("2024-01-10 00:00:00").alias("date_time"))
    older = base.select(F.lit(9).alias("id"), "store_id", "item_id", F.lit(5).alias("quantity"), F.lit("2024-01-02 00:00:00").alias("date_time"))
    snaps = inventory.classify_snapshots(newer.unionByName(older), stores, items)[0]
    return inventory.current_stock(snaps, _changes(spark, sf)[0], items)


STORE = "CAST(CASE WHEN store_id = 19 THEN 99 ELSE store_id END AS INTEGER)"


@query(STOCK + f"""SELECT {STORE} AS store_id, item_id, item_name, category, CAST(snapshot_quantity AS INTEGER) AS snapshot_quantity, change_quantity,
  current_quantity, CAST(safety_stock_quantity AS INTEGER) AS safety_stock_quantity, below_safety_stock, last_movement_at FROM stock""", dates=("last_movement_at",))
def stock_ledger_current(spark, sf):
    return _stock(spark, sf).drop("snapshot_at")


@query(STOCK + f"""SELECT {STORE} AS store_id, 'store ' || {STORE} AS store_name, CASE WHEN store_id % 2 = 0 THEN 'mall' ELSE 'street' END AS store_type, item_id, item_name, category,
  CAST(snapshot_quantity AS INTEGER) AS snapshot_quantity, TIMESTAMP '2024-01-10 00:00:00' AS snapshot_date_time, change_quantity AS inventory_change_quantity,
  current_quantity AS current_inventory_quantity, CAST(safety_stock_quantity AS INTEGER) AS safety_stock_quantity, below_safety_stock,
  last_movement_at AS last_inventory_timestamp FROM stock""", dates=("snapshot_date_time", "last_inventory_timestamp"))
def stock_serving_validation(spark, sf):
    k = F.col("id")
    stores = spark.range(20).select(
        F.when(k == 19, 99).otherwise(k).cast("int").alias("store_id"),
        F.concat(F.lit("store "), F.when(k == 19, 99).otherwise(k)).alias("store_name"),
        F.when(k % 2 == 0, "mall").otherwise("street").alias("store_type"))
    return inventory.served_stock(_stock(spark, sf), stores)


@query("""SELECT 'run ' || year(o_orderdate) AS run_id, make_date(year(o_orderdate), 1, 1) AS profiled_at, count(*) FILTER (o_orderkey % 10 = 0) AS rejected_records,
  round(count(*) FILTER (o_orderkey % 10 = 0) / count(*), 4) AS rejected_rate FROM orders WHERE o_orderstatus = 'F' GROUP BY year(o_orderdate)""", dates=("profiled_at",))
def quality_trend(spark, sf):
    bad = F.count_if(F.col("o_orderkey") % 10 == 0)
    profiles = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(
        bad.alias("rejected_records"), F.round(bad / F.count(F.lit(1)), 4).alias("rejected_rate")).select(
        F.concat(F.lit("run "), "y").alias("run_id"), F.make_date("y", F.lit(1), F.lit(1)).alias("profiled_at"),
        F.when(F.col("o_orderstatus") == "F", "silver").otherwise("bronze").alias("layer"), "rejected_records", "rejected_rate")
    return inventory.quality_trend(profiles)


@query(STOCK + """SELECT count(*) AS n_positions, CAST(sum(current_quantity) AS BIGINT) AS units, count(*) FILTER (below_safety_stock) AS below_safety,
  count(DISTINCT store_id) AS n_stores FROM stock""")
def stock_kpis(spark, sf):
    return inventory.stock_kpis(_stock(spark, sf))


def _stock_by(key: str, expr: str) -> str:
    return STOCK + f"""SELECT {expr} AS {key}, CAST(sum(current_quantity) AS BIGINT) AS units, count(*) FILTER (below_safety_stock) AS below_safety,
      count(*) AS n_positions FROM stock GROUP BY 1"""


@query(_stock_by("store_id", STORE))
def below_safety_by_store(spark, sf):
    return inventory.stock_by(_stock(spark, sf), "store_id")


@query(_stock_by("category", "category"))
def stock_by_category(spark, sf):
    return inventory.stock_by(_stock(spark, sf), "category")


def _sold(key: str, expr: str) -> str:
    return STOCK + f"""SELECT {expr} AS {key}, CAST(sum(abs(quantity)) AS BIGINT) AS units_sold, count(DISTINCT trans_id) AS n_transactions
      FROM ok WHERE change_type IN ('sale', 'bopis') GROUP BY 1"""


@query(_sold("channel", "channel"))
def sales_by_channel(spark, sf):
    return inventory.sales_by(_changes(spark, sf)[0], "channel")


@query(_sold("store_id", STORE))
def sales_by_store(spark, sf):
    return inventory.sales_by(_changes(spark, sf)[0], "store_id")


@query(_sold("day", "CAST(date_time AS DATE)"), dates=("day",))
def sales_by_day(spark, sf):
    return inventory.sales_by(_changes(spark, sf)[0].withColumn("day", F.to_date("date_time")), "day")


@query(f"SELECT * FROM ({_sold('item_id', 'item_id')}) ORDER BY units_sold DESC, item_id LIMIT 15")
def sales_by_product_top15(spark, sf):
    return retail.top_n(inventory.sales_by(_changes(spark, sf)[0], "item_id"), 15, "units_sold", "item_id")


@query(STOCK + """SELECT 'cat ' || (item_id % 4) AS category, CAST(sum(abs(quantity)) AS BIGINT) AS units_sold, count(DISTINCT trans_id) AS n_transactions
  FROM ok WHERE change_type IN ('sale', 'bopis') GROUP BY 1""")
def sales_by_category(spark, sf):
    items = _stock_refs(spark)[1].select("item_id", "category")
    return inventory.sales_by(_changes(spark, sf)[0].join(items, "item_id"), "category")


@query(STOCK + """SELECT CAST(sum(abs(quantity)) AS BIGINT) AS units_sold, count(DISTINCT trans_id) AS n_transactions
  FROM ok WHERE change_type IN ('sale', 'bopis')""")
def total_sales_kpis(spark, sf):
    return inventory.sales_by(_changes(spark, sf)[0])


@query(STOCK + """SELECT reason, count(*) AS n_rows FROM (SELECT unnest(list_filter([CASE WHEN store_id = 7 THEN 'unknown_store_id' END,
  CASE WHEN item_id >= 45 THEN 'unknown_item_id' END], lambda x: x IS NOT NULL)) AS reason FROM moves) GROUP BY reason""")
def inventory_quarantine_reasons(spark, sf):
    return classify.reason_counts(_changes(spark, sf)[1])


@query("""SELECT CAST(floor((epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(max(ts))) / 60) AS BIGINT) AS minutes FROM events""")
def freshness_minutes(spark, sf):
    return inventory.freshness_minutes(table(spark, sf, "events"), "ts", F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("""SELECT l_orderkey AS order_id, l_partkey AS part_id, l_quantity AS quantity FROM lineitem""")
def items_exploded(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("items"))
    return o.select(F.col("l_orderkey").alias("order_id"), F.explode("items").alias("i")).select(
        "order_id", F.col("i.l_partkey").alias("part_id"), F.col("i.l_quantity").alias("quantity"))


# --- shipments ---------------------------------------------------------------------

SHIP = """WITH raw AS (
  SELECT DISTINCT 'SHP' || l_orderkey || '-' || l_linenumber AS shipment_id, 'WH' || l_suppkey AS warehouse_id, 'PRG' || (l_orderkey % 5) AS programme_id,
    'IT' || l_partkey AS item_code, CASE WHEN l_quantity = 3 THEN NULL WHEN l_quantity = 4 THEN -4 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
    CAST(l_shipdate AS DATE) AS ship_date, CASE l_linestatus WHEN 'O' THEN 'in_transit' ELSE CASE WHEN l_linenumber = 2 THEN 'cancelled' ELSE 'delivered' END END AS status,
    CAST(l_discount * 100 AS DECIMAL(10,2)) AS unit_cost, l_suppkey, l_partkey, l_orderkey FROM lineitem),
marked AS (SELECT *, list_filter([CASE WHEN count(*) OVER (PARTITION BY shipment_id) > 1 THEN 'conflicting_duplicate' END,
    CASE WHEN l_suppkey % 10 = 0 THEN 'missing_warehouse' END, CASE WHEN l_orderkey % 5 = 4 THEN 'missing_programme' END,
    CASE WHEN l_partkey % 11 = 0 THEN 'missing_item' END, CASE WHEN quantity IS NULL THEN 'missing_quantity' END,
    CASE WHEN quantity <= 0 THEN 'non_positive_quantity' END], lambda x: x IS NOT NULL) AS reasons FROM raw),
good AS (SELECT * FROM marked WHERE len(reasons) = 0)
"""


def _shipments(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") % 3
    day = (F.when(k == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(
        (k == 1) & (F.year("l_shipdate") >= 2000), F.upper(F.date_format("l_shipdate", "dd-MMM-yy"))).otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")))
    q = F.col("l_quantity")
    raw = li.select(
        F.concat(F.lit("SHP"), "l_orderkey", F.lit("-"), "l_linenumber").alias("SHIPMENT_ID"),
        F.concat(F.lit(" WH"), "l_suppkey").alias("WAREHOUSE_ID"), F.concat(F.lit("PRG"), F.col("l_orderkey") % 5).alias("PROGRAMME_ID"),
        F.concat(F.lit("IT"), "l_partkey").alias("ITEM_CODE"),
        F.when(q == 3, "").when(q == 4, "-4").otherwise(q.cast("int").cast("string")).alias("QUANTITY"), day.alias("SHIP_DATE"),
        F.when(F.col("l_linestatus") == "O", " In Transit").when(F.col("l_linenumber") == 2, "CANCELLED").otherwise("delivered").alias("STATUS"),
        F.concat(F.lit("$"), (F.col("l_discount") * 100).cast("decimal(10,2)")).alias("UNIT_COST"))
    w = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.concat(F.lit("WH"), "s_suppkey").alias("WAREHOUSE_ID"), F.col("s_name").alias("warehouse_name"))
    p = spark.range(4).select(F.concat(F.lit("PRG"), "id").alias("PROGRAMME_ID"), F.concat(F.lit("programme "), "id").alias("programme_name"))
    i = table(spark, sf, "part").where("p_partkey % 11 <> 0").select(F.concat(F.lit("IT"), "p_partkey").alias("ITEM_CODE"), F.col("p_name").alias("item_name"))
    return shipments.classify_shipments(shipments.clean_shipments(raw), w, p, i), (w, p, i)


def _fact_shipments(spark, sf):
    (accepted, _), dims = _shipments(spark, sf)
    return shipments.fact_shipments(accepted, *[d.withColumnRenamed(d.columns[0], d.columns[0].lower()) for d in dims])


@query(SHIP + "SELECT shipment_id, array_to_string(reasons, '; ') AS reasons FROM marked WHERE len(reasons) > 0")
def shipment_quarantine(spark, sf):
    return _shipments(spark, sf)[0][1].select("shipment_id", classify.joined_reasons().alias("reasons"))


@query(SHIP + """SELECT shipment_id, warehouse_id, s.s_name AS warehouse_name, 'programme ' || (l_orderkey % 5) AS programme_name, item_code,
  ship_date, status, quantity, CAST(quantity * unit_cost AS DOUBLE) AS total_cost FROM good JOIN supplier s ON l_suppkey = s.s_suppkey""", dates=("ship_date",))
def fact_shipments(spark, sf):
    return _fact_shipments(spark, sf).select("shipment_id", "warehouse_id", "warehouse_name", "programme_name", "item_code", "ship_date",
                                             "status", "quantity", F.col("total_cost").cast("double").alias("total_cost"))


@query(SHIP + """SELECT programme_id, strftime(ship_date, '%Y-%m') AS ship_month, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  CAST(CAST(sum(quantity * unit_cost) AS DECIMAL(18,2)) AS DOUBLE) AS total_cost, count(*) AS n_shipments FROM good WHERE status <> 'cancelled' GROUP BY 1, 2""")
def programme_monthly_summary(spark, sf):
    return shipments.monthly_summary(_fact_shipments(spark, sf))


# --- funding -------------------------------------------------------------------------

CONTRIB = """WITH c AS (
  SELECT 'c' || o_orderkey AS contribution_id, 'D' || (o_custkey % 40) AS donor_id, 'P' || (o_custkey % 6) AS programme_id,
    CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_orderdate AS DATE) AS contribution_date,
    CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'XXX' END AS currency, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN o_orderstatus = 'F' THEN 'received' ELSE 'committed' END AS status, o_orderkey % 2 = 0 AS is_json, o_orderkey, o_custkey FROM orders),
r AS (SELECT *, CASE currency WHEN 'EUR' THEN CAST(1.1 AS DECIMAL(18,8)) WHEN 'GBP' THEN CAST(1.25 AS DECIMAL(18,8)) + CAST(month(contribution_date) AS DECIMAL(18,8)) / 100 END AS rate FROM c),
u AS (SELECT *, CASE currency WHEN 'GBP' THEN CAST(amount * CAST(round(1.25 + month(contribution_date) / 100.0, 2) AS DECIMAL(18,8)) AS DECIMAL(18,2))
   WHEN 'EUR' THEN CAST(amount * CAST(1.1 AS DECIMAL(18,8)) AS DECIMAL(18,2)) END AS amount_usd FROM c),
marked AS (SELECT *, list_filter([CASE WHEN o_custkey % 40 = 0 THEN 'missing_donor' END, CASE WHEN o_custkey % 6 = 5 THEN 'missing_programme' END,
   CASE WHEN is_json AND amount_usd IS NULL THEN 'missing_exchange_rate' END], lambda x: x IS NOT NULL) AS reasons FROM u),
good AS (SELECT * FROM marked WHERE len(reasons) = 0)
"""


def _contributions(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    cur = F.when(k % 3 == 0, "eur").when(k % 3 == 1, " GBP ").otherwise("XXX")
    status = F.when(F.col("o_orderstatus") == "F", "Received").otherwise("COMMITTED ")
    common = {"CONTRIBUTION_ID": F.concat(F.lit("c"), k), "DONOR_ID": F.concat(F.lit("D"), F.col("o_custkey") % 40),
              "PROGRAMME_ID": F.concat(F.lit("P"), F.col("o_custkey") % 6), "FISCAL_YEAR": F.year("o_orderdate").cast("string"),
              "CURRENCY_ORIGINAL": cur, "AMOUNT_ORIGINAL": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "STATUS": status}
    csv = o.where("o_orderkey % 2 = 1").select(*[c.alias(n) for n, c in common.items()], F.date_format("o_orderdate", "MM/dd/yyyy").alias("CONTRIBUTION_DATE"))
    js = o.where("o_orderkey % 2 = 0").select(*[c.alias(n.lower()) for n, c in common.items()],
                                              F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("contribution_date"))
    months = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("rate_month")).distinct()
    gbp = F.round(F.lit(1.25) + F.substring("rate_month", 6, 2).cast("int") / 100.0, 2)
    rates = months.select(F.lit("EUR").alias("currency"), "rate_month", F.lit(1.1).alias("rate_to_usd")).unionByName(
        months.select(F.lit("GBP").alias("currency"), "rate_month", gbp.alias("rate_to_usd")))
    donors = spark.range(1, 40).select(F.concat(F.lit("D"), "id").alias("donor_id"))
    programmes = spark.range(5).select(F.concat(F.lit("P"), "id").alias("programme_id"))
    return funding.classify_contributions(funding.normalised(csv, "csv"), funding.normalised(js, "json"), rates, donors, programmes)


@query(CONTRIB + """SELECT contribution_id, donor_id, programme_id, fiscal_year, contribution_date, status, CAST(amount AS DOUBLE) AS amount_original,
  CAST(amount_usd AS DOUBLE) AS amount_usd, CASE WHEN is_json THEN 'json' ELSE 'csv' END AS source_batch FROM good""", dates=("contribution_date",))
def fx_enriched_contributions(spark, sf):
    return _contributions(spark, sf)[0].select(
        "contribution_id", "donor_id", "programme_id", "fiscal_year", "contribution_date", "status",
        F.col("amount_original").cast("double").alias("amount_original"), F.col("amount_usd").cast("double").alias("amount_usd"), "source_batch")


@query(CONTRIB + """SELECT contribution_id, array_to_string(reasons, ',') AS reasons, array_to_string(list_transform(reasons, lambda x: CASE x
  WHEN 'missing_donor' THEN 'The donor is not in the donor list.' WHEN 'missing_programme' THEN 'The programme is not in the programme list.'
  ELSE 'There is no exchange rate for the currency and month.' END), ' ') AS comment FROM marked WHERE len(reasons) > 0""")
def contribution_quarantine(spark, sf):
    return _contributions(spark, sf)[1].select("contribution_id", classify.joined_reasons(",").alias("reasons"), "comment")


@query("""SELECT DISTINCT 'D' || (c_nationkey % 7) AS donor_id, 'Donor ' || (c_nationkey % 7) AS donor_name,
  CASE WHEN c_nationkey % 7 % 2 = 0 THEN 'government' ELSE 'private' END AS donor_type, 'N' || (c_nationkey % 7) AS country FROM customer""")
def donors_conformed(spark, sf):
    k = F.col("c_nationkey") % 7
    raw = table(spark, sf, "customer").select(
        F.concat(F.lit(" D"), k).alias("DONOR_ID"), F.concat(F.lit("Donor "), k, F.lit(" ")).alias("DONOR_NAME"),
        F.when(k % 2 == 0, "GOVERNMENT ").otherwise("Private").alias("DONOR_TYPE"), F.concat(F.lit("N"), k).alias("COUNTRY"))
    return funding.conform_donors(raw)


@query("""SELECT 'G' || o_orderkey AS grant_id, 'ref ' || o_custkey AS grant_reference, 'd' || (o_custkey % 40) AS donor_id, 'p' || (o_custkey % 6) AS programme_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount_committed_usd,
  CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS signed_date, CASE o_orderkey % 3 WHEN 0 THEN 'quarterly' WHEN 1 THEN 'annual' END AS reporting_frequency,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) + 1 END AS next_due_date, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority END AS tags_str
  FROM orders""", dates=("signed_date", "next_due_date"))
def grants_conformed(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    due = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 86_400_000 + k % 1000
    report = F.struct(F.when(k % 3 == 0, "quarterly").otherwise("annual").alias("frequency"), due.alias("next_due_date_epoch"))
    tags = F.when(k % 4 == 1, F.array("o_orderstatus")).when(k % 4 > 1, F.array("o_orderstatus", "o_orderpriority"))
    one = o.select(
        F.concat(F.lit(" G"), k).alias("grant_id"), F.concat(F.lit("ref "), F.col("o_custkey"), F.lit(" ")).alias("grant_reference"),
        F.concat(F.lit("d"), F.col("o_custkey") % 40).alias("donor_id"), F.concat(F.lit("p"), F.col("o_custkey") % 6).alias("programme_id"),
        F.when(k % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount_committed_usd"),
        F.when(k % 8 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("signed_date"),
        F.when(k % 3 < 2, report).alias("reporting"), tags.alias("tags"))
    return funding.grants(one.unionByName(one)).withColumn("amount_committed_usd", F.col("amount_committed_usd").cast("double"))


SUMMARY = CONTRIB + """, summary AS (SELECT programme_id, fiscal_year,
  CAST(sum(CASE WHEN status = 'committed' THEN amount_usd ELSE 0 END) AS DECIMAL(18,2)) AS committed_usd,
  CAST(sum(CASE WHEN status = 'received' THEN amount_usd ELSE 0 END) AS DECIMAL(18,2)) AS received_usd, count(*) AS n_contributions
  FROM good GROUP BY ALL)
"""


@query(SUMMARY + """SELECT programme_id, fiscal_year, CAST(committed_usd AS DOUBLE) AS committed_usd, CAST(received_usd AS DOUBLE) AS received_usd,
  n_contributions FROM summary""")
def funding_summary(spark, sf):
    return funding.funding_summary(_contributions(spark, sf)[0]).select(
        "programme_id", "fiscal_year", F.col("committed_usd").cast("double").alias("committed_usd"),
        F.col("received_usd").cast("double").alias("received_usd"), "n_contributions")


@query(SUMMARY + """SELECT programme_id, fiscal_year, CASE WHEN programme_id = 'P0' THEN CAST(committed_usd AS DOUBLE) WHEN programme_id = 'P1' THEN -5.0 ELSE 0.0 END AS committed_diff,
  CASE WHEN programme_id = 'P0' THEN CAST(received_usd AS DOUBLE) ELSE 0.0 END AS received_diff,
  CASE WHEN programme_id = 'P0' THEN committed_usd > 0.01 OR received_usd > 0.01 ELSE programme_id = 'P1' END AS is_variance FROM summary""")
def legacy_variance(spark, sf):
    new = funding.funding_summary(_contributions(spark, sf)[0])
    old = new.where("programme_id <> 'P0'").withColumn("committed_usd", (F.col("committed_usd") + F.when(
        F.col("programme_id") == "P1", 5).otherwise(0)).cast("decimal(18,2)"))
    return funding.legacy_variance(new, old)


# --- versions ------------------------------------------------------------------------

SNAPS = """WITH snaps AS (SELECT o_custkey % 50 AS programme_id, make_date(year(o_orderdate), 1, 1) AS snapshot_date,
    max(o_orderpriority) AS sector, count(*) // 20 AS budget FROM orders GROUP BY ALL),
flagged AS (SELECT *, lag(sector) OVER w AS ps, lag(budget) OVER w AS pb, row_number() OVER w AS n FROM snaps WINDOW w AS (PARTITION BY programme_id ORDER BY snapshot_date)),
v AS (SELECT programme_id, sector, budget, snapshot_date AS effective_start FROM flagged WHERE n = 1 OR ps IS DISTINCT FROM sector OR pb IS DISTINCT FROM budget),
versions AS (SELECT *, lead(effective_start) OVER w AS effective_end, CAST(row_number() OVER w AS BIGINT) AS version_rank FROM v
  WINDOW w AS (PARTITION BY programme_id ORDER BY effective_start))
"""


def _versions(spark, sf) -> DataFrame:
    snaps = table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 50).alias("programme_id"), F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("snapshot_date")).agg(
        F.max("o_orderpriority").alias("sector"), F.floor(F.count(F.lit(1)) / 20).alias("budget"))
    return scd2.versions_from_snapshots(snaps, "programme_id", "snapshot_date", ["sector", "budget"])


@query(SNAPS + "SELECT programme_id, sector, CAST(budget AS BIGINT) AS budget, effective_start, effective_end, version_rank, effective_end IS NULL AS is_current FROM versions", dates=("effective_start", "effective_end",))
def programme_scd2(spark, sf):
    return _versions(spark, sf).select("programme_id", "sector", F.col("budget").cast("bigint").alias("budget"), "effective_start", "effective_end",
                                       F.col("version_rank").cast("bigint").alias("version_rank"), "is_current")


PIT = SNAPS + """, facts AS (SELECT o_orderkey, o_custkey % 50 AS programme_id, CAST(o_orderdate AS DATE) - INTERVAL 400 DAY AS d FROM orders),
pick AS (SELECT o_orderkey, f.programme_id, sector, version_rank, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN d >= effective_start THEN 0 ELSE 1 END, effective_start DESC) AS n
  FROM facts f JOIN versions v ON f.programme_id = v.programme_id AND (d >= effective_start OR version_rank = 1) AND (effective_end IS NULL OR d < effective_end))
"""


def _dated(spark, sf, days: int) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("programme_id"),
                                             F.date_sub(F.to_date("o_orderdate"), days).alias("d"))


@query(PIT + "SELECT o_orderkey, programme_id, sector, version_rank FROM pick WHERE n = 1")
def point_in_time_fact(spark, sf):
    got = temporal.point_in_time(_dated(spark, sf, 400), _versions(spark, sf), "o_orderkey", "programme_id", "d")
    return got.select("o_orderkey", "programme_id", "sector", F.col("version_rank").cast("bigint").alias("version_rank"))


@query(SNAPS + """SELECT o_orderkey, version_rank FROM (SELECT o_orderkey, o_custkey % 50 AS programme_id, CAST(o_orderdate AS DATE) AS d FROM orders) f
  JOIN versions v ON f.programme_id = v.programme_id AND d >= effective_start AND (effective_end IS NULL OR d < effective_end)""")
def interval_join(spark, sf):
    versions = _versions(spark, sf).select("programme_id", "effective_start", "effective_end", "version_rank")
    got = temporal.interval_join(_dated(spark, sf, 0), versions, "programme_id", "d")
    return got.select("o_orderkey", F.col("version_rank").cast("bigint").alias("version_rank"))


@query("""WITH s AS (SELECT c_custkey AS player_id, 'T' || (c_custkey % 8) AS t1, CASE WHEN c_custkey % 3 = 0 THEN 'T9' ELSE 'T' || (c_custkey % 8) END AS t2 FROM customer),
 a AS (SELECT player_id, t1 AS team FROM s WHERE player_id % 5 <> 0), b AS (SELECT player_id, t2 AS team FROM s WHERE player_id % 7 <> 0)
SELECT a.player_id, a.team, DATE '2023-10-01' AS effective_start, CASE WHEN b.player_id IS NULL OR b.team <> a.team THEN DATE '2024-10-01' ELSE DATE '9999-12-31' END AS effective_end,
  NOT (b.player_id IS NULL OR b.team <> a.team) AS is_current, md5(a.team) AS attr_hash, md5(a.player_id || '|2023-10-01') AS sk FROM a LEFT JOIN b USING (player_id)
UNION ALL SELECT b.player_id, b.team, DATE '2024-10-01', DATE '9999-12-31', true, md5(b.team), md5(b.player_id || '|2024-10-01') FROM b LEFT JOIN a USING (player_id)
WHERE a.player_id IS NULL OR a.team <> b.team""", dates=("effective_start", "effective_end",))
def scd2_incremental(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.concat(F.lit("T"), F.col("c_custkey") % 8).alias("team"))
    one = c.where("player_id % 5 <> 0")
    two = c.where("player_id % 7 <> 0").withColumn("team", F.when(F.col("player_id") % 3 == 0, "T9").otherwise(F.col("team")))
    dim = scd2.apply_snapshot(scd2.empty_dimension(one, "player_id", ["team"]), one, "player_id", ["team"], "2023-10-01", check_order=False)
    return scd2.apply_snapshot(dim, two, "player_id", ["team"], "2024-10-01", check_order=False)


# --- league: orders are games between teams, order lines are box scores ----------------

GAMES = """WITH games AS (SELECT o_orderkey AS game_id, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS game_date, o_custkey % 12 AS home_team_id,
  (o_custkey + 1 + o_orderkey % 11) % 12 AS away_team_id, CAST(floor(o_totalprice) AS BIGINT) % 60 + 70 AS home_score, (o_orderkey * 7) % 60 + 70 AS away_score FROM orders),
sides AS (SELECT season, game_id, home_team_id AS team_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS won FROM games
  UNION ALL SELECT season, game_id, away_team_id, CASE WHEN home_score > away_score THEN 0 ELSE 1 END FROM games),
standing AS (SELECT season, team_id, CAST(sum(won) AS BIGINT) AS wins, count(*) AS games_played, round(sum(won) / count(*), 3) AS win_pct FROM sides GROUP BY ALL),
box AS (SELECT l_orderkey AS game_id, l_suppkey AS player_id, CAST(l_quantity AS BIGINT) AS pts, CAST(l_linenumber AS BIGINT) AS reb FROM lineitem),
dim AS (SELECT s_suppkey AS player_id, 'A' || s_suppkey AS sk, s_nationkey % 12 AS team_id, DATE '1990-01-01' AS st, DATE '1998-01-01' AS en, false AS is_current FROM supplier
  UNION ALL SELECT s_suppkey, 'B' || s_suppkey, (s_nationkey + 1) % 12, DATE '1998-01-01', DATE '9999-12-31', true FROM supplier),
fact AS (SELECT b.*, g.season, d.sk, d.team_id, d.is_current FROM box b JOIN games g USING (game_id) JOIN dim d ON b.player_id = d.player_id AND g.game_date >= st AND g.game_date < en),
points AS (SELECT season, sk, team_id, CAST(sum(pts) AS BIGINT) AS points FROM fact GROUP BY ALL)
"""


def _games(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").cast("bigint").alias("season"), F.to_date("o_orderdate").alias("game_date"),
        (F.col("o_custkey") % 12).alias("home_team_id"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 11) % 12).alias("away_team_id"),
        (F.floor("o_totalprice") % 60 + 70).alias("home_score"), (F.col("o_orderkey") * 7 % 60 + 70).alias("away_score"))


def _players(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")

    def span(prefix, shift, start, end, current):
        return s.select(F.col("s_suppkey").alias("player_id"), F.concat(F.lit(prefix), "s_suppkey").alias("sk"),
                        ((F.col("s_nationkey") + shift) % 12).cast("bigint").alias("team_id"), F.lit(start).cast("date").alias("effective_start"),
                        F.lit(end).cast("date").alias("effective_end"), F.lit(current).alias("is_current"))
    return span("A", 0, "1990-01-01", "1998-01-01", False).unionByName(span("B", 1, "1998-01-01", "9999-12-31", True))


def _box(spark, sf) -> DataFrame:
    scores = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id"), F.col("l_quantity").cast("bigint").alias("pts"),
        F.col("l_linenumber").cast("bigint").alias("reb"))
    return league.fact_box_scores(scores, _games(spark, sf), _players(spark, sf))


@query(GAMES + "SELECT CAST(season AS BIGINT) AS season, CAST(team_id AS BIGINT) AS team_id, wins, games_played, win_pct FROM standing")
def team_win_pct(spark, sf):
    return league.standings(_games(spark, sf))


@query(GAMES + """SELECT CAST(season AS BIGINT) AS season, CAST(team_id AS BIGINT) AS team_id, wins, CAST(n AS BIGINT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY season ORDER BY wins DESC, team_id) AS n FROM standing) WHERE n <= 5""")
def top_teams_by_season(spark, sf):
    return league.top_by_season(league.standings(_games(spark, sf)), "wins", "team_id", 5).select("season", "team_id", "wins", "place")


@query(GAMES + "SELECT CAST(season AS BIGINT) AS season, sk, CAST(team_id AS BIGINT) AS team_id, points FROM points")
def players_points_season(spark, sf):
    return league.season_points(_box(spark, sf))


@query(GAMES + """SELECT CAST(season AS BIGINT) AS season, sk, points, CAST(n AS BIGINT) AS place FROM (SELECT season, p.sk, points, row_number() OVER (
  PARTITION BY season ORDER BY points DESC, p.sk) AS n FROM points p JOIN dim d ON p.sk = d.sk AND d.is_current) WHERE n <= 10""")
def top_players_by_season(spark, sf):
    current = _players(spark, sf).where("is_current").select("sk")
    points = league.season_points(_box(spark, sf)).join(current, "sk")
    return league.top_by_season(points, "points", "sk", 10).select("season", "sk", "points", "place")


@query(GAMES + """SELECT sk, count(*) AS n_games, round(avg(pts), 4) AS avg_pts, round(avg(reb), 4) AS avg_reb FROM fact
  WHERE (season, sk) IN (SELECT (season, sk) FROM (SELECT season, sk, row_number() OVER (PARTITION BY season ORDER BY points DESC, sk) AS n FROM points) WHERE n = 1)
  GROUP BY sk HAVING count(*) >= 2""")
def top_scorer_profile(spark, sf):
    fact = _box(spark, sf)
    best = league.top_by_season(league.season_points(fact), "points", "sk", 1).select("season", "sk")
    return fact.join(best, ["season", "sk"], "left_semi").groupBy("sk").agg(
        F.count(F.lit(1)).alias("n_games"), F.round(F.avg("pts"), 4).alias("avg_pts"), F.round(F.avg("reb"), 4).alias("avg_reb")).where("n_games >= 2")


@query(GAMES + """, t AS (SELECT season, round(avg(pts), 4) AS avg_pts, round(avg(reb), 4) AS avg_reb FROM fact GROUP BY season)
SELECT CAST(season AS BIGINT) AS season, 'avg_pts' AS metric, avg_pts AS value FROM t UNION ALL SELECT season, 'avg_reb', avg_reb FROM t""")
def league_trends(spark, sf):
    by = _box(spark, sf).groupBy("season").agg(F.round(F.avg("pts"), 4).alias("avg_pts"), F.round(F.avg("reb"), 4).alias("avg_reb"))
    return league.melted(by, ["season"], ["avg_pts", "avg_reb"])


@query(GAMES + """SELECT * FROM (SELECT CAST(season AS BIGINT) AS season, sk, round(avg(pts), 4) AS points_per_game FROM fact GROUP BY season, sk) WHERE season = 1997
  ORDER BY points_per_game DESC, sk LIMIT 5""")
def top_scorers_per_game(spark, sf):
    by = _box(spark, sf).where("season = 1997").groupBy("season", "sk").agg(F.round(F.avg("pts"), 4).alias("points_per_game"))
    return retail.top_n(by, 5, "points_per_game", "sk")


# --- games: events as rated games in bronze JSON ------------------------------------------

PLAYED = """WITH g AS (SELECT 'g' || event_id AS game_id, 'u' || (user_id % 40) AS username, CAST(ts AS TIMESTAMP) AS game_end_at, CAST(ts AS DATE) AS game_date,
  CASE event_type WHEN 'purchase' THEN 'win' WHEN 'view' THEN 'draw' WHEN 'click' THEN 'draw' ELSE 'loss' END AS result,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1200 + CAST(floor(value) AS INTEGER) END AS target_rating, event_id % 2 = 0 AS white,
  'opening ' || (event_id % 5) AS opening FROM events),
ok AS (SELECT * FROM g WHERE target_rating IS NOT NULL)
"""


def _played(spark, sf):
    e = table(spark, sf, "events")
    me = F.concat(F.lit("U"), F.col("user_id") % 40)
    t = F.col("event_type")
    code = F.when(t == "purchase", "win").when(t == "view", "agreed").when(t == "click", "50move").otherwise("resigned")
    mine = F.struct(me.alias("username"), F.when(F.col("event_id") % 13 != 0, 1200 + F.floor("value")).cast("int").alias("rating"), code.alias("result"))
    other = F.struct(F.lit("rival").alias("username"), F.lit(1500).alias("rating"), F.lit("win").alias("result"))
    white = F.col("event_id") % 2 == 0
    payload = F.to_json(F.struct(
        F.concat(F.lit("g"), "event_id").alias("url"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("end_time"), F.lit(True).alias("rated"),
        F.concat(F.lit("https://www.example.org/openings/opening-"), F.col("event_id") % 5).alias("eco"),
        F.when(white, mine).otherwise(other).alias("white"), F.when(white, other).otherwise(mine).alias("black")))
    one = e.select(F.lit("games").alias("record_type"), F.lower(me).alias("username"), payload.alias("payload_json"),
                   F.col("ts").cast("timestamp").alias("ingested_at"), F.sha2(payload, 256).alias("record_hash"))
    again = one.withColumn("ingested_at", F.col("ingested_at") - F.expr("INTERVAL 1 DAY")).withColumn("record_hash", F.lit("0"))
    return games.classify_games(games.clean_games(one.unionByName(again)))


@query(PLAYED + """SELECT game_id, username, game_date, result, target_rating, CASE WHEN white THEN 'white' ELSE 'black' END AS target_color,
  'rival' AS opponent_username, opening FROM ok""", dates=("game_date",))
def games_cleaned(spark, sf):
    return _played(spark, sf)[0].select("game_id", "username", "game_date", "result", "target_rating", "target_color", "opponent_username", "opening")


@query(PLAYED + "SELECT 'missing_target_rating' AS reason, 2 * count(*) AS n_rows FROM g WHERE target_rating IS NULL HAVING count(*) > 0")
def games_quarantine(spark, sf):
    return classify.reason_counts(_played(spark, sf)[1])


@query(PLAYED + """SELECT username, game_date, count(*) FILTER (result = 'win') AS win, count(*) FILTER (result = 'draw') AS draw,
  count(*) FILTER (result = 'loss') AS loss FROM ok GROUP BY ALL""", dates=("game_date",))
def game_results_pivot(spark, sf):
    return games.results_pivot(_played(spark, sf)[0], "username", "game_date")


A2 = "CAST(CAST(round(CAST(avg({}) AS DECIMAL(20,6)), 2) AS DECIMAL(18,2)) AS DOUBLE)"
WON = "count(*) FILTER (result = 'win')"
SUMMARISED = PLAYED + f""", summary AS (SELECT username, count(*) AS games, count(DISTINCT game_date) AS active_days, {A2.format("target_rating")} AS average_rating,
  1500.0 AS average_opponent_rating, date_trunc('second', min(game_end_at)) AS first_game_at, date_trunc('second', max(game_end_at)) AS last_game_at,
  {WON} AS win, count(*) FILTER (result = 'draw') AS draw, count(*) FILTER (result = 'loss') AS loss, round({WON} / count(*), 4) AS win_rate FROM ok GROUP BY username)
"""


@query(PLAYED + """, d AS (SELECT username, game_date, arg_max(target_rating, struct_pack(a := date_trunc('second', game_end_at), b := game_id)) AS ending_rating
  FROM ok GROUP BY ALL) SELECT *, CAST(ending_rating - lag(ending_rating) OVER (PARTITION BY username ORDER BY game_date) AS INTEGER) AS rating_change FROM d""", dates=("game_date",))
def rating_change(spark, sf):
    return games.rating_progression(_played(spark, sf)[0])


@query(SUMMARISED + "SELECT * REPLACE (CAST(average_opponent_rating AS DOUBLE) AS average_opponent_rating) FROM summary", dates=("first_game_at", "last_game_at"))
def player_summary(spark, sf):
    return games.player_summary(_played(spark, sf)[0])


@query(SUMMARISED + """SELECT username, games, active_days, average_rating, CASE WHEN games >= 100 THEN 'POWER' WHEN games >= 30 THEN 'ACTIVE' ELSE 'CASUAL' END AS player_segment
  FROM summary""")
def player_segment(spark, sf):
    return games.player_segment(games.player_summary(_played(spark, sf)[0]))


@query(PLAYED + f"""SELECT username, game_date, count(*) AS games, {WON} AS wins, count(*) FILTER (result = 'draw') AS draws, count(*) FILTER (result = 'loss') AS losses,
  {A2.format("target_rating")} AS average_rating, round({WON} / count(*), 4) AS win_rate FROM ok GROUP BY ALL""", dates=("game_date",))
def daily_activity(spark, sf):
    return games.daily_activity(_played(spark, sf)[0])


@query(PLAYED + f"""SELECT username, opening, count(*) AS games, {WON} AS wins, CAST(1500 AS DOUBLE) AS average_opponent_rating, round({WON} / count(*), 4) AS win_rate
  FROM ok GROUP BY ALL""")
def opening_performance(spark, sf):
    return games.opening_performance(_played(spark, sf)[0])


# --- workforce -----------------------------------------------------------------------------

_SKILL_ROWS = ", ".join("('{}', '{}', [{}])".format(i, n, ", ".join(f"'{w}'" for w in words)) for i, n, words in workforce.SKILLS)
SIGNALS = f"""WITH ev AS (SELECT o_orderkey AS id, 'S' || o_orderkey AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'office_workplan' WHEN 1 THEN 'workforce_planning_survey' ELSE 'memo' END AS document_type,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'O' || (o_custkey % 5) END AS office_id, 'K' || (o_custkey % 5) AS country, 'R' AS region,
  'Office ' || o_orderkey || ': ' || CASE o_orderkey % 7 WHEN 0 THEN 'Urgent shortage of Data Engineering staff' WHEN 1 THEN 'No evidence of need in climate work'
   WHEN 2 THEN 'Planned expansion of AI and cybersecurity' WHEN 3 THEN 'Less demand for evaluation' WHEN 4 THEN 'Gender inclusion is rising next two quarters'
   WHEN 5 THEN 'Emergency surge required' ELSE 'Nothing to report' END AS evidence_text FROM orders),
skill(skill_id, skill_name, words) AS (VALUES {_SKILL_ROWS}),
sig AS (SELECT source_id, document_type, office_id, country, region, skill_id, skill_name,
  CASE WHEN regexp_matches(lower(evidence_text), '{workforce.NEGATED}') THEN 'stable' WHEN regexp_matches(lower(evidence_text), '{workforce.DECREASING}') THEN 'decreasing'
    WHEN regexp_matches(lower(evidence_text), '{workforce.INCREASING}') THEN 'increasing' ELSE 'unclear' END AS demand_direction,
  CASE WHEN regexp_matches(lower(evidence_text), '{workforce.URGENT}') THEN 'high' WHEN regexp_matches(lower(evidence_text), '{workforce.SOON}') THEN 'medium' ELSE 'low' END AS urgency,
  evidence_text, CASE document_type WHEN 'workforce_planning_survey' THEN 0.85 WHEN 'office_workplan' THEN 0.75 ELSE 0.6 END AS confidence,
  regexp_matches(lower(evidence_text), '{workforce.NEGATED}') AS negated
  FROM ev, skill WHERE len(list_filter(words, lambda w: instr(lower(evidence_text), w) > 0)) > 0)
"""


def _signals(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = ["Urgent shortage of Data Engineering staff", "No evidence of need in climate work", "Planned expansion of AI and cybersecurity",
            "Less demand for evaluation", "Gender inclusion is rising next two quarters", "Emergency surge required", "Nothing to report"]
    text = F.concat(F.lit("Office "), k, F.lit(": "), F.get(F.array(*map(F.lit, said)), (k % 7).cast("int")))
    base = o.select(F.concat(F.lit("S"), k).alias("source_id"), (k % 3).alias("m"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("O"), c % 5)).alias("office_id"),
                    F.concat(F.lit("K"), c % 5).alias("country"), F.lit("R").alias("region"), text.alias("evidence_text"))
    register = base.where("m <> 1").withColumn("document_type", F.when(F.col("m") == 0, "office_workplan").otherwise("memo"))
    rows = base.where("m = 1").select("source_id", F.lit("survey_responses").alias("sheet_key"), F.to_json(F.struct(
        "office_id", "country", "region", F.col("evidence_text").alias("narrative_response"))).alias("row_json"))
    return workforce.signals(workforce.evidence(register, rows))


@query(SIGNALS + """SELECT source_id, document_type, office_id, country, region, skill_id, skill_name, demand_direction, urgency, evidence_text,
  CAST(confidence AS DOUBLE) AS confidence, negated FROM sig""")
def skill_signals(spark, sf):
    return _signals(spark, sf)


@query(SIGNALS + """SELECT reason, count(*) AS n_rows FROM (SELECT unnest(list_filter([CASE WHEN office_id = '' THEN 'missing_office' END, CASE WHEN negated THEN 'negated_demand' END],
  lambda x: x IS NOT NULL)) AS reason FROM sig) GROUP BY reason""")
def signal_quarantine(spark, sf):
    return classify.reason_counts(workforce.classify_signals(_signals(spark, sf))[1])


STAFF = """WITH sup AS (SELECT 'O' || (s_nationkey % 5) AS office_id, 'K' || (s_nationkey % 5) AS country, 'R' AS region,
  CASE s_suppkey % 3 WHEN 0 THEN 'SK001' WHEN 1 THEN 'SK011' ELSE 'SK020' END AS skill_id, s_suppkey,
  CASE WHEN s_suppkey % 4 = 0 THEN 0.35 ELSE 1.00 END AS active, CAST(s_suppkey % 6 AS DECIMAL(8,4)) * 0.2 AS prof,
  CASE s_suppkey % 3 WHEN 0 THEN 0.65 WHEN 1 THEN 0.85 ELSE 1.0 END AS risk, CASE s_suppkey % 4 WHEN 0 THEN 1.05 WHEN 1 THEN 0.9 ELSE 0.75 END AS mob FROM supplier),
now AS (SELECT office_id, country, region, skill_id, count(DISTINCT s_suppkey) AS employees_with_skill, sum(active * prof * risk * mob) AS cur,
  count(*) FILTER (s_suppkey % 4 = 0) AS ready_now_count, count(*) FILTER (s_suppkey % 3 = 0) AS high_retention_risk_count FROM sup GROUP BY ALL),
plan AS (SELECT 'O' || (p_partkey % 6) AS office_id, 'SK001' AS skill_id, sum(CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.275 ELSE 0.0 END) AS planned FROM part GROUP BY 1),
supply AS (SELECT coalesce(n.office_id, p.office_id) AS office_id, country, region, coalesce(n.skill_id, p.skill_id) AS skill_id, coalesce(employees_with_skill, 0) AS employees_with_skill,
  coalesce(cur, 0) + coalesce(planned, 0) AS supply_fte, coalesce(ready_now_count, 0) AS ready_now_count, coalesce(high_retention_risk_count, 0) AS high_retention_risk_count
  FROM now n FULL JOIN plan p ON n.office_id = p.office_id AND n.skill_id = p.skill_id)
"""


def _supply(spark, sf) -> DataFrame:
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 5
    office, skill = F.concat(F.lit("O"), n), F.when(k % 3 == 0, "SK001").when(k % 3 == 1, "SK011").otherwise("SK020")
    ident = k.cast("string").alias("employee_id")
    employees = s.select(ident, F.concat(F.lit("K"), n).alias("country"), F.lit("R").alias("region"), F.when(k % 4 == 0, "Leave").otherwise("Active").alias("employment_status"))
    skills = s.select(ident, office.alias("office_id"), skill.alias("skill_id"), skill.alias("skill_name"), (k % 6).cast("double").alias("assessed_proficiency"))
    talent = s.select(ident, F.when(k % 4 == 0, "Ready now").when(k % 4 == 1, "Ready in 6-12 months").otherwise("No").alias("mobility_readiness"),
                      F.when(k % 3 == 0, "High").when(k % 3 == 1, "Medium").otherwise("Low").alias("retention_risk"))
    q = F.col("p_partkey")
    planned = p.select(F.concat(F.lit("O"), q % 6).alias("office_id"), F.lit("SK001").alias("skill_id"), F.lit(0.5).alias("funding_probability"),
                       F.when(q % 3 == 0, "Approved").when(q % 3 == 1, "Planned").otherwise("Idea").alias("position_status"))
    return workforce.supply(employees, skills, talent, planned)


@query(STAFF + "SELECT * REPLACE (CAST(round(supply_fte, 6) AS DOUBLE) AS supply_fte) FROM supply")
def skill_supply(spark, sf):
    return _supply(spark, sf).select("office_id", "country", "region", "skill_id", "employees_with_skill", F.round("supply_fte", 6).cast("double").alias("supply_fte"),
                                     "ready_now_count", "high_retention_risk_count")


GAP = SIGNALS + ", " + STAFF.strip().removeprefix("WITH ") + """, demand AS (SELECT office_id, country, region, skill_id, skill_name, count(DISTINCT source_id) AS source_count,
  max(CASE urgency WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS u, round(sum(CASE WHEN demand_direction = 'increasing' THEN CAST(confidence AS DECIMAL(8,4)) ELSE 0 END)
   + max(CASE urgency WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 0.5, 2) AS demand_score,
   round(CAST(sum(CAST(confidence AS DECIMAL(8,4))) AS DOUBLE) / count(*), 4) AS avg_confidence FROM sig WHERE NOT negated AND office_id <> '' GROUP BY office_id, country, region, skill_id, skill_name),
s2 AS (SELECT office_id, skill_id, sum(supply_fte) AS supply_fte, sum(ready_now_count) AS ready, sum(high_retention_risk_count) AS risky FROM supply GROUP BY ALL),
g AS (SELECT d.*, round(coalesce(s2.supply_fte, 0), 2) AS supply_fte, coalesce(ready, 0) AS ready, CAST(coalesce(risky, 0) AS BIGINT) AS risky, greatest(demand_score - round(coalesce(s2.supply_fte, 0), 2), 0) AS g FROM demand d LEFT JOIN s2 USING (office_id, skill_id))
SELECT office_id, country, skill_id, CAST(demand_score AS DOUBLE) AS demand_score, CAST(supply_fte AS DOUBLE) AS supply_fte, CAST(g AS DOUBLE) AS gap_value, avg_confidence, CASE WHEN g >= 3 THEN 'Critical' WHEN g >= 1.5 THEN 'High' WHEN g > 0 THEN 'Moderate' ELSE 'Covered' END AS gap_severity,
 CASE u WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS urgency, CASE WHEN regexp_matches(skill_name, 'Climate|Data|Artificial|Digital|Cybersecurity') THEN 'high' WHEN source_count >= 2 THEN 'medium' ELSE 'targeted' END AS strategic_alignment,
 source_count, CASE WHEN g >= 3 AND ready = 0 THEN 'Recruit' WHEN g >= 2 AND ready > 0 THEN 'Mobilize talent' WHEN u = 3 AND g >= 1 THEN 'Temporary surge support' WHEN g > 0 THEN 'Capability development' ELSE 'Monitor' END AS recommended_action,
 '""" + workforce.MODEL_NOTE + """' || risky || '.' AS assumption_or_model_note FROM g"""


@query(GAP)
def workforce_gap(spark, sf):
    accepted = workforce.classify_signals(_signals(spark, sf))[0]
    return workforce.gap(accepted, _supply(spark, sf)).select(
        "office_id", "country", "skill_id", "demand_score", "supply_fte", "gap_value", "gap_severity", "urgency", "strategic_alignment", "source_count",
        "recommended_action", "avg_confidence", "assumption_or_model_note")


# --- case documents: orders rendered as the two forms ----------------------------------------

CASES = """WITH d AS (SELECT 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS document_id, o_orderkey AS k, 'C' || (o_orderkey // 5) AS ref, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE o_orderkey % 5 WHEN 0 THEN 'INITIAL' WHEN 1 THEN 'FOLLOW-UP' WHEN 2 THEN 'INITIAL' WHEN 3 THEN 'FOLLOW-UP' END AS kind, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'cioms' WHEN o_orderkey % 5 IN (2, 3) THEN 'manufacturer' ELSE 'unknown' END AS form,
  (o_orderkey % 5 = 0) AND (o_custkey % 4 = 0) AS lacks, o_custkey FROM orders),
c AS (SELECT *, CASE WHEN form = 'unknown' THEN CASE WHEN o_custkey % 2 = 0 THEN 'unreadable' ELSE 'supporting_document' END WHEN kind = 'FOLLOW-UP' THEN 'follow_up' WHEN lacks THEN 'unreadable' ELSE 'case_report' END AS classification FROM d),
v0 AS (SELECT *, row_number() OVER (PARTITION BY ref, kind ORDER BY CASE WHEN kind = 'INITIAL' THEN '' ELSE day END, document_id) AS n, bool_or(kind = 'INITIAL') OVER (PARTITION BY ref) AS has FROM c WHERE classification IN ('case_report', 'follow_up')),
v AS (SELECT *, CASE WHEN kind = 'FOLLOW-UP' THEN n + 1 WHEN n = 1 THEN 1 END AS version_number FROM v0 WHERE has)
"""


def _case_docs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("C"), F.floor(k / 5))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lacks = (k % 5 == 0) & (F.col("o_custkey") % 4 == 0)
    lines = lambda *xs: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    place = F.concat(F.lit(" Facility "), F.col("o_custkey") % 9)
    cioms = lines(cases.CIOMS_TITLE, "Case reference", ref, F.when(~lacks, F.when(k % 5 == 0, "Report type\nINITIAL").otherwise("Report type\nFOLLOW-UP")),
                  "Date of report", day, "Seriousness", "Serious", "Reaction(s)", "Rash, Fever", "Outcome", "Recovered", "Facility", place, "District", "North",
                  "Narrative: first", "second", "II. SUSPECT PRODUCTS", "No.", "Reported product", "Active ingredient", "Dose", "Route", "Indication",
                  "1", F.concat(F.lit("Product "), k % 6), "Dose", "5 mg", "oral", "pain", "IV. MANUFACTURER")
    maker = lines(F.when(k % 5 == 2, cases.INITIAL_TITLE).otherwise(cases.FOLLOW_UP_TITLE), "Manufacturer case number", ref, "Report date", day, "Source", "Doctor",
                  "Case narrative", "told", "again", "Suspect products", "Product role", "Reported product", "Standard ingredient", "Dose / route",
                  "Suspect", F.concat(F.lit("product "), k % 6, F.lit(" ")), "salt", "1", "Concomitant", "Other", "none", "2", "Reported events", "Reported term", "Category", "Serious", "Outcome",
                  "Nausea", "Gut", "Serious", "Unknown", "Assessment and workflow notes", "end")
    other = F.when(F.col("o_custkey") % 2 == 0, " \n ").otherwise("A letter\nwith lines")
    text = F.when(k % 5 <= 1, cioms).when(k % 5 <= 3, maker).otherwise(other)
    docs = o.select(F.concat(F.lit("D"), F.lpad(k.cast("string"), 9, "0")).alias("document_id"), text.alias("text"))
    return cases.classify_documents(cases.parse_documents(docs))


@query(CASES + """SELECT document_id, form AS document_format, classification, CASE WHEN form = 'unknown' THEN CASE WHEN o_custkey % 2 = 0 THEN 0.0 ELSE 0.3 END
  WHEN kind = 'FOLLOW-UP' THEN 1.0 WHEN lacks THEN 0.4 ELSE 1.0 END AS extraction_confidence, CASE WHEN form <> 'unknown' THEN ref END AS case_reference,
  CASE form WHEN 'cioms' THEN 'first second' WHEN 'manufacturer' THEN 'told again' END AS narrative,
  CAST(CASE form WHEN 'cioms' THEN 2 WHEN 'manufacturer' THEN 1 ELSE 0 END AS INTEGER) AS n_reactions FROM c""")
def document_classification(spark, sf):
    return _case_docs(spark, sf).select("document_id", "document_format", "classification", "extraction_confidence", "case_reference", "narrative",
                                        F.size("reactions").alias("n_reactions"))


@query(CASES + """SELECT document_id, ref AS case_reference, CAST(version_number AS BIGINT) AS version_number, kind AS report_type, day AS report_date,
  CASE form WHEN 'cioms' THEN 'Recovered' ELSE 'Unknown' END AS outcome FROM v WHERE version_number IS NOT NULL""")
def case_versions(spark, sf):
    return cases.case_versions(cases.case_documents(_case_docs(spark, sf))).select(
        "document_id", "case_reference", F.col("version_number").cast("bigint").alias("version_number"), F.upper("report_type").alias("report_type"),
        "report_date", "outcome")


@query(CASES + """SELECT document_id, ref AS case_reference, CASE WHEN version_number IS NULL THEN 'duplicate_of' ELSE 'source_of_version' END AS link_type,
  CASE WHEN version_number IS NULL THEN first_value(document_id) OVER (PARTITION BY ref ORDER BY kind DESC, n) END AS target_document_id FROM v""")
def document_links(spark, sf):
    return cases.document_links(cases.case_documents(_case_docs(spark, sf))).drop("link_id")


@query(CASES + """SELECT ref AS case_reference, document_id, CASE form WHEN 'cioms' THEN 'Product ' || (k % 6) ELSE 'product ' || (k % 6) END AS reported_product,
  CASE form WHEN 'cioms' THEN 'Dose' ELSE 'salt' END AS active_ingredient FROM v WHERE version_number IS NOT NULL""")
def case_child_rows(spark, sf):
    versions = cases.case_versions(cases.case_documents(_case_docs(spark, sf)))
    return cases.case_products(versions).select("case_reference", "document_id", "reported_product", "active_ingredient")


@query(CASES + """SELECT ref AS case_reference, min(CASE WHEN version_number = 1 THEN day END) AS first_report_date, arg_max(day, version_number) AS latest_report_date,
  count(version_number) AS version_count, count(*) FILTER (version_number IS NULL) AS duplicate_document_count,
  arg_max(CASE form WHEN 'cioms' THEN 'Recovered' ELSE 'Unknown' END, version_number) AS current_outcome FROM v GROUP BY ref""")
def case_summary(spark, sf):
    return cases.case_summary(cases.case_documents(_case_docs(spark, sf))).drop("latest_case_version_id", "current_seriousness")


@query(CASES + """SELECT document_id, CASE WHEN classification IN ('case_report', 'follow_up') THEN ref END AS case_reference, reason_code FROM (SELECT *, CASE classification
  WHEN 'unreadable' THEN 'unreadable_no_text_or_low_confidence' WHEN 'supporting_document' THEN 'non_case_supporting_document' ELSE
  CASE WHEN NOT bool_or(kind = 'INITIAL' AND classification IN ('case_report', 'follow_up')) OVER (PARTITION BY CASE WHEN form <> 'unknown' THEN ref END) THEN 'follow_up_without_initial' END END AS reason_code FROM c)
  WHERE reason_code IS NOT NULL""")
def review_queue(spark, sf):
    return cases.review_queue(_case_docs(spark, sf)).select("document_id", "case_reference", "reason_code")


def _mapped_cases(spark, sf):
    versions = cases.case_versions(cases.case_documents(_case_docs(spark, sf)))
    products = spark.range(4).select(F.concat(F.lit("PR"), "id").alias("product_id"), F.concat(F.lit("PRODUCT "), "id").alias("standard_product_name"),
                                     F.when(F.col("id") == 3, " Product 4").alias("example_brand"))
    reactions = spark.createDataFrame([("R1", "rash"), ("R2", "NAUSEA ")], "reaction_id string, preferred_term string")
    places = spark.range(7).select(F.concat(F.lit("F"), "id").alias("facility_id"), F.concat(F.lit("facility "), "id").alias("facility_name"))
    areas = spark.createDataFrame([("X1", "South")], "district_id string, district_name string")
    p = cases.map_products(cases.case_products(versions), products)
    r = cases.mapped_to(cases.case_reactions(versions), "reaction_term", reactions, "preferred_term", "reaction_id", "standard_reaction_id")
    v = cases.mapped_to(versions, "facility", places, "facility_name", "facility_id", "facility_id")
    v = cases.mapped_to(v, "district", areas, "district_name", "district_id", "district_id")
    return p, r, v


@query(CASES + """, w AS (SELECT * FROM v WHERE version_number IS NOT NULL)
SELECT 'unmapped_product' AS exception_type, count(*) AS n_rows FROM w WHERE k % 6 = 5 HAVING count(*) > 0
UNION ALL SELECT 'unmapped_reaction', count(*) FROM w WHERE form = 'cioms' HAVING count(*) > 0
UNION ALL SELECT 'unmapped_facility', count(*) FROM w WHERE form = 'cioms' AND o_custkey % 9 > 6 HAVING count(*) > 0
UNION ALL SELECT 'unmapped_district', count(*) FROM w WHERE form = 'cioms' HAVING count(*) > 0""")
def reference_exceptions(spark, sf):
    return cases.mapping_exceptions(*_mapped_cases(spark, sf)).groupBy("exception_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query(CASES + """SELECT count(*) AS accepted_versions, CAST(0 AS BIGINT) AS quarantined_versions FROM v WHERE version_number IS NOT NULL""")
def case_version_quality(spark, sf):
    accepted, rejected = cases.check_versions(cases.case_versions(cases.case_documents(_case_docs(spark, sf))))
    return accepted.agg(F.count(F.lit(1)).alias("accepted_versions")).crossJoin(rejected.agg(F.count(F.lit(1)).alias("quarantined_versions")))


@query(CASES + """SELECT classification, count(*) AS document_count, (SELECT count(*) FROM v WHERE version_number IS NOT NULL) AS version_count FROM c GROUP BY classification""")
def pipeline_health(spark, sf):
    docs = _case_docs(spark, sf)
    versions = cases.case_versions(cases.case_documents(docs))
    return cases.pipeline_health(docs, versions, cases.review_queue(docs)).select("classification", "document_count", "version_count")


@query("""WITH n AS (SELECT c_mktsegment AS district, 'S' || (c_custkey % 2) AS seriousness, CASE WHEN c_custkey % 3 > 0 THEN 'FOLLOW-UP' ELSE 'INITIAL' END AS report_status,
  'N' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS dup FROM customer
 UNION ALL SELECT o_orderpriority, 'S' || (o_orderkey % 2), CASE WHEN o_orderkey % 3 = 0 THEN 'FOLLOW-UP' ELSE 'INITIAL' END, 'O' || (o_orderkey // 2), CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END FROM orders WHERE o_orderstatus = 'F')
SELECT district, seriousness, report_status, count(DISTINCT id) AS case_count, CAST(sum(dup) AS BIGINT) AS duplicate_count FROM n GROUP BY ALL""")
def case_overview(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k, q = F.col("c_custkey"), F.col("o_orderkey")
    flag = lambda test: F.when(test, "True").otherwise("False")
    new = c.select(F.concat(F.lit("N"), k).alias("case_reference"), F.col("c_mktsegment").alias("district"), F.concat(F.lit("S"), k % 2).alias("current_seriousness"),
                   (k % 3 + 1).alias("version_count"), F.when(k % 4 == 0, 2).otherwise(0).alias("duplicate_document_count"))
    old = o.select(F.concat(F.lit("O"), F.floor(q / 2)).alias("case_id"), F.col("o_orderpriority").alias("district"), F.concat(F.lit("S"), q % 2).alias("seriousness"),
                   flag(q % 3 == 0).alias("follow_up_flag"), flag(q % 5 == 0).alias("duplicate_flag"),
                   F.when(F.col("o_orderstatus") == "F", "READY_FOR_DASHBOARD").otherwise("PENDING").alias("processing_status"))
    return cases.case_overview(new, old)


HISTORICAL = """WITH h AS (SELECT 'H' || (o_orderkey // 3) AS case_id, 'Product ' || (o_custkey % 5) AS standard_product_name, 'ingredient ' || (o_custkey % 5 % 3) AS active_ingredient,
  'class ' || (o_custkey % 5 % 2) AS product_class, 'reaction ' || (o_orderkey % 7) AS reaction_term, CASE WHEN o_orderkey % 7 < 3 THEN 'skin' ELSE 'other' END AS reaction_category,
  CASE WHEN o_orderstatus = 'F' THEN 'Serious' ELSE 'Non-serious' END AS seriousness, 'D' || (o_custkey % 4) AS district, 'R' || (o_custkey % 4 % 2) AS region,
  'Clinic ' || (o_custkey % 4) AS facility_name, 'clinic' AS facility_type, o_orderpriority AS report_source, CASE WHEN o_custkey % 2 = 0 THEN 'nurse' ELSE 'doctor' END AS reporter_type,
  CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE CAST(o_orderkey % 30 AS VARCHAR) END AS days_to_report, CAST((o_orderkey % 5) * 0.25 AS VARCHAR) AS completeness_score,
  CAST((o_orderkey % 3) * 0.5 AS VARCHAR) AS extraction_confidence FROM orders WHERE o_orderkey % 10 <> 0)
"""


def _historical(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda text, n: F.concat(F.lit(text), n.cast("string"))
    return table(spark, sf, "orders").select(
        name("H", F.floor(k / 3)).alias("case_id"), name("Product ", c % 5).alias("standard_product_name"),
        name("ingredient ", c % 5 % 3).alias("active_ingredient"), name("class ", c % 5 % 2).alias("product_class"),
        name("reaction ", k % 7).alias("reaction_term"), F.when(k % 7 < 3, "skin").otherwise("other").alias("reaction_category"),
        F.when(F.col("o_orderstatus") == "F", "Serious").otherwise("Non-serious").alias("seriousness"),
        name("D", c % 4).alias("district"), name("R", c % 4 % 2).alias("region"), name("Clinic ", c % 4).alias("facility_name"),
        F.lit("clinic").alias("facility_type"), F.col("o_orderpriority").alias("report_source"),
        F.when(c % 2 == 0, "nurse").otherwise("doctor").alias("reporter_type"),
        F.when(k % 6 == 0, "unknown").otherwise((k % 30).cast("string")).alias("days_to_report"),
        (k % 5 * 0.25).cast("string").alias("completeness_score"), (k % 3 * 0.5).cast("string").alias("extraction_confidence"),
        F.when(k % 10 == 0, "HELD").otherwise("READY_FOR_DASHBOARD").alias("processing_status"))


@query(HISTORICAL + """SELECT standard_product_name, active_ingredient, product_class, reaction_term, reaction_category, count(DISTINCT case_id) AS distinct_case_count,
  count(*) FILTER (seriousness = 'Serious') AS serious_event_count FROM h GROUP BY ALL""")
def product_reactions(spark, sf):
    return cases.product_reactions(_historical(spark, sf))


@query(HISTORICAL + """SELECT district, region, facility_name, facility_type, report_source, reporter_type, count(DISTINCT case_id) AS distinct_case_count,
  round(avg(TRY_CAST(days_to_report AS DOUBLE)), 6) AS avg_days_to_report, round(avg(TRY_CAST(completeness_score AS DOUBLE)), 6) AS avg_completeness_score,
  round(avg(TRY_CAST(extraction_confidence AS DOUBLE)), 6) AS avg_extraction_confidence FROM h GROUP BY ALL""")
def facility_reporting(spark, sf):
    found = cases.facility_reporting(_historical(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith("avg_")})



# --- governance ----------------------------------------------------------------------------------

@query("""WITH k AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
SELECT count(*) AS row_count, count(DISTINCT k) AS distinct_keys, count(*) FILTER (k IS NULL) AS null_keys, count(*) FILTER (k IS NULL) AS nulls_k,
  greatest(count(*) - count(*) FILTER (k IS NULL) - count(DISTINCT k), 0) AS duplicate_keys FROM k""")
def quality_profile(spark, sf):
    k = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("k"))
    return profile.profile(k, ["k"])


@query("""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (n > 1) AS duplicate_keys FROM (
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def duplicate_key_audit(spark, sf):
    return checks.key_audit(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return checks.unique(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY ALL")
def accepted_values_violations(spark, sf):
    return checks.accepted_values(table(spark, sf, "orders"), "o_orderstatus", ["O", "F"])


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def negative_balance_violations(spark, sf):
    return checks.expression(table(spark, sf, "customer"), "c_acctbal >= 0").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NULLIF(c_custkey % 9, 0) IS NULL")
def not_null_violations(spark, sf):
    k = table(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_custkey") % 9, F.lit(0)).alias("k"))
    return checks.not_null(k, "k").select("c_custkey")


def _disagree(where: str) -> str:
    return DAILY + f""", l AS (SELECT country, {_sum("total_revenue")} AS left_total FROM daily GROUP BY country),
r AS (SELECT country, {M} AS right_total FROM sales {where} GROUP BY country)
SELECT country, left_total, right_total FROM l FULL JOIN r USING (country) WHERE abs(coalesce(left_total, 0) - coalesce(right_total, 0)) > 1.0"""


def _country_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(retail.money(F.sum(retail.exact("total_revenue"))).alias("total_revenue"))


@query(_disagree(""))
def revenue_consistency(spark, sf):
    sales = _sales(spark, sf)
    return checks.totals_agree(_country_totals(retail.daily_revenue(sales)), retail.franchise_ranking(sales), "country", "total_revenue",
                               "total_revenue", tolerance=1.0)


@query(_disagree("WHERE franchiseID % 7 <> 0 OR country = 'NATION_3'"))
def revenue_disagreements(spark, sf):
    sales = _sales(spark, sf)
    kept = sales.where("franchiseID % 7 <> 0 OR country = 'NATION_3'")
    found = checks.totals_agree(_country_totals(retail.daily_revenue(sales)), retail.franchise_ranking(kept), "country", "total_revenue",
                                "total_revenue", tolerance=1.0)
    return found.withColumns({c: F.round(c, 2) for c in ("left_total", "right_total")})


@query(PRODUCTS + "SELECT abs(sum(revenue_share) - 1) < 0.01 AS sums_to_one FROM products")
def revenue_share_total(spark, sf):
    return retail.product_performance(_sales(spark, sf)).agg((F.abs(F.sum("revenue_share") - 1) < 0.01).alias("sums_to_one"))


@query(SEGMENTS + """SELECT customerID FROM seg WHERE spend_tier <> CASE WHEN total_spend >= 500 THEN 'High' WHEN total_spend >= 200 THEN 'Medium' ELSE 'Low' END""")
def tier_threshold_violations(spark, sf):
    seg = retail.customer_segments(_sales(spark, sf))
    return checks.expression(seg, "spend_tier = CASE WHEN total_spend >= 500 THEN 'High' WHEN total_spend >= 200 THEN 'Medium' ELSE 'Low' END").select("customerID")


@query("""SELECT 'lineitem' AS source, CAST(l_orderkey AS VARCHAR) AS record_id, l_extendedprice AS amount FROM lineitem WHERE l_extendedprice < 1000
UNION ALL SELECT 'customer', c_name, c_acctbal FROM customer WHERE c_acctbal < 0""")
def low_amount_union(spark, sf):
    li = checks.expression(table(spark, sf, "lineitem"), "l_extendedprice >= 1000").select(
        F.lit("lineitem").alias("source"), F.col("l_orderkey").cast("string").alias("record_id"), F.col("l_extendedprice").alias("amount"))
    return li.unionByName(checks.expression(table(spark, sf, "customer"), "c_acctbal >= 0").select(
        F.lit("customer").alias("source"), F.col("c_name").alias("record_id"), F.col("c_acctbal").alias("amount")))


@query("SELECT count(*) AS n_common FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def intersection_count(spark, sf):
    o = table(spark, sf, "orders")
    ids = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    return ids("F").join(ids("O"), "o_custkey").agg(F.count(F.lit(1)).alias("n_common"))


# --- streams ---------------------------------------------------------------------------------------

@query("""SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS hour_start, event_type, count(*) AS n_events,
  CAST(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,2)) AS DOUBLE) AS total FROM events GROUP BY 1, 2""", dates=("hour_start",))
def stream_hourly_counts(spark, sf):
    from quarrystone.streaming import ingest

    events = _events_stream(spark, sf)
    out = ingest.collect_available(ingest.hourly_counts(events), f"hourly_{_stream_name()}")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "event_type", "n_events",
                      F.col("total").cast("decimal(18,2)").cast("double").alias("total"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_latest_recompute(spark, sf):
    """Bronze by a stream, silver recomputed from it as a batch."""
    import tempfile

    from quarrystone.streaming import ingest

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quarrystone-stream-")
    folder = f"{base.rstrip('/')}/quarrystone/{_stream_name()}"
    ingest.append_available(_events_stream(spark, sf), f"{folder}/progress", f"{folder}/bronze")
    bronze = spark.read.parquet(f"{folder}/bronze")
    return dedupe.latest(bronze, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def _stream_name() -> str:
    import uuid

    return "s" + uuid.uuid4().hex


def _events_stream(spark, sf) -> DataFrame:
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")
