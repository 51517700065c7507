"""Quotations: totals, dashboard, rankings, listings, merged lines and billing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.running import running_start
from priceatlas.functions.text import round2, round2_sql
from priceatlas.plans.entities import ITEMS_SQL, QUOTATIONS_SQL, quotation_items, quotations, table


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quotation: subtotal, discount, taxable, gst, freight and grand total, each rounded after unrounded arithmetic."""
    lines = quotation_items(spark, sf_dir).groupBy(F.col("quotation_id").alias("id")).agg(F.sum("amount").alias("sum"), F.count(F.lit(1)).alias("line_count"))
    q = quotations(spark, sf_dir).join(lines, "id", "left")
    s = F.coalesce(F.col("sum").cast("double"), F.lit(0.0))
    discount = s * F.col("discount_pct") / 100.0
    taxable = s - discount
    gst = taxable * F.col("gst_pct") / 100.0
    return q.select("id", "customer", "status", "updated_at", F.coalesce("line_count", F.lit(0)).alias("line_count"), round2(s).alias("subtotal"), round2(discount).alias("discount"), round2(taxable).alias("taxable"), round2(gst).alias("gst"), F.col("freight").cast("double").alias("freight"), round2(taxable + gst + F.col("freight")).alias("grand_total"))


_T = f"""WITH q AS ({QUOTATIONS_SQL}), i AS ({ITEMS_SQL}), l AS (SELECT quotation_id, sum(amount) AS s, count(*) AS n FROM i GROUP BY 1),
u AS (SELECT q.*, coalesce(CAST(s AS DOUBLE), 0) AS s, coalesce(n, 0) AS line_count FROM q LEFT JOIN l ON id = quotation_id),
v AS (SELECT *, s * discount_pct / 100.0::DOUBLE AS d, s - s * discount_pct / 100.0::DOUBLE AS tax, (s - s * discount_pct / 100.0::DOUBLE) * gst_pct / 100.0::DOUBLE AS g FROM u),
t AS (SELECT id, customer, status, updated_at, line_count, {round2_sql('s')} AS subtotal, {round2_sql('d')} AS discount, {round2_sql('tax')} AS taxable, {round2_sql('g')} AS gst, CAST(freight AS DOUBLE) AS freight, {round2_sql('tax + g + freight')} AS grand_total FROM v)"""


def money(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def _money(e: str) -> str:
    return f"CAST(coalesce(sum(CAST({e} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: potential by status (draft: all that is neither sent nor archived), counts and the average."""
    t, g = totals(spark, sf_dir), F.col("grand_total")
    sums = t.agg(
        money(g).alias("potential"), money(F.when(~F.col("status").isin("sent", "archived"), g)).alias("draft"), money(F.when(F.col("status") == "sent", g)).alias("sent"),
        money(F.when(F.col("status") == "archived", g)).alias("archived"), F.count(F.lit(1)).alias("quote_count"), F.sum("line_count").alias("line_count"),
    )
    return sums.withColumn("average_potential", round2(F.col("potential") / F.greatest(F.col("quote_count"), F.lit(1))))


DASHBOARD_SQL = f"""{_T}, s AS (SELECT {_money('grand_total')} AS potential, {_money("CASE WHEN status NOT IN ('sent', 'archived') THEN grand_total END")} AS draft, {_money("CASE WHEN status = 'sent' THEN grand_total END")} AS sent,
{_money("CASE WHEN status = 'archived' THEN grand_total END")} AS archived, count(*) AS quote_count, CAST(sum(line_count) AS BIGINT) AS line_count FROM t)
SELECT *, {round2_sql('potential / greatest(quote_count, 1)')} AS average_potential FROM s"""


def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("count"), money(F.col("grand_total")).alias("value"))


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five with the highest value; then count, then name."""
    found = totals(spark, sf_dir).groupBy("customer").agg(F.count(F.lit(1)).alias("count"), money(F.col("grand_total")).alias("value"))
    return found.orderBy(F.desc("value"), F.desc("count"), "customer").limit(5)


def top_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vendors with the highest line value, before discount, tax and freight."""
    found = quotation_items(spark, sf_dir).groupBy("vendor").agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("v"))
    return found.select("vendor", "count", round2(F.col("v").cast("double")).alias("value")).orderBy(F.desc("value"), F.desc("count"), "vendor").limit(5)


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight quotations updated last."""
    return totals(spark, sf_dir).orderBy(F.desc("updated_at"), "id").limit(8).select("id", "customer", "status", "grand_total", "line_count")


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a quotation with the same part and vendor merge: quantities add up, the first line number and its price stay; lines are numbered anew."""
    w = Window.partitionBy("quotation_id", "part", "vendor")
    first = F.row_number().over(w.orderBy("line_no", "qty", "unit_price"))
    items = quotation_items(spark, sf_dir).withColumn("first", first).withColumn("all_qty", F.sum("qty").over(w)).withColumn("merged", F.count(F.lit(1)).over(w)).where("first = 1")
    again = F.row_number().over(Window.partitionBy("quotation_id").orderBy("line_no", "part", "vendor"))
    return items.select("quotation_id", again.alias("line_no"), "part", "vendor", F.col("all_qty").cast("double").alias("qty"), F.col("unit_price").cast("double").alias("unit_price"), "merged")


MERGED_SQL = f"""WITH i AS ({ITEMS_SQL}), m AS (SELECT *, row_number() OVER (PARTITION BY quotation_id, part, vendor ORDER BY line_no, qty, unit_price) AS first, sum(qty) OVER w AS all_qty, count(*) OVER w AS merged
FROM i WINDOW w AS (PARTITION BY quotation_id, part, vendor))
SELECT quotation_id, CAST(row_number() OVER (PARTITION BY quotation_id ORDER BY line_no, part, vendor) AS INTEGER) AS line_no, part, vendor, CAST(all_qty AS DOUBLE) AS qty, CAST(unit_price AS DOUBLE) AS unit_price, merged FROM m WHERE first = 1"""


# The price per page, the mark-up, the monthly budget, and what is already reconciled for a month.
PAGE_PRICE, MARK_UP, BUDGET, RECONCILED_PAGES, RECONCILED_REQUESTS, RECONCILED_BASE = 0.48909, 0.25, 1500.0, 1100, 162, 538.0
#: Characters of a page of text.
PAGE_CHARS = 3000


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by source of documents: pages, requests, base cost with the reconciled floor, mark-up, balance of one month's budget."""
    pages = F.ceil(F.coalesce(F.col("n_chars"), F.lit(0)) / PAGE_CHARS)
    used = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(pages).alias("p"), F.count(F.lit(1)).alias("r"))
    base = F.greatest(round2(F.col("p") * PAGE_PRICE), F.lit(RECONCILED_BASE))
    spend = round2(base * (1 + MARK_UP))
    return used.select("source", F.greatest("p", F.lit(RECONCILED_PAGES)).cast("long").alias("pages"), F.greatest("r", F.lit(RECONCILED_REQUESTS)).cast("long").alias("requests"), base.alias("base_cost"), spend.alias("spend"), round2(F.lit(BUDGET) - spend).alias("balance"), (spend >= BUDGET).alias("blocked"), F.least(F.lit(100), F.floor(100 * spend / BUDGET + 0.5)).cast("int").alias("percent"))


BILLING_SQL = f"""WITH u AS (SELECT source, sum(ceil(coalesce(n_chars, 0) / {PAGE_CHARS}.0)) AS p, count(*) AS r FROM documents GROUP BY 1),
b AS (SELECT *, greatest({round2_sql(f'p * {PAGE_PRICE}::DOUBLE')}, {RECONCILED_BASE}::DOUBLE) AS base FROM u), s AS (SELECT *, {round2_sql(f'base * {1 + MARK_UP}::DOUBLE')} AS spend FROM b)
SELECT source, CAST(greatest(p, {RECONCILED_PAGES}) AS BIGINT) AS pages, CAST(greatest(r, {RECONCILED_REQUESTS}) AS BIGINT) AS requests, base AS base_cost, spend, {round2_sql(f'{BUDGET}::DOUBLE - spend')} AS balance, spend >= {BUDGET} AS blocked,
CAST(least(100, floor(100 * spend / {BUDGET}::DOUBLE + 0.5)) AS INTEGER) AS percent FROM s"""


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with their number of messages by role."""
    roles = {"user": "user_messages", "assistant": "assistant_messages"}
    counts = [F.count(F.when(F.col("role") == r, 1)).alias(n) for r, n in roles.items()]
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), *counts)


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and nearest-rank 95th percentile of value by event type (exact, not interpolated)."""
    return latency_of(table(spark, sf_dir, "events"))


#: Equal parts of the range of values; each is sorted by itself.
PARTS = 1 << 20


def latency_of(events: DataFrame) -> DataFrame:
    """Counts by value, running sums over parts of the range, and the first value whose running count reaches the rank: no task sorts a whole type."""
    key = F.coalesce(F.concat(F.lit("="), "event_type"), F.lit(""))  # joins would lose a null type
    e = events.where("value is not null").select(key.alias("k"), "value")
    counts = e.groupBy("k", "value").agg(F.count(F.lit(1)).alias("c"))
    v = F.col("value").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    ends = counts.agg(F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi")).first()
    lo, width = ends.lo or 0.0, max((ends.hi or 0.0) - (ends.lo or 0.0), 1e-300)
    part = F.when(finite, F.floor((v - lo) / width * (PARTS - 1))).when(v < 0, F.lit(-1)).otherwise(F.lit(PARTS)).cast("long")
    counts = counts.withColumn("part", part)
    starts = running_start(counts.groupBy("k", "part").agg(F.sum("c").alias("c")), ["k"], "part", "c", "start").drop("c")
    sizes = e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), round2((F.sum(F.col("value").cast("decimal(18,4)")) / F.count(F.lit(1))).cast("double")).alias("average"))
    reached = F.col("start") + F.sum("c").over(Window.partitionBy("k", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    summed = counts.join(starts, ["k", "part"]).select("k", "value", reached.alias("reached"))
    at = summed.join(sizes, "k").where(F.col("reached") >= F.ceil(F.col("n") * 0.95))
    found = at.groupBy("k").agg(F.max("n").alias("n"), F.min("value").alias("p95"), F.max("average").alias("average"))
    return found.select(F.when(F.col("k") != "", F.expr("substr(k, 2)")).alias("event_type"), "n", "p95", "average")


QUERIES = {
    "quote_totals": totals, "sales_dashboard_totals": dashboard, "status_summary": by_status, "top_customers": top_customers, "top_vendors": top_vendors, "recent_quotes": recent,
    "line_merge_on_duplicate": merged_lines, "billing_usage": billing, "child_count_messages": message_counts, "latency_nearest_rank_p95": latency,
}
SQL = {
    "quote_totals": f"{_T} SELECT * FROM t",
    "sales_dashboard_totals": DASHBOARD_SQL,
    "status_summary": f"{_T} SELECT status, count(*) AS count, {_money('grand_total')} AS value FROM t GROUP BY 1",
    "top_customers": f"{_T} SELECT customer, count(*) AS count, {_money('grand_total')} AS value FROM t GROUP BY 1 ORDER BY value DESC, count DESC, customer LIMIT 5",
    "top_vendors": f"WITH i AS ({ITEMS_SQL}) SELECT vendor, count(*) AS count, {round2_sql('CAST(sum(amount) AS DOUBLE)')} AS value FROM i GROUP BY 1 ORDER BY value DESC, count DESC, vendor LIMIT 5",
    "recent_quotes": f"{_T} SELECT id, customer, status, grand_total, line_count FROM t ORDER BY updated_at DESC, id LIMIT 8",
    "line_merge_on_duplicate": MERGED_SQL,
    "billing_usage": BILLING_SQL,
    "child_count_messages": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages FROM conversations GROUP BY 1",
    "latency_nearest_rank_p95": f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN r = ceil(n * 0.95::DOUBLE) THEN value END) AS p95, {round2_sql('CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*)')} AS average FROM r GROUP BY 1""",
}
