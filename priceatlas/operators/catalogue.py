"""Catalogue upkeep: exports, line numbering, parser comparison, carried sections, latest settings, audits, months and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.text import format_inr, format_inr_sql, slug, slug_sql
from priceatlas.operators.quotes import money
from priceatlas.plans.entities import ITEMS_SQL, PRICE_RECORDS_SQL, QUOTATIONS_SQL, price_records, quotation_items, quotations, table

#: The day that ages are counted from, and the days over which the boost of a recent document runs out.
AS_OF, FADES = "1998-08-02", 730
#: Size that the attribute search asks for.
ASKED_SIZE = 7


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text export per quotation: file name, lines by number (equal numbers: by text), and the total of its lines in rupees; quotations without lines have an empty body."""
    i = quotation_items(spark, sf_dir)
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("part").cast("string"), F.lit(" x "), F.col("qty").cast("int").cast("string"), F.lit(" "), F.col("vendor"))
    lines = i.groupBy(F.col("quotation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"), F.sum("amount").alias("amount"))
    q = quotations(spark, sf_dir).join(lines, "id", "left")
    name = F.concat(slug(F.col("customer")), F.lit("-"), F.col("id").cast("string"), F.lit(".txt"))
    return q.select("id", name.alias("filename"), F.coalesce(F.array_join("lines.line", "\n"), F.lit("")).alias("body"), format_inr(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))).alias("total"))


EXPORT_SQL = f"""WITH q AS ({QUOTATIONS_SQL}), i AS ({ITEMS_SQL}),
x AS (SELECT *, line_no || '. ' || part || ' x ' || CAST(qty AS INTEGER) || ' ' || vendor AS line FROM i),
l AS (SELECT quotation_id, string_agg(line, chr(10) ORDER BY line_no, line) AS body, sum(amount) AS amount FROM x GROUP BY 1)
SELECT id, {slug_sql('customer')} || '-' || id || '.txt' AS filename, coalesce(body, '') AS body, {format_inr_sql('coalesce(CAST(amount AS DOUBLE), 0)')} AS total FROM q LEFT JOIN l ON id = quotation_id"""


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts asked for (open lines) that a quotation does not hold yet (closed lines), once each, numbered on from its last line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quotation_id"), F.col("l_partkey").alias("part"), "l_linenumber", "l_linestatus")
    held = lines.where("l_linestatus = 'F'")
    new = lines.where("l_linestatus = 'O'").select("quotation_id", "part").distinct().join(held, ["quotation_id", "part"], "left_anti")
    last = held.groupBy("quotation_id").agg(F.max("l_linenumber").alias("last"))
    number = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("quotation_id").orderBy("part"))
    return new.join(last, "quotation_id", "left").select("quotation_id", "part", number.cast("int").alias("line_no"))


ADDED_SQL = """WITH h AS (SELECT l_orderkey AS quotation_id, l_partkey AS part, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT DISTINCT l_orderkey AS quotation_id, l_partkey AS part FROM lineitem x WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM h WHERE h.quotation_id = x.l_orderkey AND h.part = x.l_partkey)),
m AS (SELECT quotation_id, max(l_linenumber) AS last FROM h GROUP BY 1)
SELECT quotation_id, part, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY quotation_id ORDER BY part) AS INTEGER) AS line_no FROM n LEFT JOIN m USING (quotation_id)"""


def parser_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of one catalogue (by return flag): keys (part, vendor) of each, how many another one also has, and how many no other has."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.collect_set("l_returnflag").alias("runs"))
    each = seen.select(F.explode("runs").alias("run"), F.size("runs").alias("n"))
    return each.groupBy("run").agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("shared"), F.count(F.when(F.col("n") == 1, 1)).alias("only_here"))


COMPARE_SQL = """WITH k AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag AS run FROM lineitem), n AS (SELECT run, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM k)
SELECT run, count(*) AS keys, count(*) FILTER (n > 1) AS shared, count(*) FILTER (n = 1) AS only_here FROM n GROUP BY 1"""


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quotation, the customer's latest sent quotation up to it (a section title carried forward); null before the first."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    sent = F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), ignorenulls=True).over(w)
    return o.select(F.col("o_orderkey").alias("id"), sent.alias("last_sent"))


def latest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by owner: of all events of a user, the last one (by time, then id) is the setting that stays."""
    newest = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    found = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(newest, F.count(F.lit(1)).alias("writes"))
    return found.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("setting"), "writes")


def _audit(spark: SparkSession, sf_dir: str, check: str, left: str, key: str, right: str, other: str) -> DataFrame:
    rows = table(spark, sf_dir, left).select(key)
    known = table(spark, sf_dir, right).select(F.col(other).alias(key), F.lit(1).alias("__known")).distinct()
    counts = rows.join(known, key, "left").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("__known").isNull(), 1)).alias("missing"))
    return counts.select(F.lit(check).alias("audit"), F.col("rows").alias("n_rows"), "missing")


#: (check, table, key, table that should know the key, its key)
AUDITS = [
    ("customers without quotations", "customer", "c_custkey", "orders", "o_custkey"),
    ("quotations without lines", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("parts never quoted", "part", "p_partkey", "lineitem", "l_partkey"),
    ("documents without labels", "documents", "doc_id", "labels", "doc_id"),
]


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per check: rows looked at, and those with no counterpart."""
    first, *rest = [_audit(spark, sf_dir, *a) for a in AUDITS]
    for r in rest:
        first = first.unionByName(r)
    return first


AUDIT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS audit, count(*) AS n_rows, count(*) FILTER (k IS NULL) AS missing FROM {t} LEFT JOIN (SELECT DISTINCT {o} AS k FROM {r}) ON {k_} = k" for c, t, k_, r, o in AUDITS)


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations and their value by billing month (UTC)."""
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")
    return table(spark, sf_dir, "orders").groupBy(month).agg(F.count(F.lit(1)).alias("count"), money(F.col("o_totalprice")).alias("value"))


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost of recent quotations: 1 on the day AS_OF and after it, falling to 0 over FADES days."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(AS_OF), F.col("o_orderdate")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(FADES))).alias("boost"))


def has_attribute(attributes: Column, name: str, values: list[str], unit: str | None) -> Column:
    """Whether an attribute list holds one of the spellings of a value, with the unit if one is asked for."""
    return F.exists(attributes, lambda a: (a["name"] == name) & a["value"].isin(values) & (F.lit(unit is None) | (a["unit"] == F.lit(unit))))


def by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price records whose attributes hold the asked size in millimetres, however it is written."""
    size = F.struct(F.lit("size").alias("name"), F.col("size").cast("string").alias("value"), F.lit("mm").alias("unit"))
    brand = F.struct(F.lit("brand").alias("name"), F.col("sku").alias("value"), F.lit(None).cast("string").alias("unit"))
    found = price_records(spark, sf_dir).withColumn("attributes", F.array(size, brand))
    return found.where(has_attribute(F.col("attributes"), "size", [str(ASKED_SIZE), f"{ASKED_SIZE:.2f}"], "mm")).select("id", "product", format_inr(F.col("price")).alias("price"))


QUERIES = {
    "quotation_export": exported, "next_line_numbers": added_lines, "parser_overlap": parser_comparison, "section_carry_forward": carried, "settings_upsert": latest_settings,
    "readiness_audit": readiness, "billing_months": months, "recency_boost": recency, "attribute_containment": by_attribute,
}
SQL = {
    "quotation_export": EXPORT_SQL,
    "next_line_numbers": ADDED_SQL,
    "parser_overlap": COMPARE_SQL,
    "section_carry_forward": "SELECT o_orderkey AS id, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_sent FROM orders",
    "settings_upsert": "SELECT user_id, event_id, event_type AS setting, writes FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS writes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1",
    "readiness_audit": AUDIT_SQL,
    "billing_months": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS value FROM orders GROUP BY 1",
    "recency_boost": f"SELECT o_orderkey AS id, greatest(0::DOUBLE, 1::DOUBLE - greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')) / {FADES}::DOUBLE) AS boost FROM orders",
    "attribute_containment": f"WITH p AS ({PRICE_RECORDS_SQL}) SELECT id, product, {format_inr_sql('price')} AS price FROM p WHERE CAST(size AS VARCHAR) IN ('{ASKED_SIZE}', '{ASKED_SIZE:.2f}')",
}
