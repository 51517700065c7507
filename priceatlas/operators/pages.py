"""The page of each HTML table in a document's text: an as-of join of tables to the nearest page marker before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.once import bound, with_once
from priceatlas.operators.ingest import _L, lists

# A table with what stands before it (\G: right after the last one, so that a text without further tables is looked through once), a page number and a page's body in the text, and how far back, in characters, a page number may begin.
UP_TO_TABLE = r"(?is)\G.*?<table.*?</table>"
NUMBER = r'(?is)^(.*)class="page-number"[^>]*>\s*(\d+)\s*<'
BODY = r"""(?i)class=["'][^"']*(?<![A-Za-z0-9_])page-body-container(?![A-Za-z0-9_])[^"']*["']"""
NEAR = 5000


def table_pages(docs: DataFrame) -> DataFrame:
    """id, table_no (from 0), page, html: the tables of (id, text) with their pages.

    The page is the last page number that begins within NEAR characters before the table, else the number of page bodies before it, else null. A text is cut
    into tables and what stands between them; offsets and markers run on over these pieces, so no table looks through the text before it again.
    Texts without tables, null ones among them, give nothing. Texts of one id are documents of their own if they differ; repeated rows count once.
    """
    # a row holds a table and what stands before it; the text is cut in one pass, and texts themselves go neither through a hash table nor through a sort
    cut = docs.where("text is not null").select("id", F.xxhash64("text").alias("doc"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(UP_TO_TABLE), F.lit(0))).alias("n", "piece"))
    pieces = with_once(cut.where("piece is not null"), {"b_size": F.regexp_instr("piece", F.lit("(?i)<table")) - 1})
    pieces = with_once(pieces, {"p": F.struct(F.substring("piece", F.lit(1), F.col("b_size")).alias("b"), F.substring("piece", F.col("b_size") + 1, F.length("piece")).alias("t"))})
    pieces = with_once(pieces, {"t_size": F.length("p.t"), "told": F.struct(_signs(F.col("p.b")).alias("b"), _signs(F.col("p.t")).alias("t"))})
    pieces = pieces.select("id", "doc", "n", "b_size", "t_size", "told", F.col("p.t").alias("html")).dropDuplicates(["id", "doc", "n"])
    before = Window.partitionBy("id", "doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("row_start", F.coalesce(F.sum(F.col("b_size") + F.col("t_size")).over(before), F.lit(0).cast("long"))).withColumn("start", F.col("row_start") + F.col("b_size"))

    def marker(side: str, start: str) -> Column:
        return F.when(F.col(f"told.{side}.at").isNotNull(), F.struct((F.col(start) + F.col(f"told.{side}.at")).alias("at"), F.col(f"told.{side}.page").alias("page")))

    pieces = pieces.withColumns({"own": marker("b", "row_start"), "inside": marker("t", "start")})
    pieces = pieces.withColumn("marker", F.coalesce("own", F.last(F.coalesce("inside", "own"), ignorenulls=True).over(before)))
    pieces = pieces.withColumn("bodies", F.coalesce(F.sum(F.col("told.b.bodies") + F.col("told.t.bodies")).over(before), F.lit(0).cast("long")) + F.col("told.b.bodies"))
    near = F.when(F.col("marker.at") >= F.col("start") - NEAR, F.col("marker.page"))
    page = F.coalesce(near, F.nullif(F.col("bodies").cast("long"), F.lit(0).cast("long")))
    return pieces.select("id", F.col("n").alias("table_no"), page.alias("page"), "html")


def _signs(piece: Column) -> Column:
    """struct(at, page, bodies): offset and number of a piece's last page number (null without one), and how many page bodies begin in it. Both are looked for only where their words stand."""
    def told(low: Column) -> Column:
        found = low.contains('class="page-number"') & piece.rlike(NUMBER)
        at = F.when(found, F.length(F.regexp_extract(piece, NUMBER, 1)))
        bodies = F.when(low.contains("page-body-container"), F.regexp_count(piece, F.lit(BODY))).otherwise(0)
        return F.struct(at.alias("at"), F.when(found, F.regexp_extract(piece, NUMBER, 2).try_cast("long")).alias("page"), bodies.alias("bodies"))

    # both words hold a hyphen, which is the fastest to look for
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("page"), F.lit(0).alias("bodies"))
    return F.when(piece.contains("-"), bound(F.lower(piece), told)).otherwise(none)


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a quotation is a table: even ones number every third page, with long text before some tables; odd ones have a body for every second line."""
    filler = F.repeat(F.lit("x"), 6000)
    number = lambda i: F.when(i % 3 == 0, F.concat(F.lit('<p class="page-number"> '), (i + 1).cast("string"), F.lit("</p>"))).otherwise("")
    even = lambda i: F.concat(number(i), F.when(i % 4 == 1, filler).otherwise(""))
    odd = lambda i: F.when(i % 2 == 0, "<div class='a page-body-container b'>").otherwise("")
    parts = F.transform("lines", lambda x, i: F.concat(F.when(F.col("id") % 2 == 0, even(i)).otherwise(odd(i)), F.lit("<TABLE><tr><td>"), x["name"], F.lit("</td></tr>\n</table>")))
    found = table_pages(lists(spark, sf_dir).select("id", F.array_join(parts, "\n").alias("text")))
    return found.select("id", "table_no", "page", F.length("html").alias("size"))


PAGES_SQL = f"""{_L}, t AS (SELECT id, n - 1 AS i, length(raw_name) + 34 AS size FROM l), j AS (SELECT *, i - i % 3 AS j FROM t)
SELECT id, CAST(i AS INTEGER) AS table_no, CASE WHEN id % 2 = 1 THEN i // 2 + 1 WHEN len(list_filter(range(j, i + 1), lambda k: k % 4 = 1)) = 0 THEN j + 1 END AS page, CAST(size AS INTEGER) AS size FROM j"""
QUERIES = {"table_page_inference": inferred}
SQL = {"table_page_inference": PAGES_SQL}
