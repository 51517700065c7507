"""From vendor documents to price rows: headers by synonyms, strict numbers, flat rows, text lines, price pages, aliases, vendors.

The given tables hold no vendor documents, so each quotation is rendered as one (CSV, HTML, Markdown, workbook, JSON, lines) and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.once import bound, with_once
from priceatlas.functions.text import _W, ascii_only, ascii_words, has_words, quoted
from priceatlas.plans.entities import ITEMS_SQL, quotation_items, table
from priceatlas.sources import grids

# Words that name a column, and words that no product name holds.
NAMES = ["product", "item", "description", "particulars", "name", "material", "details"]
SKUS = ["sku", "code", "item code", "product code", "part", "model", "cat", "catalogue", "hsn", "size"]
UNITS = ["unit", "uom", "units", "packing", "pack"]
PRICES = ["price", "rate", "mrp", "amount", "cost", "list price", "dealer price", "basic price", "net rate", "unit price"]
#: One of these stands in each of the words of a price column.
PRICE_SIGNS = ["price", "rate", "mrp", "amount", "cost"]
MOQS = ["moq", "min qty", "minimum order", "min order", "std pack", "standard pack"]
NOT_NAMES = "total|subtotal|gst|tax|freight|discount|amount|rate|price|lp"
NOT_IN_NAMES = "page|tel|fax|email|www|corporate|registered office|head office|mumbai|delhi|price list|lp no|hsn|gst|tax|freight|iec|bs en"
CELL_WORDS = "rs|inr|mrp|rate|each|ea|pc|pcs|nos?|mtrs?|meter|kg|box|coil|roll"
#: A number that is a price as it stands.
PLAIN_PRICE = r"^(?:₹ )?[0-9,]*[0-9](?:\.[0-9]+)?\z"
#: Rows in which a header is looked for.
HEADER_ROWS = 60


def column_of(cells: Column, words: list[str]) -> Column:
    """1-based place of the first header that is one of the words, else of the first that contains one; null without either."""
    return bound(_head_words(cells), lambda heads: _column_among(heads, words))


def _head_words(cells: Column) -> Column:
    return F.transform(cells, lambda h: F.trim(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), "[^a-z0-9]+", " ")))


def _column_among(heads: Column, words: list[str]) -> Column:
    same = F.array_position(F.transform(heads, lambda h: h.isin(words)), F.lit(True))
    within = F.array_position(F.transform(heads, lambda h: h.rlike("|".join(words))), F.lit(True))
    return bound(same, lambda s: F.when(s > 0, s).otherwise(bound(within, lambda w: F.when(w > 0, w)))).cast("int")


def strict_price(c: Column) -> Column:
    """Price number of a cell; null for dimensions, sums, ranges and other words than those of prices."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    # most cells are a plain number or hold no digit, which leaves nothing else to ask
    plain = lambda c: F.regexp_replace(c, "[₹, ]", "").try_cast("double")
    return bound(c, lambda c: F.when(c.rlike(PLAIN_PRICE), plain(c)).when(c.rlike("[0-9]"), bound(flat(c), lambda flat: _strict_number(c, flat))))


def _strict_number(c: Column, flat: Column) -> Column:
    money = flat.rlike(r"(?i)₹|rs\.?|inr")
    bad = flat.rlike(r"(?i)^\d+(?:\.\d+)?\s*(?:sq\.?\s*mm|mm|mtrs?\.?|met(?:er|re)s?|pair|core|nos?\.?|pcs?\.?)$")
    bad = bad | (flat.contains("+") & ~money) | (flat.contains("/") & ~money & ~flat.contains("/-"))
    bad = bad | (flat.rlike("[A-Za-z]") & ~has_words(flat, rf"(?i)\b(?:{CELL_WORDS})\b"))
    # what is not ASCII goes in the end anyway
    without = lambda c: F.when(c.rlike("[A-Za-z]"), F.regexp_replace(ascii_only(c), r"(?i)\b(?:rs|inr|mrp|rate|each|ea|pc|pcs|nos?|mtr|meter|kg|box|coil|roll)\b", "")).otherwise(c)
    bare = bound(F.regexp_replace(c, r"[₹$€,\s]", ""), without)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(None)).otherwise(F.regexp_replace(bare, r"[^\d.\-]", "").try_cast("double"))


def strict_price_sql(e: str) -> str:
    b = chr(92) + "b"
    flat = f"trim(regexp_replace(regexp_replace({e}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    money = f"regexp_matches({flat}, '(?i)₹|rs\\.?|inr')"
    bad = f"regexp_matches({flat}, '(?i)^\\d+(?:\\.\\d+)?\\s*(?:sq\\.?\\s*mm|mm|mtrs?\\.?|met(?:er|re)s?|pair|core|nos?\\.?|pcs?\\.?)$') OR (contains({flat}, '+') AND NOT {money}) OR (contains({flat}, '/') AND NOT {money} AND NOT contains({flat}, '/-')) OR (regexp_matches({flat}, '[A-Za-z]') AND NOT regexp_matches({flat}, '(?i){b}(?:{CELL_WORDS}){b}'))"
    bare = f"regexp_replace(regexp_replace({e}, '[₹$€,\\s]', '', 'g'), '(?i){b}(?:rs|inr|mrp|rate|each|ea|pc|pcs|nos?|mtr|meter|kg|box|coil|roll){b}', '', 'g')"
    return f"CASE WHEN coalesce({bad}, true) THEN NULL ELSE TRY_CAST(regexp_replace({bare}, '[^\\d.\\-]', '', 'g') AS DOUBLE) END"


def product_name(c: Column) -> Column:
    """Whether a cell may name a product: a letter, at least three characters, no word of totals or letterheads, not just a short word."""
    return bound(F.trim(F.coalesce(c, F.lit(""))), _may_name)


def _may_name(text: Column) -> Column:
    bad = text.rlike(f"(?i)^(?:{NOT_NAMES})$") | has_words(F.lower(text), rf"\b(?:{NOT_IN_NAMES})\b") | text.rlike(r"(?i)^[a-z/&\s-]{1,12}$")
    return (F.length(text) >= 3) & text.rlike("[A-Za-z]") & ~bad


def flat_price_rows(grid: DataFrame) -> DataFrame:
    """id, table_no, row_no, raw_name, sku, unit, price, moq: rows under the first of HEADER_ROWS rows that names both a product and a price column.

    A row needs a product name, and a price or a sku. Tables without such a header, and rows before it, give nothing.
    """
    def header(heads: Column) -> Column:
        def whole(n: Column, p: Column) -> Column:
            others = [_column_among(heads, words).alias(k) for k, words in (("s", SKUS), ("u", UNITS), ("m", MOQS))]
            return F.when(p.isNotNull(), F.struct(F.col("row_no").alias("row_no"), n.alias("n"), p.alias("p"), *others))

        return bound(_column_among(heads, NAMES), lambda n: F.when(n.isNotNull(), bound(_column_among(heads, PRICES), lambda p: whole(n, p))))

    # a head of prices holds one of these as it stands, which most rows do not
    whole_row = F.lower(F.array_join("cells", " "))
    maybe = F.lit(False)
    for word in PRICE_SIGNS:
        maybe = maybe | whole_row.contains(word)
    # one pass over the grid: a row's header is the least of those above it, so the documents are not parsed a second time for a join
    grid = grid.where("id is not null and table_no is not null").withColumn("h", F.when((F.col("row_no") < HEADER_ROWS) & maybe, bound(_head_words(F.col("cells")), header)))
    above = Window.partitionBy("id", "table_no").orderBy("row_no").rangeBetween(Window.unboundedPreceding, -1)
    rows = grid.withColumn("h", F.min("h").over(above)).where("row_no > h.row_no")

    def cell(at: str) -> Column:
        return F.nullif(F.trim(F.try_element_at("cells", F.col(f"h.{at}"))), F.lit(""))

    rows = rows.select("id", "table_no", "row_no", cell("n").alias("raw_name"), cell("s").alias("sku"), cell("u").alias("unit"), cell("p").alias("told"), cell("m").alias("moq")).where(product_name(F.col("raw_name")))
    rows = with_once(rows, {"price": strict_price(F.col("told"))}).where(F.col("price").isNotNull() | F.col("sku").isNotNull())
    return rows.select("id", "table_no", "row_no", "raw_name", "sku", "unit", "price", "moq")


_UNITS = ["pcs", "box", "coil", "mtr"]


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lines: the lines of each quotation as rows of a price list, in order (name, sku, unit, rate, moq as text)."""
    i = quotation_items(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_brand")
    name = F.concat("p_name", F.lit(' 5", no '), F.col("part").cast("string"))
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("line_no") % 4 + 1).cast("int"))
    rate = F.concat(F.lit("₹ "), F.format_number(F.col("unit_price"), 2))
    moq = F.col("qty").cast("int").cast("string")
    line = F.struct("line_no", name.alias("name"), "unit_price", "qty", F.col("p_brand").alias("sku"), unit.alias("unit"), rate.alias("rate"), moq.alias("moq"))
    return i.join(p, "part").groupBy(F.col("quotation_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


_L = f"""WITH i AS ({ITEMS_SQL}), l AS (SELECT quotation_id AS id, row_number() OVER w AS n, p_name || ' 5", no ' || part AS raw_name, p_brand AS sku, first_value(p_brand) OVER w AS first_sku,
list_extract(['pcs', 'box', 'coil', 'mtr'], CAST(line_no % 4 + 1 AS INTEGER)) AS unit, CAST(unit_price AS DOUBLE) AS price, CAST(CAST(qty AS INTEGER) AS VARCHAR) AS moq
FROM i JOIN part ON part = p_partkey WINDOW w AS (PARTITION BY quotation_id ORDER BY line_no, p_name || ' 5", no ' || part, unit_price, qty))"""


def _rows(found: DataFrame) -> DataFrame:
    return flat_price_rows(found).drop("table_no")


def from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cell(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    rows = F.transform("lines", lambda x: F.concat_ws(",", cell(x["name"]), x["sku"], x["unit"], cell(x["rate"]), x["moq"]))
    text = F.concat(F.lit("Price list of a vendor,,,\r\n\r\nDescription,SKU,Unit,Rate,MOQ\r\n"), F.array_join(rows, "\r\n"))
    return _rows(grids.read_csv_text(lists(spark, sf_dir).select("id", text.alias("text"))))


def from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sku of the first line spans all lines, and the title spans all columns."""
    rows = F.transform("lines", lambda x, i: F.concat(
        F.lit("<tr><td>"), F.replace(x["name"], F.lit('"'), F.lit("&quot;")), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("lines").cast("string"), F.lit(">"), x["sku"])).otherwise(""),
        F.lit("<td>"), x["unit"], F.lit("<td> "), x["rate"], F.lit("</td><td>"), x["moq"], F.lit("</td></tr>\n")))
    head = '<h1>List</h1><table border=1><tr><th colspan=5>Price list of a vendor</th></tr><tr><th>Description</th><th>SKU</th><th>Unit</th><th>Rate</th><th>MOQ</th></tr>'
    return _rows(grids.read_html_tables(lists(spark, sf_dir).select("id", F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</table><p>end")).alias("text"))))


def from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform("lines", lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["name"], x["sku"], x["unit"], x["rate"], x["moq"]), F.lit(" |")))
    text = F.concat(F.lit("# A vendor's list\n\n| Description | SKU | Unit | Rate | MOQ |\n|---|---|---|---|---|\n"), F.array_join(rows, "\n"), F.lit("\n\nend | of list\n"))
    return _rows(grids.read_markdown_tables(lists(spark, sf_dir).select("id", text.alias("text"))))


def from_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations exported as workbooks and read again."""
    rows = F.transform("lines", lambda x: F.array(x["name"], x["sku"], x["unit"], x["rate"], x["moq"]))
    grid = F.concat(F.array(F.array(F.lit("Quotation")), F.array(*map(F.lit, ["Description", "SKU", "Unit", "Rate", "MOQ"]))), rows)
    return _rows(grids.read_workbooks(grids.write_workbooks(lists(spark, sf_dir).select("id", grid.alias("grid")))))


_ROW = "struct<raw_name:string,sku:string,unit:string,price:string>"


def json_price_rows(docs: DataFrame) -> DataFrame:
    """id, raw_name, sku, unit, price of (id, text): an array of rows, or an object with it under `rows`; rows repeated within a document go. Texts that are neither give nothing."""
    wrapped = F.from_json("text", f"struct<rows:array<{_ROW}>>")["rows"]
    bare = F.from_json("text", f"array<{_ROW}>")
    rows = docs.select("id", F.inline(F.when(F.ltrim("text").startswith("["), bare).otherwise(wrapped)))
    return rows.select("id", F.trim("raw_name").alias("raw_name"), "sku", "unit", strict_price(F.col("price")).alias("price")).where("raw_name <> ''").dropDuplicates()


def from_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.to_json(F.transform("lines", lambda x: F.struct(x["name"].alias("raw_name"), x["sku"].alias("sku"), x["unit"].alias("unit"), x["rate"].alias("price"))))
    text = F.when(F.col("id") % 2 == 0, rows).otherwise(F.concat(F.lit('{"rows":'), rows, F.lit("}")))
    return json_price_rows(lists(spark, sf_dir).select("id", text.alias("text")))


def text_lines(docs: DataFrame) -> DataFrame:
    """id, line_no, raw_name, unit, price of (id, text): lines that end in a price, with or without a currency, `/-` and a unit."""
    squeezed = F.transform(F.split("text", "\n"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    lines = docs.select("id", F.posexplode(squeezed).alias("line_no", "line")).where((F.length("line") >= 8) & ~F.col("line").rlike("(?i)^total(?![A-Za-z0-9_])"))
    whole = r"(?i)^(.+?)\s+(₹|rs\.?|inr)?\s*([\d,]+(?:\.\d{1,2})?)\s*(/-)?(?:\s+(per\s+.+|each|ea|pc|pcs|nos?|mtr|meter|kg|box|coil|roll))?$"
    parts = {name: F.regexp_extract("line", whole, group) for name, group in (("named", 1), ("told", 3), ("sold", 5))}
    found = with_once(lines.where(F.col("line").rlike(whole)), parts).withColumn("raw_name", F.trim("named"))
    found = with_once(found.where(product_name(F.col("raw_name"))), {"price": strict_price(F.col("told"))}).where(F.col("price").isNotNull())
    return found.select("id", "line_no", "raw_name", F.nullif(F.trim("sold"), F.lit("")).alias("unit"), "price")


def from_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform("lines", lambda x, i: F.concat(x["name"], F.when(i % 2 == 0, "  ").otherwise(" "), x["rate"], F.when(i % 3 == 0, "/-").otherwise(""), F.lit(" per  "), x["unit"]))
    text = F.concat(F.lit("Our rates\n"), F.array_join(rows, "\n"), F.lit("\nTotal amount 1,000.00\n"))
    return text_lines(lists(spark, sf_dir).select("id", text.alias("text")))


def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a quotation is a page; the markers of every third quotation close their page, and those of every second count from 0."""
    base = F.when(F.col("id") % 2 == 0, 0).otherwise(1)
    pages = F.transform("lines", lambda x, i: F.concat(
        F.when(F.col("id") % 3 != 0, F.concat(F.when(i > 0, "\n\n").otherwise(""), F.lit("{"), (base + i).cast("string"), F.lit("}" + grids.MARK + "\n\n"))).otherwise(""),
        x["name"],
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n\n{"), (base + i).cast("string"), F.lit("}" + grids.MARK + "\n\n"))).otherwise("")))
    return grids.split_pages(lists(spark, sf_dir).select("id", F.array_join(pages, "").alias("text")))


# Signs of prices in the text of a page.
PRICE_HEADER = r"\b(?:price|rate|mrp|amount|cost|list\s*price|dealer\s*price|basic\s*price|net\s*rate|unit\s*price)\b"
PRODUCT_TABLE = r"\|.*\b(?:product|item|description|particulars|material|sku|code|model|cat(?:alogue)?\s*no)\b.*\|"
UNIT_SIGN = r"\b(?:per|uom|unit|nos?|pcs?|mtr|meter|coil|box|kg|set|roll|length)\b"
MONEY = r"(?:₹|rs\.?|inr)\s*[\d,]+(?:\.\d+)?|[\d,]+(?:\.\d+)?\s*(?:₹|rs\.?|inr)\b"
#: Documents of more pages are cut down to price pages: those of this score, their neighbours, and at most so many.
LARGE, SIGNAL, MOST = 20, 4, 20


def page_score(text: Column) -> Column:
    """Signs of prices on a page: header words, product tables, tables, units, amounts of money (at most 4), and table cells with numbers."""
    text = F.coalesce(text, F.lit(""))

    def has(p: str) -> Column:
        return text.rlike("(?i)" + ascii_words(p))

    money = F.size(F.regexp_extract_all(text, F.lit("(?i)" + ascii_words(MONEY)), F.lit(0)))
    cells = F.size(F.filter(F.split(text, r"\|"), lambda c: c.rlike(r"(?i)^\s*[\d,]+(?:\.\d{1,2})?\s*(?:/-|each|ea|pc|pcs|nos?|mtr|meter|kg|box|coil|roll)?\s*$")))
    parts = [F.when(has(PRICE_HEADER), 4), F.when(has(PRODUCT_TABLE), 2), F.when(text.contains("|"), 1), F.when(has(UNIT_SIGN), 1), F.least(F.lit(4), money), F.when(cells >= 6, 3).when(cells >= 3, 2)]
    out = F.lit(0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(0))
    return out


def price_pages(pages: DataFrame) -> DataFrame:
    """id, n_pages, picked, page_range, limited: of (id, page, text) the pages worth reading, as zero-based ranges where they limit the work.

    Documents of at most LARGE pages are read whole. A page of SIGNAL points brings its neighbours; nothing, everything or more than MOST pages picked: no limit.
    """
    scored = pages.groupBy("id", "page").agg(F.max(page_score(F.col("text"))).alias("score"))
    near = scored.where(F.col("score") >= SIGNAL).select("id", F.explode(F.array(*[F.col("page") + d for d in (-1, 0, 1)])).alias("page")).distinct()
    near = scored.join(near, ["id", "page"], "left_semi").select("id", "page")
    island = F.col("page") - F.row_number().over(Window.partitionBy("id").orderBy("page"))
    spans = near.withColumn("island", island).groupBy("id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count(F.lit(1)).alias("n"))
    span = F.concat((F.col("a") - 1).cast("string"), F.when(F.col("b") > F.col("a"), F.concat(F.lit("-"), (F.col("b") - 1).cast("string"))).otherwise(""))
    # ranges are put together only for documents with few enough pages, so no list grows with the data
    counts = spans.groupBy("id").agg(F.sum("n").alias("picked"))
    few = spans.join(counts.where(F.col("picked") <= MOST).select("id"), "id", "left_semi")
    ranges = few.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("a", span.alias("t"))))["t"], ",").alias("ranges"))
    total = scored.groupBy("id").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") > LARGE)
    out = total.join(counts, "id", "left").join(ranges, "id", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    limited = (F.col("picked") > 0) & (F.col("picked") < F.col("n_pages")) & (F.col("picked") <= MOST)
    return out.select("id", "n_pages", "picked", F.when(limited, F.col("ranges")).alias("page_range"), limited.alias("limited"))


def picked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents make a volume, one a page."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return price_pages(docs.select(F.floor(F.col("doc_id") / 30).alias("id"), (F.col("doc_id") % 30 + 1).alias("page"), "text"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", page_score(F.col("text")).alias("score"))


def _score_sql(e: str) -> str:
    def has(p: str) -> str:
        return f"regexp_matches({e}, {quoted('(?i)' + p)})"

    money, cell = f"len(regexp_extract_all({e}, {quoted('(?i)' + MONEY)}))", "(?i)^\\s*[\\d,]+(?:\\.\\d{1,2})?\\s*(?:/-|each|ea|pc|pcs|nos?|mtr|meter|kg|box|coil|roll)?\\s*$"
    cells = f"len(list_filter(string_split({e}, '|'), lambda c: regexp_matches(c, {quoted(cell)})))"
    return f"CAST(CASE WHEN {has(PRICE_HEADER)} THEN 4 ELSE 0 END + CASE WHEN {has(PRODUCT_TABLE)} THEN 2 ELSE 0 END + CASE WHEN contains({e}, '|') THEN 1 ELSE 0 END + CASE WHEN {has(UNIT_SIGN)} THEN 1 ELSE 0 END + least(4, {money}) + CASE WHEN {cells} >= 6 THEN 3 WHEN {cells} >= 3 THEN 2 ELSE 0 END AS INTEGER)"


PAGES_SQL = f"""WITH p AS (SELECT doc_id // 30 AS id, doc_id % 30 + 1 AS page, max({_score_sql("coalesce(text, '')")}) AS score FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT DISTINCT p.id, p.page FROM p JOIN p h ON h.id = p.id AND abs(h.page - p.page) <= 1 AND h.score >= {SIGNAL}),
g AS (SELECT *, page - row_number() OVER (PARTITION BY id ORDER BY page) AS island FROM n), s AS (SELECT id, min(page) AS a, max(page) AS b, count(*) AS n FROM g GROUP BY id, island),
r AS (SELECT id, sum(n) AS picked, string_agg(CASE WHEN b > a THEN (a - 1) || '-' || (b - 1) ELSE CAST(a - 1 AS VARCHAR) END, ',' ORDER BY a) AS ranges FROM s GROUP BY id),
t AS (SELECT id, count(*) AS n_pages FROM p GROUP BY id HAVING count(*) > {LARGE}), o AS (SELECT id, n_pages, CAST(coalesce(picked, 0) AS BIGINT) AS picked, ranges FROM t LEFT JOIN r USING (id))
SELECT id, n_pages, picked, CASE WHEN picked > 0 AND picked < n_pages AND picked <= {MOST} THEN ranges END AS page_range, picked > 0 AND picked < n_pages AND picked <= {MOST} AS limited FROM o"""

# Abbreviations that documents are searched for, and what they stand for.
ABBREVIATIONS = [(r"\bsq\.?\s*mm\b", "sqmm"), (r"\bmtrs?\.?\b", "meter"), (r"\bmetres?\b", "meter"), (r"\bpcs?\.?\b", "piece"), (r"\bnos?\.?\b", "piece")]
IN_BRACKETS = r"\b[A-Z][A-Z0-9./-]{2,}\s*\([^)a-z]{2,}\)"


def aliases(docs: DataFrame) -> DataFrame:
    """alias, canonical, confidence, hits, documents of (id, text): known abbreviations (0.90) and capitals with another spelling in brackets (0.72), letter case aside."""
    def known(a: Column) -> Column:
        to = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in ABBREVIATIONS:
            to = to.when(a.rlike("(?i)^" + pattern), name)
        return F.struct(F.lower(F.trim(a)).alias("alias"), to.alias("canonical"), F.lit(0.9).alias("confidence"))

    # abbreviations begin differently and hold no other, so one pass finds those of all
    some = "(?i)" + "|".join(p for p, _ in ABBREVIATIONS)
    finds = [F.transform(F.regexp_extract_all(ascii_only(F.col("text")), F.lit(some), F.lit(0)), known)]
    # the word boundary before the capital is asked for after it, where few places are left
    capitals = IN_BRACKETS.replace(r"\b[A-Z]", rf"[A-Z](?<!{_W}[A-Z])", 1)
    pairs = F.when(F.contains("text", F.lit("(")), F.regexp_extract_all("text", F.lit(capitals), F.lit(0))).otherwise(F.array().cast("array<string>"))
    finds.append(F.transform(pairs, lambda a: F.struct(
        F.lower(F.trim(F.regexp_extract(a, r"\(([^)]*)\)", 1))).alias("alias"), F.lower(F.trim(F.regexp_extract(a, r"^([^\s(]+)", 1))).alias("canonical"), F.lit(0.72).alias("confidence"))))
    found = docs.where("text is not null").select("id", F.inline(F.concat(*finds))).where("alias <> ''")
    per_doc = found.groupBy("id", "alias", "canonical", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("alias", "canonical").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("hits"), F.count(F.lit(1)).alias("documents"))


def mined_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents, and the parts' brands with their types in brackets."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("id"), F.concat(F.col("p_type"), F.lit(" ("), F.upper(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("), 6 sq.mm, 4 Pcs")).alias("text"))
    return aliases(docs.unionByName(parts))


_PAIRS = f"SELECT id, lower(trim(regexp_extract(a, '\\(([^)]*)\\)', 1))) AS alias, lower(trim(regexp_extract(a, '^([^\\s(]+)', 1))) AS canonical, 0.72 AS confidence FROM (SELECT id, unnest(regexp_extract_all(text, {quoted(IN_BRACKETS)})) AS a FROM d)"
ALIAS_SQL = f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - p_partkey, p_type || ' (' || upper(replace(p_brand, '#', '-')) || '), 6 sq.mm, 4 Pcs' FROM part),
f AS ({' UNION ALL '.join(f"SELECT id, lower(trim(unnest(regexp_extract_all(text, {quoted('(?i)' + p)})))) AS alias, '{to}' AS canonical, 0.9 AS confidence FROM d" for p, to in ABBREVIATIONS)} UNION ALL {_PAIRS})
SELECT alias, canonical, CAST(max(confidence) AS DOUBLE) AS confidence, count(*) AS hits, count(DISTINCT id) AS documents FROM f WHERE alias <> '' GROUP BY 1, 2"""

_C = "id, CAST(n + {} AS INTEGER) AS row_no, raw_name, {} AS sku, unit, price, moq"
QUERIES = {
    "source_csv": from_csv, "source_html_table": from_html, "source_markdown_table": from_markdown, "sink_source_workbook": from_workbook, "source_json_rows": from_json_rows,
    "text_line_prices": from_text_lines, "paginated_markdown": paginated, "price_page_score": scores, "price_page_selection": picked_pages, "alias_mining": mined_aliases,
}
SQL = {
    "source_csv": f"{_L} SELECT {_C.format(1, 'sku')} FROM l",
    "source_html_table": f"{_L} SELECT {_C.format(1, 'first_sku')} FROM l",
    "source_markdown_table": f"{_L} SELECT {_C.format(0, 'sku')} FROM l",
    "sink_source_workbook": f"{_L} SELECT {_C.format(1, 'sku')} FROM l",
    "source_json_rows": f"{_L} SELECT DISTINCT id, raw_name, sku, unit, price FROM l",
    "text_line_prices": f"{_L} SELECT id, CAST(n AS INTEGER) AS line_no, raw_name, 'per ' || unit AS unit, price FROM l",
    "paginated_markdown": f"{_L} SELECT id, CAST(n AS INTEGER) AS page, raw_name AS text FROM l",
    "price_page_score": f"""SELECT doc_id, {_score_sql("coalesce(text, '')")} AS score FROM documents""",
    "price_page_selection": PAGES_SQL,
    "alias_mining": ALIAS_SQL,
}
