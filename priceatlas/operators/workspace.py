"""The workspace around quotations: answers to chats, details, drafts, checked updates, deletes, landing chats, costs, vendor lists, contexts and spellings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.once import bound
from priceatlas.functions.text import ascii_only, ascii_words, normalize_n1, normalize_n1_sql, quoted, round2, round2_sql, unique_text, unique_text_sql
from priceatlas.operators import engine, quotes, search
from priceatlas.operators.canonical import number_text, number_text_sql
from priceatlas.plans.entities import ITEMS_SQL, PRICE_RECORDS_SQL, price_records, quotation_items, table

#: Scores from which a match counts as clear, is reviewed, is previewed, and is offered as an alternative; letters of a quoted summary; lines that an answer shows.
CLEAR, REVIEW, PREVIEW, ALTERNATIVE, CLIP, SHOWN = 0.85, 0.65, 0.5, 0.35, 96, 3
#: Lines around a hit, letters of a draft's title, rupees a page by mode, mark-up, letters that make a page, chats of a listing.
AROUND, TITLE, PER_PAGE, MARKUP, LETTERS, LISTED = 10, 80, {"fast": 0.49, "high": 0.48909}, 0.25, 2000, 50
# The sentences of an answer.
NO_PRICE = "I could not find a clear price in the selected document. Try adding brand, model, or the exact catalogue wording."
CHECK, OPEN = "Please check it before adding.", "Please open the source or make the item name more specific."
SOME, TO_REVIEW, NOTHING = "I added only the clear matches. The rest are waiting for your review.", "I have not added anything to the quote yet. Please review the cards below.", "I have not added anything to the quote yet."
NONE_AT_ALL = "I could not find a clear price. Try adding brand, size, model, or the document name."


def _many(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, one).otherwise(more)


def quoted_summary(c: Column) -> Column:
    """The text in quotes, clipped to CLIP letters with dots at the end; null for an empty one."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    clipped = F.when(F.length(flat) > CLIP, F.concat(F.trim(F.substring(flat, 1, CLIP - 3)), F.lit("..."))).otherwise(flat)
    return F.when(flat != "", F.concat(F.lit('"'), clipped, F.lit('"')))


def item_lines(items: DataFrame) -> DataFrame:
    """kind (matched, review, unresolved) and text of chat items with cands: array<struct(score, needs_review, said, phrase)>, best first."""
    items = items.withColumn("best", F.try_element_at("cands", F.lit(1))).withColumn("near", F.slice(F.filter("cands", lambda c: c["score"] >= ALTERNATIVE), 1, 5))
    kind = F.when((F.col("best.score") >= CLEAR) & ~F.col("best.needs_review"), "matched").when(F.col("best.score") >= PREVIEW, "review").otherwise("unresolved")
    review = F.concat(F.lit("- "), F.col("query"), F.lit(": possible match "), F.col("best.said"), F.lit(" at "), F.col("best.phrase"), F.lit(". "), F.when(F.col("best.score") >= REVIEW, CHECK).otherwise(OPEN))
    more = F.size("near") - 2
    rest = F.when(more > 0, F.concat(F.lit("; plus "), more.cast("string"), F.lit(" more possible "), _many(more, "match", "matches"))).otherwise("")
    offers = F.array_join(F.transform(F.slice("near", 1, 2), lambda c: F.concat(c["said"], F.lit(" at "), c["phrase"])), "; ")
    open_ = F.when(F.size("near") > 0, F.concat(F.lit("- "), F.col("query"), F.lit(": I found possible prices, but need you to choose the right one: "), offers, rest, F.lit("."))).otherwise(F.concat(F.lit("- "), F.col("query"), F.lit(": " + NO_PRICE)))
    return items.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "review", review).when(F.col("kind") == "unresolved", open_))


def answers_of(lines: DataFrame) -> DataFrame:
    """id, matched, review, unresolved, answer of (id, line_no, kind, text): the counts and the first SHOWN lines of each kind, then what happens next."""
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("line_no", "text"))

    def shown(kind: str) -> Column:
        found = F.collect_list(F.when((F.col("kind") == kind) & (F.col("place") <= SHOWN), F.struct("line_no", "text")))
        return F.array_join(F.sort_array(found)["text"], "\n").alias(f"{kind}_lines")

    kinds = ["matched", "review", "unresolved"]
    sums = lines.withColumn("place", place).groupBy("id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds], shown("review"), shown("unresolved"))
    m, r, u = map(F.col, kinds)
    r_more, u_more = r - SHOWN, u - SHOWN
    parts = [
        F.when(m > 0, F.concat(F.lit("Found "), m.cast("string"), _many(m, " item", " items"), F.lit(" ready to add to the quote."))),
        F.when(r > 0, F.concat(r.cast("string"), F.lit(" possible "), _many(r, "match needs", "matches need"), F.lit(" a quick check before adding:\n"), F.col("review_lines"),
               F.when(r_more > 0, F.concat(F.lit("\n- "), r_more.cast("string"), F.lit(" more "), _many(r_more, "item", "items"), F.lit(" shown in the cards below."))).otherwise(""))),
        F.when(u > 0, F.concat(F.lit("I need help with "), u.cast("string"), _many(u, " item", " items"), F.lit(" before adding them to the quote:\n"), F.col("unresolved_lines"),
               F.when(u_more > 0, F.concat(F.lit("\n- "), u_more.cast("string"), F.lit(" more "), _many(u_more, "item", "items"), F.lit(" need a clearer brand, size, model, or document."))).otherwise(""))),
        F.when(r + u > 0, F.when(m > 0, SOME).when(r > 0, TO_REVIEW).otherwise(NOTHING)),
    ]
    return sums.select("id", *kinds, F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit(NONE_AT_ALL)).alias("answer"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quotation is a chat that asks for its lines' parts. So that answers of every quality come up, a line's best candidates start at the first, second or third (line number modulo 3)."""
    prices = price_records(spark, sf_dir).groupBy("product").agg(F.min("price").alias("price"))
    found = search.ranked(spark, sf_dir).join(prices, "product")
    cand = F.struct("rank", "score", "needs_review", quoted_summary(F.col("product")).alias("said"), F.concat(F.lit("INR "), number_text(round2(F.col("price")))).alias("phrase"))
    cands = found.groupBy("query").agg(F.sort_array(F.collect_list(cand)).alias("found"))  # five of a query at most
    asked = quotation_items(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("query")), "part")
    items = asked.join(cands, "query", "left").select(F.col("quotation_id").alias("id"), "line_no", "query", F.coalesce(F.slice("found", (F.col("line_no") % 3 + 1).cast("int"), 5), F.array().cast("array<struct<rank:int,score:double,needs_review:boolean,said:string,phrase:string>>")).alias("cands"))
    return answers_of(item_lines(items))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with each ranked name: quoted at once, shown for review, offered as an alternative; and its colour."""
    s = F.col("score")
    colour = F.when(s >= CLEAR, "green").when(s >= REVIEW, "amber").otherwise("red")
    return search.ranked(spark, sf_dir).select("query", "rank", "product", ((s >= CLEAR) & ~F.col("needs_review")).alias("ready"), (s >= PREVIEW).alias("card"), ((F.col("rank") > 1) & (s >= ALTERNATIVE)).alias("alternative"), colour.alias("colour"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotation with its totals and its lines by number."""
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("part").cast("string"), F.lit(" x "), F.col("qty").cast("string"), F.lit(" @ "), F.col("unit_price").cast("string"), F.lit(" from "), F.col("vendor"))
    lines = quotation_items(spark, sf_dir).groupBy(F.col("quotation_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line"))))["line"], "\n").alias("lines"))
    t = quotes.totals(spark, sf_dir).select("id", "customer", "status", "subtotal", "gst", "grand_total")
    return t.join(lines, "id", "left").withColumn("lines", F.coalesce("lines", F.lit("")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat keeps its quotation (the order of its id), else gets a draft with a title from its first message by a user."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))["text"].alias("seed"))
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.col("o_orderkey").alias("quotation_id")).distinct()
    seed = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("seed", F.lit("")), r"\s+", " ")), r"\s+", " "), 1, TITLE)
    title = F.when(F.col("quotation_id").isNull(), F.when(seed != "", F.concat(F.lit("Proforma - "), seed)).otherwise("Proforma invoice"))
    return c.join(held, "conv_id", "left").select("conv_id", "quotation_id", title.alias("new_title"))


def checked_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of quotations: percentages from 0 to 100, freight from 0, revisions from 1; the fields out of bounds, and whether the update stands."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 131 - 10).alias("discount"), (F.col("o_custkey") % 120).alias("gst"), (F.col("o_totalprice") - 1000).alias("freight"), (F.col("o_orderkey") % 4).alias("revision"))
    rules = [("discount", F.col("discount").between(0, 100)), ("gst", F.col("gst").between(0, 100)), ("freight", F.col("freight") >= 0), ("revision", F.col("revision") >= 1)]
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules]))
    return o.select("id", F.array_join(bad, ",").alias("refused"), (F.size(bad) == 0).alias("accepted"))


def after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived quotations are deleted, and their lines with them: the quotations left and their lines."""
    o = table(spark, sf_dir, "orders")
    gone = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")).distinct()
    kept = o.select(F.col("o_orderkey").alias("id")).join(gone, "id", "left_anti")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).join(gone, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(lines, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_lines"))


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a customer lands: the latest quotation (by date, then id), or a new chat if there is none."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("landing"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", "landing", F.coalesce("n", F.lit(0)).alias("quotations"), F.when(F.col("landing").isNull(), "New chat").otherwise(F.col("c_name")).alias("title"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document, and what reading them costs by mode: base, and with the mark-up."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.coalesce("n_chars", F.lit(0)) / LETTERS).cast("int").alias("pages"))
    base = {m: round2(F.greatest(F.lit(0), F.col("pages")) * F.lit(rate)) for m, rate in PER_PAGE.items()}
    return d.select("doc_id", "pages", *[b.alias(f"{m}_base") for m, b in base.items()], *[round2(b * F.lit(1 + MARKUP)).alias(f"{m}_cost") for m, b in base.items()])


def vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of the quotations, each once: the quotation that named it first, the last one, and how many did."""
    each = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").distinct()
    found = each.groupBy("s_suppkey").agg(F.min("l_orderkey").alias("first_seen"), F.max("l_orderkey").alias("last_seen"), F.count(F.lit(1)).alias("quotations"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return found.join(names, "s_suppkey", "left").select("s_suppkey", F.coalesce(F.nullif(F.trim("s_name"), F.lit("")), F.lit("Unassigned vendor")).alias("vendor"), "first_seen", "last_seen", "quotations")


def listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first LISTED users of a listing: pinned ones (every 50th) first, then those seen last, then by id."""
    last = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    rows = last.select("user_id", (F.col("user_id") % 50 == 0).alias("pinned"), F.col("m.event_id").alias("last_event"), "m")
    return rows.orderBy(F.desc("pinned"), F.desc("m.ts"), "user_id").limit(LISTED).drop("m")


def around(text: Column, needle: Column, lines: int = AROUND) -> Column:
    """struct(line, context): the first line that holds the needle (from 1; 0: none) and the lines around it; an empty needle finds nothing."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    hit = F.when(F.coalesce(needle, F.lit("")) == "", 0).otherwise(F.array_position(F.transform(parts, lambda x: x.contains(needle)), F.lit(True)))
    start = F.greatest(F.lit(1), hit - lines).cast("int")
    context = F.when(hit > 0, F.array_join(F.slice(parts, start, (hit + lines - start + 1).cast("int")), "\n")).otherwise("")
    return F.struct(hit.cast("int").alias("line"), context.alias("context"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of a document, where it comes first, and what stands around it there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract(F.coalesce("text", F.lit("")), r"([^\s]+)\s*$", 1).alias("needle"))
    return d.select("doc_id", "needle", around(F.col("text"), F.col("needle")).alias("a")).select("doc_id", "needle", "a.line", "a.context")


# Spellings that stand for each other, the kinds of wire by their signs in the order of their precedence.
_UNARMOURED, _ARMOURED, _COAX = r"\bun\s*[-_/ ]?\s*arm(?:ou?red|ored|d)?\.?\b", r"\barm(?:ou?red|ored|d)?\.?\b", r"\bc[o0]\s*[-_/ ]\s*axial\b"
SPELLINGS = [(_COAX, "coaxial"), (_COAX, "co axial"), (_COAX, "co-axial"), (r"\bcoaxial\b", "co axial"), (r"\bcoaxial\b", "co-axial"), (_UNARMOURED, "unarmored"), (_UNARMOURED, "unarmoured"), (_ARMOURED, "armored"), (_ARMOURED, "armoured")]
KINDS = [("FRLSH", r"\bfr\s*ls\s*h\b|frlsh"), ("FRLS", r"\bfr\s*ls\b|frls"), ("HFFR", r"\bhffr\b|hffr\s*\d|hffr\d"), ("ZHFR", r"\bzhfr\b|zhfr\s*\d|zhfr\d"), ("FR", r"\bfr\b|fr\s*\d+\s*(?:mtrs?|meter|coil)|fr300")]


def spellings(text: Column) -> Column:
    """Other spellings of a text, each once, white space squeezed; the text itself is none."""
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))

    def others(text: Column, form: Callable[[str], str]) -> Column:
        flat = lambda plain: [F.when(text.rlike("(?i)" + form(p)), squeezed(F.regexp_replace(text, "(?i)" + form(p), to))).otherwise(plain) for p, to in SPELLINGS]
        return bound(squeezed(text), lambda plain: F.array(*flat(plain)))

    # on ASCII texts Java's plain word boundary serves
    found = lambda t: F.when(F.octet_length(t) == F.length(t), others(t, str)).otherwise(others(t, ascii_words))
    return bound(text, lambda t: F.array_distinct(F.filter(found(t), lambda v: (v != "") & (v != F.trim(t)))))


def wire_kind(text: Column) -> Column:
    def kind_of(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for kind, signs in KINDS:
            out = out.when(low.rlike(signs), kind)
        return out

    return bound(ascii_only(F.lower(text)), kind_of)


def item_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the electrical list (every fourth is co-axial): other spellings, kind of wire, and terms for a search by pattern (normal, and without blanks)."""
    name = F.concat("name", F.when(F.col("id") % 4 == 0, " Co-axial").when(F.col("id") % 4 == 1, " coaxial 5%").otherwise(""))
    rows = engine.items(spark, sf_dir).select("id", name.alias("name")).withColumn("n", normalize_n1(F.regexp_replace("name", "[%_]", "")))
    return rows.select("id", F.array_join(spellings(F.col("name")), " | ").alias("spellings"), wire_kind(F.col("name")).alias("kind"), F.array_join(unique_text(F.array("n", F.replace("n", F.lit(" "), F.lit("")))), " | ").alias("terms"))


def _many_sql(n: str, one: str, more: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '{one}' ELSE '{more}' END"


_SAID = f"""'"' || CASE WHEN length(product) > {CLIP} THEN trim(substr(product, 1, {CLIP - 3})) || '...' ELSE product END || '"'"""
ANSWERS_SQL = f"""WITH rk AS ({search.RANKED_SQL}), pr AS (SELECT product, min(price) AS price FROM ({PRICE_RECORDS_SQL}) GROUP BY 1),
cd AS (SELECT query, rank, score, needs_review, {_SAID} AS said, 'INR ' || {number_text_sql(round2_sql('price'))} AS phrase FROM rk JOIN pr USING (product)),
it AS (SELECT quotation_id AS id, line_no, p_name AS query, line_no % 3 + 1 AS start FROM ({ITEMS_SQL}) JOIN part ON part = p_partkey),
be AS (SELECT it.*, score, needs_review, said, phrase FROM it LEFT JOIN cd ON cd.query = it.query AND rank = start),
ne AS (SELECT q.query, q.start, count(*) AS n, string_agg(said || ' at ' || phrase, '; ' ORDER BY rank) FILTER (rank - low < 2) AS offers FROM (SELECT query, start, rank, said, phrase, min(rank) OVER (PARTITION BY query, start) AS low FROM (SELECT DISTINCT query, start FROM it) JOIN cd USING (query) WHERE rank >= start AND score >= {ALTERNATIVE}) q GROUP BY 1, 2),
li AS (SELECT be.*, CASE WHEN score >= {CLEAR} AND NOT needs_review THEN 'matched' WHEN score >= {PREVIEW} THEN 'review' ELSE 'unresolved' END AS kind, n, offers FROM be LEFT JOIN ne USING (query, start)),
tx AS (SELECT id, line_no, kind, CASE kind WHEN 'review' THEN '- ' || query || ': possible match ' || said || ' at ' || phrase || '. ' || CASE WHEN score >= {REVIEW} THEN '{CHECK}' ELSE '{OPEN}' END
WHEN 'unresolved' THEN CASE WHEN n > 0 THEN '- ' || query || ': I found possible prices, but need you to choose the right one: ' || offers || CASE WHEN n > 2 THEN '; plus ' || (n - 2) || ' more possible ' || {_many_sql('n - 2', 'match', 'matches')} ELSE '' END || '.' ELSE '- ' || query || ': {NO_PRICE}' END END AS text FROM li),
pl AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY line_no, text) AS place FROM tx),
su AS (SELECT id, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'review') AS review, count(*) FILTER (kind = 'unresolved') AS unresolved,
string_agg(text, chr(10) ORDER BY line_no, text) FILTER (kind = 'review' AND place <= {SHOWN}) AS rl, string_agg(text, chr(10) ORDER BY line_no, text) FILTER (kind = 'unresolved' AND place <= {SHOWN}) AS ul FROM pl GROUP BY id)
SELECT id, matched, review, unresolved, coalesce(nullif(concat_ws(chr(10) || chr(10), CASE WHEN matched > 0 THEN 'Found ' || matched || {_many_sql('matched', ' item', ' items')} || ' ready to add to the quote.' END,
CASE WHEN review > 0 THEN review || ' possible ' || {_many_sql('review', 'match needs', 'matches need')} || ' a quick check before adding:' || chr(10) || rl || CASE WHEN review > {SHOWN} THEN chr(10) || '- ' || (review - {SHOWN}) || ' more ' || {_many_sql(f'review - {SHOWN}', 'item', 'items')} || ' shown in the cards below.' ELSE '' END END,
CASE WHEN unresolved > 0 THEN 'I need help with ' || unresolved || {_many_sql('unresolved', ' item', ' items')} || ' before adding them to the quote:' || chr(10) || ul || CASE WHEN unresolved > {SHOWN} THEN chr(10) || '- ' || (unresolved - {SHOWN}) || ' more ' || {_many_sql(f'unresolved - {SHOWN}', 'item', 'items')} || ' need a clearer brand, size, model, or document.' ELSE '' END END,
CASE WHEN review + unresolved > 0 THEN CASE WHEN matched > 0 THEN '{SOME}' WHEN review > 0 THEN '{TO_REVIEW}' ELSE '{NOTHING}' END END), ''), '{NONE_AT_ALL}') AS answer FROM su"""
_DOCS = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, regexp_extract(coalesce(text, ''), '([^\\s]+)\\s*$', 1) AS needle FROM documents"
_ITEM = f"SELECT id, name || CASE id % 4 WHEN 0 THEN ' Co-axial' WHEN 1 THEN ' coaxial 5%' ELSE '' END AS name FROM ({engine.ITEMS})"
_OTHER = "[" + ", ".join(f"trim(regexp_replace(regexp_replace(name, {quoted(p)}, '{to}', 'gi'), '\\s+', ' ', 'g'))" for p, to in SPELLINGS) + "]"
_BASE = {m: round2_sql(f"greatest(0, pages) * {rate}::DOUBLE") for m, rate in PER_PAGE.items()}

QUERIES = {
    "chat_answers": answers, "visibility_gates": gates, "quotation_detail": details, "draft_quotations": drafts, "quotation_updates": checked_updates, "cascade_delete": after_delete,
    "landing_chats": landings, "document_costs": costs, "vendor_list": vendor_list, "pinned_first": listed_users, "line_context": contexts, "item_spellings": item_spellings,
}
SQL = {
    "chat_answers": ANSWERS_SQL,
    "visibility_gates": f"SELECT query, rank, product, score >= {CLEAR} AND NOT needs_review AS ready, score >= {PREVIEW} AS card, rank > 1 AND score >= {ALTERNATIVE} AS alternative, CASE WHEN score >= {CLEAR} THEN 'green' WHEN score >= {REVIEW} THEN 'amber' ELSE 'red' END AS colour FROM ({search.RANKED_SQL})",
    "quotation_detail": f"""{quotes._T}, x AS (SELECT quotation_id, line_no, line_no || '. ' || part || ' x ' || qty || ' @ ' || unit_price || ' from ' || vendor AS line FROM i), n AS (SELECT quotation_id, string_agg(line, chr(10) ORDER BY line_no, line) AS lines FROM x GROUP BY 1)
SELECT id, customer, status, subtotal, gst, grand_total, coalesce(lines, '') AS lines FROM t LEFT JOIN n ON quotation_id = id""",
    "draft_quotations": f"""WITH u AS (SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) = 1),
c AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT c.conv_id, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, {TITLE}) AS seed FROM c LEFT JOIN u USING (conv_id))
SELECT conv_id, q AS quotation_id, CASE WHEN q IS NULL THEN CASE WHEN seed <> '' THEN 'Proforma - ' || seed ELSE 'Proforma invoice' END END AS new_title FROM s LEFT JOIN (SELECT DISTINCT o_orderkey AS q FROM orders) ON q = conv_id""",
    "quotation_updates": """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 131 - 10 AS d, o_custkey % 120 AS g, o_totalprice - 1000 AS f, o_orderkey % 4 AS r FROM orders),
b AS (SELECT id, concat_ws(',', CASE WHEN d NOT BETWEEN 0 AND 100 THEN 'discount' END, CASE WHEN g NOT BETWEEN 0 AND 100 THEN 'gst' END, CASE WHEN f < 0 THEN 'freight' END, CASE WHEN r < 1 THEN 'revision' END) AS refused FROM o) SELECT id, refused, refused = '' AS accepted FROM b""",
    "cascade_delete": "SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'",
    "landing_chats": "WITH l AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey, o_orderkey AS landing, coalesce(n, 0) AS quotations, CASE WHEN o_orderkey IS NULL THEN 'New chat' ELSE c_name END AS title FROM customer LEFT JOIN l ON c_custkey = o_custkey",
    "document_costs": f"WITH d AS (SELECT doc_id, CAST(ceil(coalesce(n_chars, 0) / {LETTERS}::DOUBLE) AS INTEGER) AS pages FROM documents) SELECT doc_id, pages, {', '.join(f'{b} AS {m}_base' for m, b in _BASE.items())}, {', '.join(f'{round2_sql(f"{b} * {1 + MARKUP}::DOUBLE")} AS {m}_cost' for m, b in _BASE.items())} FROM d",
    "vendor_list": "SELECT l_suppkey AS s_suppkey, coalesce(nullif(trim(min(s_name)), ''), 'Unassigned vendor') AS vendor, min(l_orderkey) AS first_seen, max(l_orderkey) AS last_seen, count(DISTINCT l_orderkey) AS quotations FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    "pinned_first": f"WITH l AS (SELECT user_id, user_id % 50 = 0 AS pinned, event_id AS last_event, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, pinned, last_event FROM l ORDER BY pinned DESC, ts DESC, user_id LIMIT {LISTED}",
    "line_context": f"WITH d AS ({_DOCS}), h AS (SELECT *, CASE WHEN needle = '' THEN 0 ELSE coalesce(list_position(list_transform(lines, lambda x: contains(x, needle)), true), 0) END AS hit FROM d) SELECT doc_id, needle, CAST(hit AS INTEGER) AS line, CASE WHEN hit > 0 THEN array_to_string(lines[greatest(1, hit - {AROUND}):hit + {AROUND}], chr(10)) ELSE '' END AS context FROM h",
    "item_spellings": f"""WITH i AS ({_ITEM}), v AS (SELECT id, name, list_filter({_OTHER}, lambda v: v <> '' AND v <> trim(name)) AS s, {normalize_n1_sql("regexp_replace(name, '[%_]', '', 'g')")} AS n FROM i)
SELECT id, array_to_string(list_filter(s, lambda x, k: list_position(s, x) = k), ' | ') AS spellings, CASE {' '.join(f"WHEN regexp_matches(lower(name), {quoted(p)}) THEN '{k}'" for k, p in KINDS)} END AS kind, array_to_string({unique_text_sql("[n, replace(n, ' ', '')]")}, ' | ') AS terms FROM v""",
}
