"""From item queries to scored prices: splitting, quantities, parsing, electrical matches, price bases, quotation rates and the candidate score.

The given tables hold no electrical price list, so each part is rendered as an item of one (`items`), and queries are item names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceatlas.functions.electrical import electrical, electrical_sql, normalize_n2, normalize_n2_sql, price_basis, price_basis_sql, quotation_rate
from priceatlas.functions.text import UNIT_WORDS, ascii_words, normalize_n1, normalize_unit, quoted, tokens
from priceatlas.plans.entities import table

_SIZES, _UNITS, _CORES = ["1.5", "2.5", "4", "6", "10", "16", "25"], ["Sqmm", " sq.mm", " SQ MM", "sqmm "], ["1Core", "2C", "3.5 core", "4 Cores", ""]
_KINDS = ["Cu", "Al", "copper", "flexible", "XLPE copper"]
_TYPES = ["Armoured cable", "un-arm cable", "FR Wire 90 Mtr", "FRLS wire 300Mtrs coil", "FR-LSH wire per 100 meter", "arm. cable 12 nos"]
_PRICED = ["per mtr", "coil", "pcs", "", "roll"]
_PICKS = [(_SIZES, "p_partkey % 7"), (_UNITS, "p_size % 4"), (_CORES, "p_partkey % 5"), (_KINDS, "p_size % 5"), (_TYPES, "(p_partkey + p_size) % 6")]
_GAPS = ["", "*", " ", " ", ""]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, unit, price: parts as electrical items."""
    def pick(words: list[str], at: str) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.expr(at) + 1).cast("int"))

    parts = [c for (words, at), gap in zip(_PICKS, _GAPS, strict=True) for c in (pick(words, at), F.lit(gap))]
    # reading a name costs far more than its bytes tell, so a small file is dealt out by number
    rows = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return rows.select(F.col("p_partkey").alias("id"), F.concat(*parts).alias("name"), pick(_PRICED, "p_partkey % 5").alias("unit"), F.col("p_retailprice").alias("price"))


def _pick_sql(words: list[str], at: str) -> str:
    return f"list_extract([{', '.join(map(quoted, words))}], CAST({at} + 1 AS INTEGER))"


ITEMS = f"SELECT p_partkey AS id, {' || '.join(f'{_pick_sql(w, a)} || {quoted(g)}' for (w, a), g in zip(_PICKS, _GAPS, strict=True))} AS name, {_pick_sql(_PRICED, 'p_partkey % 5')} AS unit, p_retailprice AS price FROM part"


def second_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalize_n2(F.col("name"))
    return items(spark, sf_dir).select("id", n.alias("normal"), F.replace(n, F.lit(" "), F.lit("")).alias("compact"))


def electrical_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("id", normalize_n2(F.col("name")).alias("n"))
    return rows.select("id", *[c.alias(k) for k, c in electrical(F.col("n")).items()])


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("b", price_basis(F.col("price"), F.col("unit"), F.col("name")))
    return rows.select("id", F.col("b.quantity").alias("quantity"), F.col("b.unit").alias("basis"), F.col("b.pack_unit").alias("pack"), F.col("b.label").alias("label"), F.col("b.unit_price").alias("unit_price"))


#: Units that the rates are asked in, by part.
ASKED = ["bundle", "mtrs", "coil", "nos", "kg", "meter"]


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("b", price_basis(F.col("price"), F.col("unit"), F.col("name")))
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % len(ASKED) + 1).cast("int"))
    r = quotation_rate(F.col("price"), F.col("b"), F.col("id") % 4, asked)
    return rows.select("id", r["qty"].alias("qty"), r["unit"].alias("rate_unit"), r["unit_price"].alias("rate"))


BASES_SQL = f"WITH src AS ({ITEMS}) SELECT id, q AS quantity, u AS basis, k AS pack, label, unit_price FROM ({price_basis_sql('price', 'unit', 'name')})"
_NAMED = "list_extract(['bundle', 'meter', 'coil', 'piece', 'kg', 'meter'], CAST(id % 6 + 1 AS INTEGER))"
RATES_SQL = f"""WITH src AS ({ITEMS}), b AS (SELECT *, {_NAMED} AS a FROM ({price_basis_sql('price', 'unit', 'name')})), c AS (SELECT *, coalesce(a IN ('coil', 'roll', 'bundle') AND k IS NOT NULL, false) AS pk FROM b)
SELECT id, CAST(greatest(id % 4, 1) AS DOUBLE) AS qty, CASE WHEN pk THEN CASE a WHEN 'bundle' THEN a ELSE k END WHEN a = u THEN a ELSE coalesce(label, u, a) END AS rate_unit, CASE WHEN pk THEN p WHEN a = u THEN unit_price ELSE p END AS rate FROM c"""

_ATTRIBUTES = ["size", "cores", "length", "insulation", "conductor", "cable_type", "category"]
#: Points of an attribute that agrees, least points of a match with a mismatch, and the points that make full confidence.
POINTS = {"size": 28, "cores": 22, "length": 20, "insulation": 18, "conductor": 12, "cable_type": 12, "category": 8}
LEAST, LEAST_SHARE, FULL = 32, 0.45, 65


def electrical_score(q: str, r: str) -> tuple[Column, Column, Column]:
    """(score, possible, mismatch) of a query's attributes (struct column q) and a record's (r). FRLS meets FRLSH at 16 points; another kind than FR costs 10, another category 6."""
    score, possible, mismatch = F.lit(0), F.lit(0), F.lit(False)
    for name, points in POINTS.items():
        a, b = F.col(f"{q}.{name}"), F.col(f"{r}.{name}")
        other, near, cost = a.isNotNull() & b.isNotNull() & (a != b), F.lit(False), F.lit(0)
        if name == "insulation":
            near, cost = (a == "frls") & (b == "frlsh"), F.when(a == "fr", -10).otherwise(0)
        if name == "category":
            cost = F.lit(-6)
        score = score + F.when(a == b, points).when(near, 16).when(other, cost).otherwise(0)
        possible = possible + F.when(a.isNotNull(), points).otherwise(0)
        if name != "category":
            hard = other & ~near & (a != "fr") if name == "insulation" else other
            mismatch = mismatch | F.coalesce(hard, F.lit(False))
    return score, possible, mismatch


def electrical_matches(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query, record (attributes as text), items, score, confidence of (name) and (name): attributes that have the same size.

    Both sides are pre-aggregated to distinct attributes, whose number the catalogue's vocabulary bounds, and meet by size. Queries need a size and one more attribute.
    """
    def specs(names: DataFrame, record: bool) -> DataFrame:
        rows = names.select(normalize_n2(F.col("name")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("items"))
        rows = rows.select("items", *[c.alias(k) for k, c in electrical(F.col("n"), record).items()])
        return rows.groupBy(*_ATTRIBUTES).agg(F.sum("items").alias("items")).where("size is not null")

    def text(s: str) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(f"{s}.{a}").cast("string"), F.lit("")) for a in _ATTRIBUTES])

    q = specs(queries, False).where("coalesce(cast(cores as string), cast(length as string), insulation, conductor, cable_type) is not null").select("size", F.struct(*_ATTRIBUTES).alias("q"))
    r = specs(records, True).select("size", F.struct(*_ATTRIBUTES).alias("r"), "items")
    score, possible, mismatch = electrical_score("q", "r")
    pairs = q.join(r, "size").withColumn("score", score).withColumn("possible", possible).withColumn("mismatch", mismatch)
    pairs = pairs.where((F.col("score") > 0) & ~(F.col("mismatch") & (F.col("score") < F.greatest(F.lit(float(LEAST)), F.col("possible") * LEAST_SHARE))))
    confidence = F.greatest(F.lit(0.2), F.least(F.lit(0.99), F.col("score") / F.greatest(F.lit(FULL), F.col("possible"))))
    return pairs.select(text("q").alias("query"), text("r").alias("record"), "items", "score", confidence.alias("confidence"))


def matched_electrical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = items(spark, sf_dir).select("name")
    return electrical_matches(names, names)


def _match_sql() -> str:
    def side(record: bool) -> str:
        return f"SELECT {', '.join(_ATTRIBUTES)}, count(*) AS items FROM (SELECT {electrical_sql('n', record)} FROM n) WHERE size IS NOT NULL GROUP BY ALL"

    def case(k: str) -> str:
        a, b, p = f"q.{k}", f"r.{k}", POINTS[k]
        extra = f"WHEN {a} = 'frls' AND {b} = 'frlsh' THEN 16 WHEN {a} = 'fr' AND {b} <> 'fr' THEN -10" if k == "insulation" else f"WHEN {a} <> {b} THEN -6" if k == "category" else ""
        return f"CASE WHEN {a} = {b} THEN {p} {extra} ELSE 0 END"

    def text(s: str) -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce(CAST({s}.{a} AS VARCHAR), '')" for a in _ATTRIBUTES) + ")"

    hard = " OR ".join(f"coalesce(q.{k} <> r.{k}, false)" + (" AND NOT (q.insulation = 'frls' AND r.insulation = 'frlsh') AND q.insulation <> 'fr'" if k == "insulation" else "") for k in POINTS if k != "category")
    possible = " + ".join(f"CASE WHEN q.{k} IS NULL THEN 0 ELSE {p} END" for k, p in POINTS.items())
    return f"""WITH i AS ({ITEMS}), n AS (SELECT {normalize_n2_sql('name')} AS n FROM i), q AS ({side(False)}), r AS ({side(True)}),
p AS (SELECT {text('q')} AS query, {text('r')} AS record, r.items, {' + '.join(map(case, POINTS))} AS score, {possible} AS possible, {hard} AS mismatch FROM q JOIN r ON q.size = r.size
WHERE coalesce(CAST(q.cores AS VARCHAR), CAST(q.length AS VARCHAR), q.insulation, q.conductor, q.cable_type) IS NOT NULL)
SELECT query, record, items, score, greatest(0.2::DOUBLE, least(0.99::DOUBLE, CAST(score AS DOUBLE) / greatest({FULL}, possible))) AS confidence FROM p WHERE score > 0 AND NOT (mismatch AND score < greatest({LEAST}, possible * {LEAST_SHARE}::DOUBLE))"""


def split_items(message: Column) -> Column:
    """Item queries of a message: lines, `;` or two blanks part them; without these, commas that touch no digit; parts of one letter go then."""
    direct = F.filter(F.transform(F.split(message, r"\n+|;|\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    commas = F.filter(F.transform(F.split(message, r"(?<!\d),(?!\d)"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    return F.when(F.size(direct) > 1, direct).when(F.size(commas) > 1, commas).otherwise(F.filter(F.array(F.trim(message)), lambda p: p != ""))


def message_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, item_no, item: over all turns of users."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return rows.select("conv_id", "turn", F.posexplode(split_items(F.col("text"))).alias("item_no", "item"))


_TRIM = "lambda x: trim(x)"
SPLIT_SQL = f"""WITH m AS (SELECT conv_id, turn, text, regexp_replace(text, '(^|[^0-9]),(,*)([^0-9]|$)', '\\1' || chr(1) || '\\2\\3', 'g') AS c FROM conversations WHERE role = 'user' AND text IS NOT NULL),
d AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '\\n+|;|\\s{{2,}}', chr(2), 'g'), chr(2)), {_TRIM}), lambda x: x <> '') AS direct, list_filter(list_transform(string_split(c, chr(1)), {_TRIM}), lambda x: length(x) >= 2) AS commas FROM m),
p AS (SELECT conv_id, turn, CASE WHEN len(direct) > 1 THEN direct WHEN len(commas) > 1 THEN commas ELSE list_filter([trim(text)], lambda x: x <> '') END AS parts FROM d)
SELECT conv_id, turn, CAST(i AS INTEGER) AS item_no, parts[i + 1] AS item FROM p, LATERAL (SELECT unnest(range(0, len(parts))) AS i)"""

# Units in queries, those of them that are sold by, words that are no product, and the rewrites of compact forms in order.
SALES = r"bdls?|bundles?|bags?|boxes|box|cases?|coils?|rolls?|pairs?|pieces?|pcs?|nos?|numbers?|kg|kilograms?|ltrs?|lit(?:er|re)s?|pkts?|packets?|sets?|sq\.?\s*ft|sqft|sq\.?\s*m|sqm|tins?|tons?|unts?|units?|dozens?"
MEASURES = r"sq\.?\s*mm|sqmm|mm|mtrs?\.?|met(?:er|re)s?|m|cores?|core|c"
NO_PRODUCT = "add and as for give line lines need per please price prices qty quantity quote rate rates show to what wire wires bundle bundles bdl".split()
COMPACT = [
    (r"(\d),(\d)", "$1.$2"), (r"(?i)\bcabels?\b", "cable"), (r"(?i)\bscensior\b", "sensor"), (r"(?i)\bcopp?ers?\b", "copper"), (r"(?i)\barm\b", "armoured"), ("[×*]", "x"), (r"(?i)\bbdls?\b", "bundle"), (r"(?i)\bbundles?\b", "bundle"),
    (r"(?i)\b(fr|frls?h?|hffr|zhfr)\s*wires?\b", "$1 wire"), (r"(?i)(\d+(?:\.\d+)?)\s*sq\.?\s*mm\s*x\s*sc\b", "$1 sqmm 1 core"), (r"(?i)(\d+(?:\.\d+)?)\s*sq\.?\s*mm\s*x\s*(\d+(?:\.\d+)?)\s*(?:cores?|c)\b", "$1 sqmm $2 core"),
    (r"(?i)(\d+(?:\.\d+)?)\s*mm\s*x\s*(\d+(?:\.\d+)?)\s*(?:cores?|c)\b", "$1 mm $2 core"), (r"(?i)(\d+(?:\.\d+)?)\s*sq\.?\s*mm\b", "$1 sqmm"), (r"(?i)(\d+(?:\.\d+)?)\s*(?:cores?|c)\b", "$1 core"),
    (r"(?i)(\d+(?:\.\d+)?)\s*m\b", "$1 meter"), (r"(?i)(\d+(?:\.\d+)?)\s*(?:mtrs?\.?|met(?:er|re)s?)\b", "$1 meter"),
]
COMPACT_ELECTRICAL = [(r"(?i)\bsingle\s*core\b", "1 core"), (r"(?i)\bsc\b", "1 core"), (r"(?i)\bmulti\s*core\b", "multi core"), (r"(?i)(\d+(?:\.\d+)?)\s*mm\b", "$1 sqmm")]
IS_ELECTRICAL = r"(?i)\b(?:wires?|cabels?|cables?|xlpe|fr|frls?h?|hffr|zhfr|sqmm|cores?|flx|flexible|copp?er|cu|arm|shielded|screened)\b"
KNOWN_UNITS = sorted({w for u, words in UNIT_WORDS for w in [u, *words.replace("?", "").split("|")]} | set("sqmm mm meter m mtr mtrs core c pair piece pc pcs no nos".split()))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(ascii_words(pattern)), F.lit(0))


def _unit(c: Column) -> Column:
    u = F.replace(F.lower(c), F.lit("."), F.lit(""))
    u = F.when(u.rlike(r"^sq\s*mm$"), "sqmm").when(u.rlike(r"^(?:m|met(?:er|re)s?|mtrs?)$"), "meter").when(u.rlike("^(?:c|cores?)$"), "core").when(u.rlike(r"^sq\s*ft$"), "sqft").when(u.rlike(r"^sq\s*m$"), "sqm").when(u == "bdl", "bundle").otherwise(u)
    return normalize_unit(F.regexp_replace(u, "^(box|piece|coil|roll|pair|set|bag|case|tin|ton|bundle|bdl|kilogram)(?:es|s)$", "$1"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """The columns of queries (query) and normalized, match (N1, whole and without what is ordered), requested and hints (arrays), terms, requested_unit, intent, and for scoring search_terms, query_identity, query_numbers. A null query counts as empty."""
    c = F.coalesce("query", F.lit(""))
    is_electrical = c.rlike(ascii_words(IS_ELECTRICAL)) & ~c.rlike(ascii_words(r"(?i)\b(?:telephone|jelly|pair)\b"))
    for pattern, to in COMPACT:
        c = F.regexp_replace(c, ascii_words(pattern), to)
    rows = queries.withColumn("expanded", c)
    more = reduce(lambda e, p: F.regexp_replace(e, ascii_words(p[0]), p[1]), COMPACT_ELECTRICAL, F.col("expanded"))
    rows = rows.withColumn("expanded", F.when(is_electrical, more).otherwise(F.col("expanded"))).withColumn("normalized", normalize_n1(F.col("expanded")))
    number = F.lit(r"^(\d+(?:\.\d+)?)")

    def amount(raw: Column, unit: Column) -> Column:
        return F.struct(F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).cast("double").alias("value"), unit.alias("unit"), raw.alias("raw"))

    e = F.col("expanded")
    sold = F.transform(_all(e, rf"(?i)\b(?:\d+(?:\.\d+)?)\s*(?:{SALES})\b"), lambda r: amount(r, _unit(F.trim(F.regexp_replace(r, number, F.lit(""))))))
    sold = F.filter(sold, lambda s: ~((s["unit"] == "pair") & e.rlike(ascii_words(r"(?i)\b(?:telephone|jelly|cables?)\b"))))
    quantity = F.transform(_all(e, r"(?i)\b(?:qty|quantity)\s*[:#-]?\s*(?:\d+(?:\.\d+)?)\b"), lambda r: amount(r, F.lit(None).cast("string")))
    by_metre = F.col("normalized").rlike(ascii_words(r"\b(?:armoured|cable|copper|aluminium)\b")) & ~F.col("normalized").rlike(ascii_words(r"\b(?:fr|frls|frlsh|hffr|zhfr)\b"))
    metres = F.transform(_all(e, r"(?i)\b(?:\d+(?:\.\d+)?)\s*(?:meter|mtrs?\.?|met(?:er|re)s?)\b"), lambda r: amount(r, F.lit("meter")))
    rows = rows.withColumn("requested", F.array_distinct(F.concat(sold, quantity, F.when(by_metre, metres).otherwise(F.slice(metres, 1, 0)))))

    def without(text: Column, asked: Column) -> Column:
        at = F.position(asked["raw"], text)
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(asked["raw"]), F.length(text)))).otherwise(text)

    rows = rows.withColumn("rest", F.trim(F.regexp_replace(F.aggregate("requested", e, without), r"\s+", " "))).withColumn("match", normalize_n1(F.col("rest")))

    def hint(raw: Column) -> Column:
        u = _unit(F.trim(F.regexp_replace(raw, number, F.lit(""))))
        name = F.when(u == "sqmm", "size").when(u == "core", "cores").when(u == "meter", "length").otherwise(u)
        value = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).cast("double")
        plain = F.regexp_replace(value.cast("string"), r"\.0$", "")
        return F.struct(name.alias("name"), value.alias("value"), F.when(u != "core", u).alias("unit"), raw.alias("raw"), plain.alias("plain"), F.concat(plain, F.lit(" "), u).alias("phrase"), normalize_n1(raw).alias("normal"))

    rows = rows.withColumn("hints", F.transform(_all(F.col("rest"), rf"(?i)(?:\d+(?:\.\d+)?)\s*(?:{MEASURES}|{SALES})\b"), hint))
    terms = F.filter(tokens(F.col("match")), lambda t: ~t.isin(NO_PRODUCT) & ~t.isin(KNOWN_UNITS) & ~t.rlike(r"^[.\d]+$"))
    per = F.nullif(F.regexp_extract(e, ascii_words(rf"(?i)\bper\s+({MEASURES}|{SALES})\b"), 1), F.lit(""))
    intent = F.when(F.lower("query").rlike(ascii_words(r"\b(?:quote|quotation|proforma|add)\b")), "quote").otherwise("price_lookup")
    rows = rows.withColumn("terms", terms).withColumn("requested_unit", F.when(per.isNotNull(), _unit(per))).withColumn("intent", intent).drop("expanded", "rest")
    spare = F.filter(tokens(F.col("normalized")), lambda t: ~t.isin("core", "sqmm", "meter") & ~t.rlike(r"^\d+(?:\.\d+)?$") & ~F.exists("hints", lambda h: F.coalesce(h["unit"], h["name"]) == t))
    numbers = F.transform(F.filter(F.split("match", " "), lambda t: t.rlike(r"^\d+(?:\.\d+)?$")), lambda t: F.regexp_replace(t, r"^0+(\d)", "$1"))
    rows = rows.withColumn("search_terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(spare))
    return rows.withColumn("query_identity", _identity(F.col("match"))).withColumn("query_numbers", F.array_distinct(numbers))


# Weights of the candidate score, words that identify no row, families of products that cables conflict with, fittings, and words of specifications and prices.
WEIGHTS = {
    "numeric_attribute": 0.24, "unit": 0.08, "product_term": 0.18, "row": 0.12, "column": 0.10, "parent": 0.07, "title": 0.06, "section": 0.07, "vendor": 0.05, "price": 0.08, "parser": 0.04, "page": 0.03,
    "alias": 0.02, "recency": 0.02, "recall": 0.04, "exact": 0.07, "row_identity": 0.32, "numeric_identity": 0.14,
}
NO_IDENTITY = "a and as code for hsn is per price rate the sqmm mm".split()
FAMILIES = [["conduit", "pipe", "mms", "pvc"], ["junction", "way"], ["coupler"], ["bend"], ["solvent", "cement"], ["fan", "rod"]]
NO_FAMILY = ["cable", "conductor", "current", "amps", "wire"]
FITTINGS = "bend clip coupler elbow junction tee connector valve trap".split()
SPEC_WORDS = ["outside diameter", "inside diameter", "nominal size", "minimum", "min", "maximum", "max", "thickness", "width", "height", "depth", "current amps", "current", "amps", "ampere", "resistance", "weight", "dimension"]
PRICE_SIGNS = ["amount", "basic rate", "basic price", "list price", "mrp", "price", "rate", "rs", "inr"]
ALIKE = [("frls", "frlsh"), ("armored", "armoured"), ("unarmored", "unarmoured"), ("shielded", "screened"), ("screened", "shielded")]


def word_in(text: Column, word: Column) -> Column:
    """Whether a normalized text has a word, or its plural or singular, or a spelling that counts as the same; anything but letters: as a substring."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def has(w: Column) -> Column:
        return padded.contains(F.concat(F.lit(" "), w, F.lit(" ")))

    same = has(word) | has(F.concat(word, F.lit("s"))) | (word.endswith("s") & has(F.regexp_replace(word, "s$", "")))
    alike = F.create_map(*[F.lit(w) for pair in ALIKE for w in pair])
    same = same | F.coalesce(has(F.try_element_at(alike, word)), F.lit(False))
    return F.when(word == "", F.lit(False)).when(word.rlike("^[a-z]+$"), same).otherwise(text.contains(word))


def any_pattern(words: list[str]) -> str:
    """A pattern that a normalized text holds where word_in holds for one of several fixed words."""
    single = [w for w in words if w.isalpha()]
    forms = {f for w in single for f in [w, w + "s", *([w[:-1]] if w.endswith("s") else []), *[b for a, b in ALIKE if a == w]]}
    return "|".join([f"(?:^| )(?:{'|'.join(sorted(forms))})(?: |$)", *[w for w in words if not w.isalpha()]])


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike(any_pattern(words))


def _identity(text: Column) -> Column:
    found = F.filter(tokens(text), lambda t: ~t.isin(NO_IDENTITY))
    keys = F.transform(found, lambda t: F.regexp_replace(t, r"^0+(\d)", "$1"))
    return F.filter(found, lambda t, i: F.array_position(keys, F.regexp_replace(t, r"^0+(\d)", "$1")) == i + 1)


def candidates(rows: DataFrame) -> DataFrame:
    """The columns of rows and the normalized texts that score_candidates reads; computed once a candidate, before queries meet it.

    rows: searchable, product, sku, unit, description, rows, columns, parents, title, section, vendor, raw_cell (texts), price, page, confidence, recall, recency, duplicate (boolean),
    attributes (array of name, value, unit). Null texts count as empty.
    """
    texts = {t: [t] for t in ["searchable", "rows", "columns", "parents", "title", "section", "vendor"]}
    texts |= {"id": ["product", "sku", "unit", "description", "rows", "columns"], "all": ["searchable", "product", "sku", "description", "rows", "columns"]}
    texts |= {"cell": ["title", "rows", "columns", "parents", "description", "product", "raw_cell"]}
    out = rows.select("*", *[normalize_n1(F.concat_ws(" ", *c)).alias(f"_{t}") for t, c in texts.items()], normalize_unit(normalize_n1(F.col("unit"))).alias("_unit"))
    return out.withColumn("_ci", _identity(F.col("_id"))).withColumn("_not_price", _any(F.col("_cell"), SPEC_WORDS) & ~_any(F.col("_cell"), PRICE_SIGNS))


def score_candidates(pairs: DataFrame) -> DataFrame:
    """The columns of pairs without helpers, and score (0 to 1, four decimals), label.

    pairs: a row per query and candidate, with the columns of parse_queries and candidates, and vendor_terms (array of normalized names), alias_confidence (least of the aliases used, or null).
    """
    W = WEIGHTS
    p = pairs

    def phrase(text: Column) -> Column:
        return F.concat(F.lit(" "), F.col("_all"), F.lit(" ")).contains(F.concat(F.lit(" "), text, F.lit(" ")))

    def state(h: Column) -> Column:
        own = F.filter("attributes", lambda a: a["name"] == h["name"])
        same = F.exists(own, lambda a: (a["value"] == h["value"]) & (h["unit"].isNull() | a["unit"].isNull() | (a["unit"] == h["unit"])))
        return F.when(same | phrase(h["phrase"]), "matched").when(F.size(own) > 0, "conflict").otherwise("missing")

    p = p.withColumn("_states", F.transform("hints", lambda h: F.struct(state(h).alias("s"), h["name"].alias("name"))))
    p = p.withColumn("_n", F.size("hints")).withColumn("_matched", F.size(F.filter("_states", lambda s: s["s"] == "matched"))).withColumn("_missing", F.size(F.filter("_states", lambda s: s["s"] == "missing")))
    p = p.withColumn("_conflicts", F.filter("_states", lambda s: s["s"] == "conflict")).withColumn("_nt", F.size("search_terms"))
    compact = F.replace(F.col("_searchable"), F.lit(" "), F.lit(""))
    hit = F.size(F.filter("search_terms", lambda t: word_in(F.col("_searchable"), t) | (~t.rlike("^[a-z]+$") & compact.contains(t))))
    p = p.withColumn("_ratio", F.when(F.col("_nt") == 0, 1.0).otherwise(hit / F.col("_nt")))

    def terms_in(text: str) -> Column:
        return F.exists("search_terms", lambda t: word_in(F.col(text), t))

    def first(array: str) -> Column:
        return F.try_element_at(F.filter(array, lambda a: a["name"] == "size"), F.lit(1))["value"]

    asked, own = first("hints"), first("attributes")
    s = F.when(F.col("_n") > 0, W["numeric_attribute"] * F.col("_matched") / F.col("_n")).otherwise(0.0)
    s = s + F.when(asked != own, F.greatest(F.lit(0.0), F.lit(0.08) - F.abs(asked - own) / F.greatest(asked, own, F.lit(1.0)) * 0.1)).otherwise(0.0)
    unit_text = F.col("_unit").isNull() & word_in(F.col("_searchable"), F.coalesce("requested_unit", F.lit("")))
    s = s + F.when(F.col("requested_unit").isNull(), F.when(F.col("_unit").isNotNull(), W["unit"] * 0.5).otherwise(0.0)).when((F.col("_unit") == F.col("requested_unit")) | unit_text, W["unit"]).when(F.col("_unit").isNotNull(), -0.25).otherwise(0.0)
    s = s + F.when(F.col("_nt") > 0, W["product_term"] * F.col("_ratio")).otherwise(0.0)
    in_column = terms_in("_columns") | F.exists("hints", lambda h: F.col("_columns").contains(h["normal"]))
    in_section = terms_in("_section") | ((F.col("_n") > 0) & F.forall("hints", lambda h: F.col("_section").contains(h["plain"])))
    of_vendor = (F.col("_vendor") != "") & F.exists("vendor_terms", lambda t: word_in(F.col("_vendor"), t))
    for found, name in [(terms_in("_rows"), "row"), (in_column, "column"), (terms_in("_parents"), "parent"), (terms_in("_title"), "title"), (in_section, "section"), (of_vendor, "vendor"), (F.col("price") > 0, "price"), (F.col("page").isNotNull(), "page")]:
        s = s + F.when(found, W[name]).otherwise(0.0)
    for column, name in [("confidence", "parser"), ("recency", "recency"), ("recall", "recall")]:
        s = s + W[name] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(column, F.lit(0.0))))

    nq = F.size("query_identity")
    identity = F.size(F.filter("query_identity", lambda t: word_in(F.col("_id"), t))) / F.greatest(nq, F.lit(1))
    judged, conflicts = (F.size("terms") > 0) & (nq >= 3), F.size("_conflicts")
    exact = judged & (identity >= 0.95) & (conflicts == 0) & (F.col("_ratio") >= 0.6)
    p = p.withColumn("_exact", exact)
    s = s + F.when(judged, W["row_identity"] * identity - F.when(identity >= 0.85, 0.0).otherwise(F.least(F.lit(0.22), 0.22 * (1 - identity))) + F.when(exact, 0.08).otherwise(0.0)).otherwise(0.0)
    extra = F.size(F.filter("_ci", lambda t: ~F.exists("query_identity", lambda q: word_in(q, t)))) / F.greatest(F.size("_ci"), F.lit(1))
    s = s - F.when((nq >= 3) & (F.size("_ci") > nq * 1.8) & (extra > 0.45), F.least(F.lit(0.18), 0.22 * extra)).otherwise(0.0)
    nn = F.size("query_numbers")
    numeric = F.size(F.filter("query_numbers", lambda t: word_in(F.col("_id"), t))) / F.greatest(nn, F.lit(1))
    s = s + F.when(nn >= 2, W["numeric_identity"] * numeric - F.when(numeric >= 0.9, 0.0).otherwise(F.least(F.lit(0.28), 0.45 * (1 - numeric)))).otherwise(0.0)
    s = s + F.when((F.col("_n") >= 2) & (F.size("terms") > 0) & (F.col("_matched") == F.col("_n")) & (F.col("_ratio") >= 0.75), W["exact"]).otherwise(0.0)
    s = s + F.coalesce(W["alias"] * F.col("alias_confidence"), F.lit(0.0))
    cost = F.aggregate("_conflicts", F.lit(0.0), lambda a, c: a + F.when(c["name"].isin("size", "cores", "length"), 0.24).otherwise(0.1))
    s = s - F.least(F.lit(0.5), cost) - F.least(F.lit(0.24), 0.06 * F.col("_missing"))
    p = p.withColumn("_few", (nn >= 2) & (numeric < 0.9))

    def cap(when: Column, most: float, less: float = 0.0) -> None:
        nonlocal s
        when = F.coalesce(when, F.lit(False))
        s = F.least(s - F.when(when, less).otherwise(0.0), F.when(when, most).otherwise(9.0))

    i, asks = F.col("_id"), lambda *words: F.arrays_overlap("terms", F.array(*map(F.lit, words)))
    cap(F.size("_conflicts") > 0, 0.78)
    cap((F.col("_missing") > 0) & ~F.col("_exact"), 0.84)
    cap(~F.col("_exact") & ((F.col("_ratio") < 1) | F.col("_few")), 0.84)
    cap(F.col("normalized").rlike(ascii_words(r"\bper meter\b")) & i.rlike(ascii_words(r"\bcoil\b")), 9.0, 0.12)
    cap(asks("armoured", "armored") & ~_any(i, ["armoured"]), 0.64)
    cap(asks("unarmoured", "unarmored") & _any(i, ["armoured"]) & ~_any(i, ["unarmoured"]), 0.64)
    cap(asks("copper") & _any(i, ["aluminium"]) & ~_any(i, ["copper"]), 0.64)
    cap(asks("aluminium") & _any(i, ["copper"]) & ~_any(i, ["aluminium"]), 0.64)
    cap(~F.coalesce(asks("speaker"), F.lit(False)) & _any(i, ["speaker"]), 9.0, 0.6)
    cap(asks("pipe") & ~asks(*FITTINGS) & _any(i, FITTINGS), 0.72, 0.16)
    wanted, had = F.array_join("terms", " "), F.concat_ws(" ", "_id", "_searchable")
    cap(reduce(lambda a, f: a | (_any(wanted, f) & (~_any(had, f) | _any(had, NO_FAMILY))), FAMILIES, F.lit(False)), 0.34, 0.35)
    cap(F.col("_not_price"), 0.49)
    cap(F.col("duplicate"), 9.0, 0.03)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)
    label = F.when(F.col("score") >= 0.85, "Matched").when(F.col("score") >= 0.65, "Needs review").otherwise("Not reliable enough")
    kept = [c for c in pairs.columns if not c.startswith("_")]
    return p.select(*kept, score.alias("score")).withColumn("label", label)


QUERIES = {
    "normalize_n2": second_dialect, "electrical_intent": electrical_intent, "price_basis": bases, "quotation_rate": rates, "electrical_match": matched_electrical,
    "item_query_split": message_items,
}
SQL = {
    "normalize_n2": f"WITH i AS ({ITEMS}), n AS (SELECT id, {normalize_n2_sql('name')} AS normal FROM i) SELECT id, normal, replace(normal, ' ', '') AS compact FROM n",
    "electrical_intent": f"WITH i AS ({ITEMS}), n AS (SELECT id, {normalize_n2_sql('name')} AS n FROM i) SELECT id, {electrical_sql('n')} FROM n",
    "price_basis": BASES_SQL,
    "quotation_rate": RATES_SQL,
    "electrical_match": _match_sql(),
    "item_query_split": SPLIT_SQL,
}
