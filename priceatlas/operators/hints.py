"""What a query's words stand for: aliases applied one after the other, vendors that its words hint at, and candidates of several paths reduced to one each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.stored import stored
from priceatlas.functions.text import normalize_n1, normalize_n1_sql, tokens, tokens_sql
from priceatlas.operators.recall import _rarest
from priceatlas.plans.entities import table

# Seed aliases with their confidence, unit words, least confidences, most loaded aliases, and words that name no product.
SEEDS = [("sq mm", "sqmm", 0.98), ("sq.mm", "sqmm", 0.98), ("mtr", "meter", 0.95), ("mtrs", "meter", 0.95), ("pc", "piece", 0.9), ("pcs", "piece", 0.9), ("cabel", "cable", 0.92), ("cabels", "cable", 0.92), ("scensior", "sensor", 0.86)]
UNIT_ALIASES = [
    ("piece", "nos no number numbers"), ("meter", "mtr mtrs meter meters metre metres m"), ("bag", "bag bags"), ("bundle", "bdl bdls bundle bundles"), ("box", "box boxes"), ("case", "case"), ("coil", "coil coils"), ("kg", "kg kilogram kilograms"),
    ("litre", "ltr ltrs litre litres liter liters"), ("packet", "pkt packet packets"), ("roll", "roll rolls"), ("set", "set sets"), ("sqft", "sqft,sq ft,square feet,square foot"), ("sqm", "sqm,sq m,square meter,square meters,square metre,square metres"),
    ("tin", "tin tins"), ("ton", "ton tons"), ("unit", "unt unit units"), ("dozen", "dozen dozens"),
]
UNIT_SURE, LEAST, SURE, MOST = 0.94, 0.35, 0.65, 500
NO_PRODUCT, OVERLAP = ["with", "of", "for", "type"], 0.7


def built_in() -> list[tuple[str, str, float]]:
    units = [(a, unit, UNIT_SURE) for unit, words in UNIT_ALIASES for a in (words.split(",") if "," in words else words.split())]
    return SEEDS + units


def loaded_aliases(spark: SparkSession, stored_aliases: DataFrame, vendor: int | None = None, document: int | None = None) -> list[dict]:
    """The built-in aliases, then the MOST surest stored ones that the scope lets through, in the order in which they apply; N1 texts.

    stored_aliases: alias, canonical, confidence, scope (global, tenant, vendor or document), vendor, document. Ties go by alias and canonical. Aliases
    whose alias or canonical is empty as a N1 text do nothing and are left out. At most MOST rows reach the driver.
    """
    best = stored_aliases.where(F.col("confidence") >= LEAST).orderBy(F.desc("confidence"), "alias", "canonical").limit(MOST)
    if vendor is not None:
        best = best.where((F.col("scope") != "vendor") | F.col("vendor").eqNullSafe(F.lit(vendor)))
    best = best.where((F.col("scope") != "document") | F.col("document").eqNullSafe(F.lit(document)) if document is not None else F.col("scope") != "document")
    rows = best.select("alias", "canonical", F.col("confidence").cast("double").alias("confidence"), F.lit(1).alias("late"), F.monotonically_increasing_id().alias("n"))
    seeds = spark.createDataFrame([(a, c, s, 0, i) for i, (a, c, s) in enumerate(built_in())], "alias string, canonical string, confidence double, late int, n long")
    out = seeds.unionByName(rows).select("late", "n", "alias", "canonical", "confidence", normalize_n1(F.col("alias")).alias("old"), normalize_n1(F.col("canonical")).alias("new")).collect()
    order = sorted(out, key=lambda r: (r.late, -r.confidence if r.late else 0, r.alias if r.late else "", r.canonical if r.late else "", r.n))
    return [r.asDict() for r in order if r.old and r.new and r.old != r.new]


def apply_aliases(queries: DataFrame, aliases: list[dict]) -> DataFrame:
    """queries (query, terms: array of texts, or null) with `rewritten`, `used` and `unsure` (the aliases that changed it, by confidence) and `product_terms`.

    Each alias replaces whole words in what the ones before have left; terms see the sure ones alone. Null queries are empty.
    """
    wide = lambda t: " " + t.replace(" ", "  ") + " "  # words that touch keep a blank each
    rows = [{"alias": a["alias"], "old": wide(a["old"]), "new": wide(a["new"]), "sure": a["confidence"] >= SURE} for a in aliases]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<alias:string,old:string,new:string,sure:boolean>>")
    sure = F.from_json(F.lit(json.dumps([r for r in rows if r["sure"]])), "array<struct<alias:string,old:string,new:string,sure:boolean>>")

    def spread(c: Column) -> Column:
        return F.concat(F.lit(" "), F.replace(normalize_n1(c), F.lit(" "), F.lit("  ")), F.lit(" "))

    def close(c: Column) -> Column:
        return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))

    def step(s: Column, a: Column) -> Column:
        after = F.replace(s["text"], a["old"], a["new"])
        changed = after != s["text"]
        names = lambda part, ok: F.when(changed & (a["sure"] == ok), F.concat(s[part], F.array(a["alias"]))).otherwise(s[part]).alias(part)
        return F.struct(after.alias("text"), names("used", True), names("unsure", False))

    empty = F.array().cast("array<string>")
    start = F.struct(spread(F.col("query")).alias("text"), empty.alias("used"), empty.alias("unsure"))
    folded = queries.withColumn("folded", F.aggregate(known, start, step))
    terms = F.transform(F.coalesce("terms", empty), lambda t: close(F.aggregate(sure, spread(t), lambda s, a: F.replace(s, a["old"], a["new"]))))
    return folded.select(*[F.col(f"`{c}`") for c in queries.columns], close(F.col("folded.text")).alias("rewritten"), "folded.used", "folded.unsure", terms.alias("product_terms"))


def holding(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """text, phrase: texts that hold all words of the phrase side by side; both N1 texts, met by the phrase's rarest word."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    posts = texts.select("text", F.explode(F.array_distinct(words(F.col("text")))).alias("x"))
    often = posts.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    keys = _rarest(phrases.where("phrase <> ''").select("phrase", words(F.col("phrase")).alias("w")), ["phrase"], "w", often, F.lit(1))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return keys.join(posts, "x").where(F.contains(padded(F.col("text")), padded(F.col("phrase")))).select("text", "phrase")


def vendor_hints(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query, vendors: sorted N1 names of vendors (or their first words) that a query's words hold, and of the only vendors of products it tells.

    dictionary: vendor, product. A product is told if its words stand in the query side by side, or if two of its words at least, and OVERLAP of them, are in it.
    A product's match needs one of its rarest words, so no product meets all queries. Queries without hints, and null ones, have no row; repeated ones one.
    """
    texts = stored(queries.where("query is not null").select("query").distinct().select("query", normalize_n1(F.col("query")).alias("text")), "hint-texts")
    own = texts.select("text").where("text <> ''").distinct()
    known = stored(dictionary.select(normalize_n1(F.col("vendor")).alias("vendor"), normalize_n1(F.col("product")).alias("product")).distinct(), "hint-dictionary")
    names = known.select(F.explode(F.array("vendor", F.get(F.split("vendor", " "), F.lit(0)))).alias("phrase")).distinct()
    found = holding(own, names).select("text", F.col("phrase").alias("vendor"))

    single = known.where("product <> ''").groupBy("product").agg(F.min("vendor").alias("vendor"), F.count(F.lit(1)).alias("n")).where("n = 1 and vendor <> ''")
    said = holding(own, single.select(F.col("product").alias("phrase"))).select("text", F.col("phrase").alias("product"))
    asked = own.select("text", tokens(F.col("text")).alias("tokens"))
    posts = asked.select("text", F.explode("tokens").alias("x"))
    parts = single.select("product", F.filter(tokens(F.col("product")), lambda t: ~t.isin(NO_PRODUCT)).alias("parts")).where(F.size("parts") >= 2)
    often = posts.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    least = F.greatest(F.lit(2), F.ceil(OVERLAP * F.col("size") - 1e-9))
    met = _rarest(parts, ["product"], "parts", often, F.col("size") - least + 1).join(posts, "x").select("product", "text").distinct()
    shared = F.size(F.array_intersect("parts", "tokens"))
    told = met.join(parts, "product").join(asked, "text").where((shared >= 2) & (shared / F.size("parts") >= OVERLAP)).select("text", "product")
    found = found.unionByName(said.unionByName(told).distinct().join(single, "product").select("text", "vendor"))
    return found.distinct().groupBy("text").agg(F.sort_array(F.collect_set("vendor")).alias("vendors")).join(texts, "text").select("query", "vendors")


def best_evidence(candidates: DataFrame, limit: int) -> DataFrame:
    """query, rank, key and the candidate (all its columns) of each key, in the order of the keys' first places; the first limit keys of a query.

    candidates: query, ord, legacy_id, record_id, document_id, text, price, score. The key is the legacy id, else the record id, else document, text and price.
    In the order of ord, a later candidate takes the place of the one held if it alone has a record id, or if its score is higher; so the order decides.
    A key's candidates, one for each path and place that recalled it, are one list; ties in ord go by record id and score.
    """
    key = F.when(F.col("legacy_id").isNotNull(), F.concat(F.lit("legacy:"), F.col("legacy_id").cast("string"))).when(F.col("record_id").isNotNull(), F.col("record_id").cast("string"))
    key = F.coalesce(key, F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("document_id", "text", "price")]))
    fields = ["ord", "record_id", "score", "legacy_id", "document_id", "text", "price"]
    lists = candidates.withColumn("key", key).groupBy("query", "key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))

    def step(held: Column, c: Column) -> Column:
        takes = (c["record_id"].isNotNull() & held["record_id"].isNull()) | (F.coalesce(c["score"], F.lit(0.0)) > F.coalesce(held["score"], F.lit(0.0)))
        return F.when(takes, c).otherwise(held)

    kept = lists.select("query", "key", F.get("c", F.lit(0))["ord"].alias("first"), F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.get("c", F.lit(0)), step).alias("best"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("first", "key"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "key", *[f"best.{f}" for f in fields])


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, terms: each distinct name, brand and type of a part with a number of coils."""
    p = table(spark, sf_dir, "part")
    return p.where("p_name is not null").select(F.concat_ws(" ", "p_name", "p_brand", F.lit("12 coils"), "p_type").alias("query"), F.array("p_brand", "p_type").alias("terms")).distinct()


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands stand for the type of their first part, types for words of their own: chains, so that the order decides what an alias sees."""
    p = table(spark, sf_dir, "part")
    brands = p.where("p_brand is not null").groupBy(F.col("p_brand").alias("alias")).agg(F.min_by("p_type", "p_partkey").alias("canonical"), F.min("p_partkey").alias("n"))
    types = p.where("p_type is not null").groupBy(F.col("p_type").alias("alias")).agg(F.min("p_partkey").alias("n")).withColumn("canonical", F.concat(F.lit("kind "), (F.col("n") % 9).cast("string"), F.lit(" coil")))
    both = brands.select("alias", "canonical", "n").unionByName(types.select("alias", "canonical", "n"))
    scope = F.when(F.col("n") % 11 == 0, "document").otherwise("global")
    return both.select("alias", "canonical", (F.lit(0.3) + (F.col("n") % 7) / 10).alias("confidence"), scope.alias("scope"), F.lit(None).cast("long").alias("vendor"), F.lit(None).cast("long").alias("document"))


def alias_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_aliases(part_texts(spark, sf_dir), loaded_aliases(spark, part_aliases(spark, sf_dir)))
    return found.select("query", "rewritten", F.array_join("used", "|").alias("used"), F.array_join("unsure", "|").alias("unsure"), F.array_join("product_terms", "|").alias("product_terms"))


def vendor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    sold = p.join(first, p.p_partkey == first.l_partkey).join(s, "s_suppkey")
    dictionary = sold.select(F.col("s_name").alias("vendor"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("product")).distinct()
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", F.lit("rate of"), "p_type", "p_name", "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "s_name", F.lit("list"))).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    return vendor_hints(sold.select(text.alias("query")), dictionary).select("query", F.array_join("vendors", "|").alias("vendors"))


def reduced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three paths recall parts for each brand and type: records, old items (every third has no record), and notes without ids; 40 a query stay."""
    p = table(spark, sf_dir, "part").where("p_brand is not null").select(F.col("p_brand").alias("query"), "p_partkey", "p_name", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    score = lambda f, m: ((k * f) % m / m).cast("double")
    legacy = F.when(k % 2 == 0, k)
    paths = [
        p.select("query", (k * 10).alias("ord"), legacy.alias("legacy_id"), k.alias("record_id"), score(7, 11).alias("score"), "p_size", "p_name", "p_retailprice"),
        p.where(k % 2 == 0).select("query", (k * 5 + 3).alias("ord"), legacy.alias("legacy_id"), F.when(k % 3 > 0, k).alias("record_id"), score(5, 13).alias("score"), "p_size", "p_name", "p_retailprice"),
        p.select("query", (k * 20 + 1).alias("ord"), F.lit(None).cast("long").alias("legacy_id"), F.lit(None).cast("long").alias("record_id"), score(3, 17).alias("score"), "p_size", "p_name", "p_retailprice"),
    ]
    every = paths[0].unionByName(paths[1]).unionByName(paths[2])
    found = best_evidence(every.select("query", "ord", "legacy_id", "record_id", F.col("p_size").alias("document_id"), F.col("p_name").alias("text"), F.floor("p_retailprice").alias("price"), "score"), 40)
    return found.select("query", "rank", "key", "ord", "record_id", "score")


_SEEDS = ", ".join(f"({i}, '{a}', '{c}', {s})" for i, (a, c, s) in enumerate(built_in()))
_FIRST = "SELECT p_partkey, p_name, p_brand, p_type, s_name FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = k"
ALIASES_SQL = f"""WITH RECURSIVE b AS (SELECT p_brand AS alias, arg_min(p_type, p_partkey) AS canonical, min(p_partkey) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1
UNION ALL SELECT p_type, 'kind ' || (min(p_partkey) % 9) || ' coil', min(p_partkey) FROM part WHERE p_type IS NOT NULL GROUP BY 1),
l AS (SELECT *, 0.3::DOUBLE + (n % 7)::DOUBLE / 10 AS confidence FROM b), o AS (SELECT * FROM l WHERE confidence >= {LEAST}::DOUBLE ORDER BY confidence DESC, alias, canonical LIMIT {MOST}),
a0 AS (SELECT 0 AS late, i AS r, alias, canonical, s::DOUBLE AS confidence FROM (VALUES {_SEEDS}) v(i, alias, canonical, s)
UNION ALL SELECT 1, row_number() OVER (ORDER BY confidence DESC, alias, canonical), alias, canonical, confidence FROM o WHERE n % 11 <> 0),
a AS (SELECT row_number() OVER (ORDER BY late, r) AS k, alias, confidence >= {SURE}::DOUBLE AS sure, {normalize_n1_sql('alias')} AS old, {normalize_n1_sql('canonical')} AS new FROM a0),
q AS (SELECT DISTINCT concat_ws(' ', p_name, p_brand, '12 coils', p_type) AS query, p_brand, p_type FROM part WHERE p_name IS NOT NULL),
t AS (SELECT query, 0 AS part, {normalize_n1_sql('query')} AS start FROM q UNION ALL SELECT query, 1, {normalize_n1_sql('p_brand')} FROM q UNION ALL SELECT query, 2, {normalize_n1_sql('p_type')} FROM q),
f AS (SELECT query, part, ' ' || replace(start, ' ', '  ') || ' ' AS text, 0 AS k, [] ::VARCHAR[] AS used, []::VARCHAR[] AS unsure FROM t UNION ALL
SELECT query, part, z, k, CASE WHEN z <> text AND sure THEN list_append(used, alias) ELSE used END, CASE WHEN z <> text AND NOT sure THEN list_append(unsure, alias) ELSE unsure END FROM
(SELECT f.query, f.part, f.text, a.k, f.used, f.unsure, a.alias, a.sure, CASE WHEN a.old <> '' AND a.new <> '' AND a.old <> a.new AND (f.part = 0 OR a.sure) THEN replace(f.text, ' ' || replace(a.old, ' ', '  ') || ' ', ' ' || replace(a.new, ' ', '  ') || ' ') ELSE f.text END AS z FROM f JOIN a ON a.k = f.k + 1)),
e AS (SELECT query, part, trim(replace(text, '  ', ' ')) AS text, used, unsure FROM f WHERE k = (SELECT max(k) FROM a))
SELECT x.query, x.text AS rewritten, array_to_string(x.used, '|') AS used, array_to_string(x.unsure, '|') AS unsure, y.text || '|' || z.text AS product_terms FROM e x JOIN e y ON y.query = x.query AND y.part = 1 JOIN e z ON z.query = x.query AND z.part = 2 WHERE x.part = 0"""
VENDORS_SQL = f"""WITH s AS ({_FIRST}), q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat_ws(' ', 'rate of', p_type, p_name, p_brand) WHEN 1 THEN s_name || ' list' ELSE concat_ws(' ', p_brand, p_name) END AS query FROM s),
n AS (SELECT query, {normalize_n1_sql('query')} AS text FROM q), d AS (SELECT DISTINCT {normalize_n1_sql('s_name')} AS vendor, {normalize_n1_sql("concat_ws(' ', p_name, p_brand, p_type)")} AS product FROM s),
v AS (SELECT vendor FROM d UNION SELECT string_split(vendor, ' ')[1] FROM d), u AS (SELECT product, min(vendor) AS vendor FROM d WHERE product <> '' GROUP BY product HAVING count(*) = 1),
p AS (SELECT product, vendor, list_filter({tokens_sql('product')}, lambda t: t NOT IN ({', '.join(f"'{w}'" for w in NO_PRODUCT)})) AS parts FROM u), w AS (SELECT query, text, {tokens_sql('text')} AS tokens FROM n),
f AS (SELECT query, vendor FROM n JOIN v ON contains(' ' || text || ' ', ' ' || vendor || ' ') UNION
SELECT query, vendor FROM w JOIN p ON contains(' ' || text || ' ', ' ' || product || ' ') OR (len(parts) >= 2 AND len(list_intersect(parts, tokens)) >= 2 AND len(list_intersect(parts, tokens)) / len(parts)::DOUBLE >= {OVERLAP}::DOUBLE))
SELECT query, string_agg(vendor, '|' ORDER BY vendor) AS vendors FROM f GROUP BY query"""
REDUCED_SQL = """WITH RECURSIVE p AS (SELECT p_brand AS query, p_partkey AS k, p_size, p_name, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part WHERE p_brand IS NOT NULL),
c AS (SELECT query, k * 10 AS ord, CASE WHEN k % 2 = 0 THEN k END AS legacy_id, k AS record_id, (k * 7) % 11 / 11::DOUBLE AS score, p_size, p_name, price FROM p
UNION ALL SELECT query, k * 5 + 3, k, CASE WHEN k % 3 > 0 THEN k END, (k * 5) % 13 / 13::DOUBLE, p_size, p_name, price FROM p WHERE k % 2 = 0 UNION ALL SELECT query, k * 20 + 1, NULL, NULL, (k * 3) % 17 / 17::DOUBLE, p_size, p_name, price FROM p),
y AS (SELECT *, coalesce('legacy:' || legacy_id, CAST(record_id AS VARCHAR), concat_ws(':', coalesce(CAST(p_size AS VARCHAR), 'null'), coalesce(p_name, 'null'), coalesce(CAST(price AS VARCHAR), 'null'))) AS key FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY ord, record_id NULLS FIRST, score) AS n, min(ord) OVER (PARTITION BY query, key) AS first FROM y),
f AS (SELECT query, key, first, n, ord, record_id, score FROM o WHERE n = 1 UNION ALL SELECT f.query, f.key, f.first, o.n, CASE WHEN w THEN o.ord ELSE f.ord END, CASE WHEN w THEN o.record_id ELSE f.record_id END, CASE WHEN w THEN o.score ELSE f.score END
FROM f JOIN o ON o.query = f.query AND o.key = f.key AND o.n = f.n + 1, LATERAL (SELECT (o.record_id IS NOT NULL AND f.record_id IS NULL) OR o.score > f.score AS w)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY n DESC) = 1)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY first, key) AS INTEGER) AS rank, key, ord, record_id, score FROM l QUALIFY rank <= 40"""
QUERIES = {"alias_application": alias_application, "vendor_hints": vendor_query, "candidate_reduction": reduced_candidates}
SQL = {"alias_application": ALIASES_SQL, "vendor_hints": VENDORS_SQL, "candidate_reduction": REDUCED_SQL}
