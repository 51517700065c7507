"""Catalogue search over price records: normalisation, recall by trigrams, tokens and attributes, scoring, ranking and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.stored import stored
from priceatlas.functions.text import compact, normalize_n1, normalize_n1_sql, normalize_unit, normalize_unit_sql, parse_price, parse_price_sql, quoted, tokens, tokens_sql, trigrams, trigrams_sql
from priceatlas.plans.entities import PRICE_RECORDS_SQL, price_records

#: Least trigram similarity of a candidate, weights of its score, labels' thresholds, and the cap of near ties.
SIMILAR, W_SIMILAR, W_TOKENS, MATCHED, REVIEW, CAP, NEAR = 0.3, 0.6, 0.4, 0.85, 0.65, 0.84, 0.08
#: Parts of a piece's records.
PARTS = 16
# Unit spellings that the unit query puts to sizes.
SPELLINGS = ["mtrs", "pcs", "boxes", "kg", "coil", "sets", "roll", "nos.", "pair", "ltr"]


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalize_n1(F.col("text"))
    return price_records(spark, sf_dir).select("id", n.alias("normal"), compact(F.col("text")).alias("compact"), F.array_join(tokens(n), ",").alias("tokens"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("id") % len(SPELLINGS) + 1).cast("int"))
    priced = F.concat(F.lit("₹ "), F.format_number(F.col("price"), 2), F.lit(" per "), spelling)
    return price_records(spark, sf_dir).select("id", normalize_unit(normalize_n1(F.concat_ws(" ", F.col("size").cast("string"), spelling))).alias("unit"), parse_price(priced).alias("price"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, product, similarity, coverage: for every distinct product name as a query, the distinct names that share a trigram and reach SIMILAR.

    Both sides are pre-aggregated to distinct texts and meet by postings (an equi-join on trigrams), never pair by pair.
    """
    names = price_records(spark, sf_dir).where("product is not null").select(F.col("product").alias("t")).distinct().select("t", trigrams(F.col("t")).alias("g"), tokens(normalize_n1(F.col("t"))).alias("w"))
    q = names.select(F.col("t").alias("query"), F.size("g").alias("nq"), F.explode("g").alias("gram"))
    p = names.select(F.col("t").alias("product"), F.size("g").alias("np"), F.explode("g").alias("gram"))
    shared = q.join(p, "gram").groupBy("query", "product", "nq", "np").agg(F.count(F.lit(1)).alias("both"))
    near = shared.withColumn("similarity", F.col("both") / (F.col("nq") + F.col("np") - F.col("both"))).where(F.col("similarity") >= SIMILAR)
    near = near.join(names.select(F.col("t").alias("query"), F.col("w").alias("wq")), "query").join(names.select(F.col("t").alias("product"), F.col("w").alias("wp")), "product")
    coverage = F.when(F.size("wq") == 0, 0.0).otherwise(F.size(F.array_intersect("wq", "wp")) / F.size("wq"))
    return near.select("query", "product", "similarity", coverage.alias("coverage"))


_N = f"WITH r AS ({PRICE_RECORDS_SQL}), n AS (SELECT t, {trigrams_sql('t')} AS g, {tokens_sql(normalize_n1_sql('t'))} AS w FROM (SELECT DISTINCT product AS t FROM r WHERE product IS NOT NULL)), " + f"""
c0 AS (SELECT a.t AS query, b.t AS product, len(list_intersect(a.g, b.g)) AS common, len(a.g) AS nq, len(b.g) AS np, a.w AS wq, b.w AS wp FROM n a, n b),
c AS (SELECT query, product, common / CAST(nq + np - common AS DOUBLE) AS similarity, CASE WHEN len(wq) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(wq, wp)) / CAST(len(wq) AS DOUBLE) END AS coverage FROM c0 WHERE common / CAST(nq + np - common AS DOUBLE) >= {SIMILAR})"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, rank, product, score, label, needs_review: the five best names of each query; several near the best are held back for review.

    If a query's best reaches MATCHED and n other names, normalised to another text, reach it too and are within NEAR of the best, the first
    n + 1 by position are capped at CAP. All scored names count, not the five best alone; ranks are those after the cap.
    """
    score = F.round(W_SIMILAR * F.col("similarity") + W_TOKENS * F.col("coverage"), 4)
    return capped_five(candidates(spark, sf_dir).withColumn("score", score))


def capped_five(scored: DataFrame) -> DataFrame:
    """query, rank, product, score, label, needs_review of scored names (query, product, score): see ranked."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "product")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = scored.withColumn("rank", F.row_number().over(w)).withColumn("normal", normalize_n1(F.col("product")))
    rows = rows.withColumn("best", F.first("score").over(whole)).withColumn("best_normal", F.first("normal").over(whole))
    near = (F.col("best") >= MATCHED) & (F.col("score") >= MATCHED) & (F.col("best") - F.col("score") <= NEAR) & (F.col("normal") != F.col("best_normal"))
    rows = rows.withColumn("ties", F.sum(F.when(near, 1).otherwise(0)).over(whole))
    capped = F.when((F.col("ties") > 0) & (F.col("rank") <= F.col("ties") + 1), F.least(F.col("score"), F.lit(CAP))).otherwise(F.col("score"))
    rows = rows.withColumn("score", capped).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    label = F.when(F.col("score") >= MATCHED, "Matched").when(F.col("score") >= REVIEW, "Needs review").otherwise("Not reliable enough")
    return rows.select("query", "rank", "product", "score", label.alias("label"), (F.col("score") < MATCHED).alias("needs_review"))


RANKED_SQL = f"""{_N}, s AS (SELECT query, product, round({W_SIMILAR}::DOUBLE * similarity + {W_TOKENS}::DOUBLE * coverage, 4) AS score FROM c),
m AS (SELECT product, {normalize_n1_sql('product')} AS normal FROM (SELECT DISTINCT product FROM s)),
k AS (SELECT s.*, normal, row_number() OVER (PARTITION BY query ORDER BY score DESC, product) AS place FROM s JOIN m USING (product)),
b AS (SELECT query, score AS best, normal AS best_normal FROM k WHERE place = 1),
t AS (SELECT query, count(*) AS ties FROM k JOIN b USING (query) WHERE best >= {MATCHED} AND score >= {MATCHED} AND best - score <= {NEAR}::DOUBLE AND normal <> best_normal GROUP BY query),
e AS (SELECT k.query, product, CASE WHEN place <= ties + 1 THEN least(score, {CAP}::DOUBLE) ELSE score END AS score FROM k LEFT JOIN t USING (query)),
d AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, product) AS INTEGER) AS rank, product, score FROM e QUALIFY rank <= 5)
SELECT *, CASE WHEN score >= {MATCHED} THEN 'Matched' WHEN score >= {REVIEW} THEN 'Needs review' ELSE 'Not reliable enough' END AS label, score < {MATCHED} AS needs_review FROM d"""


def holding_all(records: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id of records (id, text) that hold every term of a query (query, terms: lower-case), inside words too and whatever the case.

    A query meets the records that hold the rarest piece of its terms (three letters, or a shorter term whole), records of a piece dealt to PARTS parts, and is
    then checked whole. Null texts hold nothing; queries without terms, or with a null one, find nothing; empty terms are held by all texts and left out.
    """
    def pieces(c: Column, n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    held = stored(records.select("id", F.lower("text").alias("text")).where("text IS NOT NULL"), "lower-texts")
    asked = queries.select("query", F.filter("terms", lambda t: t.isNull() | (t != "")).alias("terms")).where("size(terms) > 0 AND NOT exists(terms, t -> t IS NULL)").distinct()
    asked = stored(asked, "all-terms")
    wanted = asked.select("query", F.explode("terms").alias("t")).select("query", F.explode(F.when(F.length("t") < 3, F.array("t")).otherwise(pieces(F.col("t"), 3))).alias("piece")).distinct()
    wanted = stored(wanted.withColumn("n", F.length("piece")), "wanted-pieces")
    lengths = [r.n for r in wanted.select("n").distinct().collect()]  # three at most
    postings = held.select("id", "text", F.explode(F.array_distinct(F.concat(*[pieces(F.col("text"), n) for n in lengths or [3]]))).alias("piece"))
    postings = stored(postings.join(wanted.select("piece").distinct(), "piece", "left_semi"), "piece-postings")
    often = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    rarest = wanted.join(often, "piece", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece"))["piece"].alias("piece"))
    met = rarest.join(asked, "query").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = met.join(postings.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")), ["piece", "part"])
    return met.where(F.forall("terms", lambda t: F.contains("text", t))).select("query", "id")


def all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, id: records whose text holds all tokens of a query, inside words too; queries are the distinct names."""
    names = price_records(spark, sf_dir).where("product is not null").select(F.col("product").alias("query")).distinct()
    return holding_all(price_records(spark, sf_dir).select("id", "text"), names.select("query", tokens(normalize_n1(F.col("query"))).alias("terms")))


def attribute_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, matches: records of the same section and size (attribute containment), itself left out."""
    w = Window.partitionBy("section", "size")
    return price_records(spark, sf_dir).select("id", (F.count(F.lit(1)).over(w) - 1).alias("matches"), F.min("price").over(w).alias("lowest"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows without repeats: the first of a name, sku, unit (whatever the case; a missing sku or unit is an empty one) and price."""
    unit = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("id") % len(SPELLINGS) + 1).cast("int"))
    rows = price_records(spark, sf_dir).withColumn("unit", unit)
    key = F.struct(F.lower("product").alias("p"), F.coalesce(F.lower("sku"), F.lit("")).alias("s"), F.coalesce(F.lower("unit"), F.lit("")).alias("u"), "price")
    kept = rows.groupBy(key.alias("key")).agg(F.min(F.struct("id", "product", "sku", "section", "unit", "price")).alias("row"))
    return kept.select("row.*")


_UNIT = f"list_extract([{', '.join(map(quoted, SPELLINGS))}], CAST(id % {len(SPELLINGS)} + 1 AS INTEGER))"
QUERIES = {
    "normalize_n1": normalized, "normalize_unit_and_price": units, "trigram_recall": candidates, "rank_topk": ranked,
    "ilike_all_terms": all_terms, "attr_containment": attribute_matches, "row_dedupe_first_wins": first_wins,
}
SQL = {
    "normalize_n1": f"WITH r AS ({PRICE_RECORDS_SQL}), n AS (SELECT id, {normalize_n1_sql('text')} AS normal FROM r) SELECT id, normal, regexp_replace(normal, '[^a-z0-9.]+', '', 'g') AS compact, array_to_string({tokens_sql('normal')}, ',') AS tokens FROM n",
    "normalize_unit_and_price": f"WITH r AS ({PRICE_RECORDS_SQL}), u AS (SELECT id, price AS p, {_UNIT} AS s, size FROM r), n AS (SELECT id, {normalize_n1_sql('CAST(size AS VARCHAR) || chr(32) || s')} AS n, '₹ ' || format('{{:,.2f}}', p) || ' per ' || s AS t FROM u) SELECT id, {normalize_unit_sql('n')} AS unit, {parse_price_sql('t')} AS price FROM n",
    "trigram_recall": f"{_N} SELECT * FROM c",
    "rank_topk": RANKED_SQL,
    "ilike_all_terms": f"WITH r AS ({PRICE_RECORDS_SQL}), q AS (SELECT t AS query, {tokens_sql(normalize_n1_sql('t'))} AS w FROM (SELECT DISTINCT product AS t FROM r WHERE product IS NOT NULL)) SELECT query, id FROM q JOIN r ON len(q.w) > 0 AND len(list_filter(q.w, lambda t: NOT contains(lower(r.text), t))) = 0",
    "attr_containment": f"WITH r AS ({PRICE_RECORDS_SQL}) SELECT id, count(*) OVER (PARTITION BY section, size) - 1 AS matches, min(price) OVER (PARTITION BY section, size) AS lowest FROM r",
    "row_dedupe_first_wins": f"WITH r AS ({PRICE_RECORDS_SQL}) SELECT id, product, sku, section, {_UNIT} AS unit, price FROM r QUALIFY row_number() OVER (PARTITION BY lower(product), coalesce(lower(sku), ''), lower({_UNIT}), price ORDER BY id) = 1",
}
