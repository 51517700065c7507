"""Hybrid recall: every distinct item name as a query against the price records, by words, trigrams, compact texts and token coverage.

Pairs come from postings only, each path with a filter that loses no pair of its own: similar sets share one of their rarest elements, a text that
holds another holds its rarest run of letters. Every path is an equi-join over distinct texts; pairs are checked and scored after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.electrical import normalize_n2, normalize_n2_sql
from priceatlas.functions.stored import stored
from priceatlas.functions.text import quoted, trigrams, trigrams_sql
from priceatlas.plans.entities import PRICE_RECORDS_SQL, price_records

# Weights, least similarities and coverage, shortest compact text that a query may hold, rows a query, weight of a plain word, and words that coverage leaves out.
W_WORDS, W_SIMILAR, W_COMPACT, W_COVERED = 0.30, 0.25, 0.20, 0.25
SIMILAR, SKU_SIMILAR, COVERED, LEAST, TOP, PLAIN = 0.18, 0.2, 0.60, 6, 15, 0.1
NOT_COUNTED = ["about", "all", "any", "available", "cable", "cables", "document", "documents", "find", "for", "from", "give", "price", "prices", "rate", "rates", "show", "the", "this", "with"]


def words_of(normal: Column) -> Column:
    return F.filter(F.split(normal, r"\s+"), lambda w: w != "")


def counted(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(NOT_COUNTED))


def similarity(a: Column, b: Column) -> Column:
    """Shared elements of two sets over all their elements; empty sets: 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def coverage(query: Column, item: Column) -> Column:
    """Share of a query's counted words (repeated ones as often as they come) that an item has; none counted: 0."""
    asked = counted(query)
    return F.coalesce(F.try_divide(F.size(F.filter(asked, lambda w: F.array_contains(item, w))).cast("double"), F.size(asked)), F.lit(0.0))


def cover_density(query: Column, words: Column) -> Column:
    """Sum over the shortest stretches of words that hold all distinct query words: PLAIN / (1 + other words in the stretch)."""
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(query, F.element_at(words, i)))

    def begin(end: Column) -> Column:  # the latest place from which all query words come up to end; 0: none
        last = lambda w: F.array_max(F.filter(at, lambda j: (j <= end) & (F.element_at(words, j) == w)))
        return F.array_min(F.transform(query, lambda w: F.coalesce(last(w), F.lit(0))))

    ends = F.transform(at, lambda e: F.struct(e.alias("e"), begin(e).alias("b")))
    shortest = F.filter(ends, lambda x, k: (x["b"] > 0) & ((k == 0) | (x["b"] > F.get(ends, k - 1)["b"])))
    noise = lambda x: x["e"] - x["b"] + 1 - F.size(F.filter(at, lambda j: j.between(x["b"], x["e"])))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.aggregate(shortest, F.lit(0.0), lambda s, x: s + PLAIN / (1 + noise(x))))


def _rarest(sets: DataFrame, keys: list[str], column: str, often: DataFrame, n: Column) -> DataFrame:
    """keys and x: the n rarest elements of every array, by the counts (x, often); ties by the element. n may use `size`, the array's length."""
    flat = sets.select(*keys, F.size(column).alias("size"), F.explode(column).alias("x"))
    told = flat.join(often, "x", "left").groupBy(*keys, "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "x"))).alias("all"))
    return told.select(*keys, F.explode(F.array_distinct(F.slice(F.col("all")["x"], F.lit(1), n.cast("int")))).alias("x"))


def _counts(*columns: DataFrame) -> DataFrame:
    flat = [c.toDF("a").select(F.explode("a").alias("x")) for c in columns]
    both = flat[0]
    for c in flat[1:]:
        both = both.unionAll(c)
    return both.groupBy("x").agg(F.count(F.lit(1)).alias("often"))


def _alike(queries: DataFrame, grams: str, others: DataFrame, key: str, other_grams: str, least: float) -> DataFrame:
    """query, key: pairs that may reach a similarity: they share one of the rarest size - ceil(least * size) + 1 elements of both."""
    often, n = _counts(queries.select(grams), others.select(other_grams)), F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    return _rarest(queries, ["query"], grams, often, n).join(_rarest(others, [key], other_grams, often, n), "x").select("query", key).distinct()


def _runs(c: str, longest: int = LEAST) -> Column:
    """Distinct runs of 1 to longest letters."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)]))


def _holding(needles: DataFrame, needle: str, stacks: DataFrame, stack: str) -> DataFrame:
    """needle, stack: texts and the ones that hold them, met by the rarest run of LEAST letters of the needle (a shorter needle: by itself)."""
    posts = stacks.select(stack).distinct().select(stack, F.explode(_runs(stack)).alias("x"))
    often = posts.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    of_size = F.filter(_runs(needle), lambda r: F.length(r) == F.least(F.length(needle), F.lit(LEAST)))
    keys = _rarest(needles.where(F.col(needle) != "").select(needle).distinct().withColumn("runs", of_size), [needle], "runs", often, F.lit(1))
    return keys.join(posts, "x").where(F.contains(stack, needle)).select(needle, stack)


def first_members(rows: DataFrame, same: list[str], order: list[Column], most: int) -> DataFrame:
    """rows with place and first: classes of rows equal in `same`, the `most` first of each by order, with their place (from 1) and the id of the first."""
    w = Window.partitionBy(*same).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return placed.withColumn("first", F.first("id").over(w))


def recall(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query, rank, id, score: the TOP records of every query.

    queries: query (distinct, not null). items: id, text, sku (null: empty). A record is recalled if it has all words of the query, is similar to it, covers it, one compact
    text holds the other, or its sku is similar to the query or holds it. First come records whose sku is the query, then by score, then by id. Empty queries find nothing.
    """
    # as results of a grouping, the rewrites run once a row: conditions on them cannot move to the scan, where they would run again
    queries = queries.groupBy("query").agg(F.max(normalize_n2(F.col("query"))).alias("normal")).where("normal <> ''")
    queries = queries.select("query", words_of(F.col("normal")).alias("qw"), F.replace("normal", F.lit(" "), F.lit("")).alias("qc"), trigrams(F.col("normal")).alias("qg"), trigrams(F.col("query")).alias("qs"))
    queries = stored(queries, "recall-queries")
    rows = items.groupBy("id", "text", "sku").agg(F.max(normalize_n2(F.col("text"))).alias("item")).select("id", "item", F.coalesce("sku", F.lit("")).alias("sku"))
    # rows that say the same are scored once, as the first of them; of each such class no more than TOP can be asked for
    members = stored(first_members(rows.distinct(), ["item", "sku"], [F.col("id")], TOP), "recall-members")
    rows = members.where("place = 1").select("id", "item", "sku")
    texts = rows.select("item").distinct().select("item", words_of(F.col("item")).alias("iw"), F.replace("item", F.lit(" "), F.lit("")).alias("ic"), trigrams(F.col("item")).alias("ig"))
    texts = stored(texts, "recall-texts")
    skus = rows.select("sku").distinct().select("sku", trigrams(F.col("sku")).alias("sg"))

    asked = queries.withColumn("asked", counted(F.col("qw"))).withColumn("none", F.size("asked") == 0).withColumn("asked", F.when(F.col("none"), F.col("qw")).otherwise(F.col("asked")))
    few = F.when(F.col("none"), 1).otherwise(F.col("size") - F.ceil(COVERED * F.col("size") - 1e-9) + 1)
    by_word = texts.select("item", F.explode(F.array_distinct("iw")).alias("x"))
    covered = _rarest(asked, ["query", "none"], "asked", by_word.groupBy("x").agg(F.count(F.lit(1)).alias("often")), few).join(by_word, "x").select("query", "item")
    within = _holding(queries, "qc", texts, "ic").unionByName(_holding(texts.where(F.length("ic") >= LEAST), "ic", queries, "qc")).distinct()
    compact = within.join(queries.select("query", "qc"), "qc").join(texts.select("item", "ic"), "ic").select("query", "item")
    pairs = _alike(queries, "qg", texts, "item", "ig", SIMILAR).unionByName(covered).unionByName(compact).distinct()
    pairs = stored(pairs, "recall-pairs")

    needles = queries.select("query").distinct().withColumn("low", F.lower("query"))
    low = skus.select("sku", F.lower("sku").alias("own"))
    held = _holding(needles, "low", low, "own").join(needles, "low").join(low, "own").select("query", "sku")
    close = _alike(queries, "qs", skus, "sku", "sg", SKU_SIMILAR).join(queries.select("query", "qs"), "query").join(skus, "sku").where(similarity(F.col("qs"), F.col("sg")) > SKU_SIMILAR).select("query", "sku")
    by_sku = stored(held.unionByName(close).distinct(), "recall-skus")

    found = pairs.join(rows, "item").select("query", "id", "item", "sku").unionByName(by_sku.join(rows, "sku").select("query", "id", "item", "sku")).distinct()
    told = found.join(by_sku.withColumn("by_sku", F.lit(True)), ["query", "sku"], "left").join(queries, "query").join(texts, "item").join(skus, "sku")
    told = told.withColumn("similar", similarity(F.col("qg"), F.col("ig"))).withColumn("covered", coverage(F.col("qw"), F.col("iw")))
    told = told.withColumn("all_words", F.size(F.array_except("qw", "iw")) == 0)
    told = told.withColumn("compact", F.contains("ic", "qc") | ((F.length("ic") >= LEAST) & F.contains("qc", "ic")))
    told = told.where(F.col("all_words") | (F.col("similar") > SIMILAR) | (F.col("covered") >= COVERED) | F.col("compact") | F.coalesce("by_sku", F.lit(False)))
    words = F.when(F.col("all_words"), cover_density(F.array_distinct("qw"), F.col("iw"))).otherwise(0.0)
    best = F.greatest("similar", similarity(F.col("qs"), F.col("sg")))
    score = W_WORDS * words + W_SIMILAR * best + W_COMPACT * F.col("compact").cast("int") + W_COVERED * F.col("covered")
    told = told.select("query", "id", "item", "sku", F.round(score, 6).alias("score"), (F.lower("sku") == F.lower("query")).alias("exact"))
    w = Window.partitionBy("query").orderBy(F.desc("exact"), F.desc("score"), "id")
    # a class's first row comes before its others, so no later class than the TOP first ones holds a row of the answer
    best = told.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).drop("id", "rank").join(members.select("item", "sku", "id"), ["item", "sku"])
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).select("query", "rank", "id", "score")


def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = price_records(spark, sf_dir)
    return recall(records.where("product is not null").select(F.col("product").alias("query")).distinct(), records.where("price is not null").select("id", "text", "sku"))


def _sim(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif(CAST(len({a}) + len({b}) - {both} AS DOUBLE), 0), 0.0::DOUBLE)"


_OUT = ", ".join(map(quoted, NOT_COUNTED))
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
RECALL_SQL = f"""WITH r AS ({PRICE_RECORDS_SQL}), q0 AS (SELECT t AS query, {normalize_n2_sql('t')} AS qn FROM (SELECT DISTINCT product AS t FROM r WHERE product IS NOT NULL)),
q AS (SELECT query, {_WORDS.format('qn')} AS qw, replace(qn, ' ', '') AS qc, {trigrams_sql('qn')} AS qg, {trigrams_sql('query')} AS qs FROM q0 WHERE qn <> ''),
i0 AS (SELECT id, {normalize_n2_sql('text')} AS n, coalesce(sku, '') AS sku FROM r WHERE price IS NOT NULL),
i AS (SELECT id, sku, {_WORDS.format('n')} AS iw, replace(n, ' ', '') AS ic, {trigrams_sql('n')} AS ig, {trigrams_sql('sku')} AS sg FROM i0),
k AS (SELECT *, list_filter(qw, lambda w: w NOT IN ({_OUT})) AS asked FROM q),
p AS (SELECT query, id, sku, qw, iw, {_sim('qg', 'ig')} AS alike, {_sim('qs', 'sg')} AS sku_similar, list_has_all(iw, qw) AS all_words,
contains(ic, qc) OR (length(ic) >= {LEAST} AND contains(qc, ic)) AS compact, contains(lower(sku), lower(query)) AS sku_holds,
coalesce(len(list_filter(asked, lambda w: list_contains(iw, w))) / nullif(CAST(len(asked) AS DOUBLE), 0), 0.0::DOUBLE) AS covered FROM k, i),
f AS (SELECT *, list_distinct(qw) AS d, list_filter(range(1, len(iw) + 1), lambda j: list_contains(qw, iw[j])) AS a FROM p WHERE all_words OR alike > {SIMILAR}::DOUBLE OR covered >= {COVERED}::DOUBLE OR compact OR sku_holds OR sku_similar > {SKU_SIMILAR}::DOUBLE),
g AS (SELECT *, list_transform(a, lambda e: list_min(list_transform(d, lambda w: coalesce(list_max(list_filter(a, lambda j: iw[j] = w AND j <= e)), 0)))) AS b FROM f),
h AS (SELECT *, CASE WHEN all_words THEN coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda k: CASE WHEN b[k] > 0 AND (k = 1 OR b[k] > b[k - 1]) THEN {PLAIN}::DOUBLE / (1 + a[k] - b[k] + 1 - len(list_filter(a, lambda j: j BETWEEN b[k] AND a[k]))) ELSE 0.0::DOUBLE END)), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS words FROM g),
s AS (SELECT query, id, lower(sku) = lower(query) AS exact, round({W_WORDS}::DOUBLE * words + {W_SIMILAR}::DOUBLE * greatest(alike, sku_similar) + {W_COMPACT}::DOUBLE * CAST(compact AS INTEGER) + {W_COVERED}::DOUBLE * covered, 6) AS score FROM h)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY exact DESC, score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= {TOP}"""
QUERIES = {"hybrid_recall": hybrid_recall}
SQL = {"hybrid_recall": RECALL_SQL}
