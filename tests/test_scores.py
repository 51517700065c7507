"""Queries and candidates as classes, recall by size or rarest term, and the ranking by five keys with its cap, on fixed cases."""

from pyspark.sql import functions as F

from priceatlas.functions.stored import stored
from priceatlas.operators import engine, scores

RANKED = "query string, candidate string, unit string, normal string, score double, specific int, confidence double, uploaded int, id long"


def _ranked(spark, rows, places=9):
    got = scores.rank_candidates(spark.createDataFrame(rows, RANKED), places).orderBy("query", "rank").collect()
    return [(r.query, r.candidate, r.score, r.capped) for r in got]


def test_five_keys(spark):
    rows = [("q", c, None, c, s, n, conf, day, i) for c, s, n, conf, day, i in [
        ("late", 0.5, 3, 0.9, 9, 6), ("early", 0.5, 3, 0.9, 2, 1), ("none", 0.5, 3, 0.9, None, 0), ("short", 0.5, 2, 0.1, 1, 9), ("unsure", 0.5, 3, 0.8, 9, 0), ("best", 0.6, 9, 0.1, 1, 9), ("twin", 0.5, 3, 0.9, 9, 7),
    ]]
    assert [c for _, c, _, _ in _ranked(spark, rows)] == ["best", "short", "late", "twin", "early", "none", "unsure"]
    assert [c for _, c, _, _ in _ranked(spark, rows, 2)] == ["best", "short"]
    assert _ranked(spark, []) == []


def test_cap_of_near_ties(spark):
    rows = [("q", "a", None, "a", 0.95, 5, 0.9, 1, 1), ("q", "b", None, "b", 0.93, 4, 0.9, 1, 2), ("q", "c", None, "c", 0.86, 1, 0.9, 1, 3), ("q", "d", None, "d", 0.8, 1, 0.9, 1, 4)]
    # one other within 0.08 of the best: two places are capped, c passes them, and words decide between equal scores
    assert _ranked(spark, rows) == [("q", "c", 0.86, False), ("q", "b", 0.84, True), ("q", "a", 0.84, True), ("q", "d", 0.8, False)]
    same = [("q", "a", None, "a", 0.95, 5, 0.9, 1, 1), ("q", "a", "coil", "a", 0.95, 5, 0.9, 1, 2), ("q", "z", None, "z", 0.84, 5, 0.9, 1, 3)]
    assert [(c, s) for _, c, s, _ in _ranked(spark, same)] == [("a", 0.95), ("a", 0.95), ("z", 0.84)]  # another unit of the same text is no tie


def _both(spark, queries, names):
    asked = stored(engine.parse_queries(spark.createDataFrame([(q,) for q in queries], "query string")), "asked")
    q = scores.query_classes(asked.withColumn("vendor_terms", F.array().cast("array<string>")).withColumn("alias_confidence", F.lit(None).cast("double")))
    none, name = F.lit(None).cast("string"), F.col("query")
    own = stored(engine.parse_queries(spark.createDataFrame(names, "query string, price double")), "own").withColumn("attributes", F.col("hints"))
    own = own.select("query", "price", "attributes", *[name.alias(c) for c in ["searchable", "product", "description", "rows"]], *[none.alias(c) for c in ["unit", "sku", "columns", "parents", "title", "section", "vendor", "raw_cell"]], F.lit(1).alias("page"), F.lit(0.9).alias("confidence"), F.lit(0.82).alias("recall"), F.lit(0.0).alias("recency"), F.lit(False).alias("duplicate"))
    return stored(q, "q"), stored(scores.candidate_classes(own), "c")


def test_classes_score_as_single_rows(spark):
    queries = ["6 sqmm copper cable", "6Sqmm Cu cable", "6 SQ MM copper cabel", "red wire", "", None, "25 sqmm flexible"]
    names = [("6 sqmm copper cable", 10.0), ("6 Sqmm Cu Cable", 99.0), ("6 sqmm copper cable", 0.0), ("red wire 10 sqmm", None), ("25 sqmm flexible cable", 5.0), ("", 1.0), (None, 1.0)]
    q, c = _both(spark, queries, names)
    assert q.where("query like '6%'").select("q_class").distinct().count() == 1 and q.select("q_class").distinct().count() == 4
    assert c.where("query like '6%'").select("c_class").distinct().count() == 2  # the price of 0 stands apart
    met = stored(scores.by_size(q, c).union(scores.by_rarest_term(q, c)).distinct(), "met")
    found = {(r[0], r[1]) for r in met.join(q.select("q_class", F.col("query").alias("q")), "q_class").join(c.select("c_class", "query"), "c_class").select("q", "query").collect()}
    assert ("red wire", "red wire 10 sqmm") in found and ("red wire", "25 sqmm flexible cable") not in found and not any(a in ("", None) for a, _ in found)
    assert {b for a, b in found if a == "25 sqmm flexible"} == {"25 sqmm flexible cable"}
    got = scores.scored_classes(q, c, met).join(q.select("q_class", F.col("query").alias("q")), "q_class").join(c.select("c_class", "query", "own_price"), "c_class")
    single = engine.score_candidates(q.drop("q_class", "q_size").withColumnRenamed("query", "q").select("q", *scores.OF_QUERY).join(met.join(q.select("q_class", F.col("query").alias("q")), "q_class"), "q").join(c.drop("confidence").withColumn("confidence", F.lit(0.9)), "c_class"))
    key = lambda rows: sorted(map(tuple, rows.select("q", "query", F.coalesce("own_price", F.lit(-1.0)), "score", "label").distinct().collect()), key=str)
    assert key(got) == key(single) and key(got)
