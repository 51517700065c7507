"""Clauses, texts, early stop and shares of answers, on fixed questions and hits."""

from pyspark.sql import functions as F

from priceatlas.operators import retrieval

HITS = "text string, hits array<struct<position: int, item: long, score: double, price: double>>"


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0]


def test_clauses_and_texts(spark):
    assert one(spark, retrieval.clauses_of, "cable tray, MCB AND x & lugs+glands\nand; sandpaper") == ["cable tray", "MCB", "lugs", "glands", "sandpaper"]
    assert one(spark, retrieval.clauses_of, None) == [] and one(spark, retrieval.shards_of, "") == [] and one(spark, retrieval.shards_of, None) == []
    assert one(spark, retrieval.shards_of, "Cable-Tray") == ["Cable-Tray", "cable tray", "Cable Tray", "CableTray", "cabletray"]
    two = one(spark, retrieval.shards_of, "tray and AB-12/3")
    assert two[:2] == ["tray", "AB-12/3"] and "tray and AB-12/3" not in two and {"AB 12 3", "AB123"} <= set(two)
    assert len(one(spark, retrieval.shards_of, ", ".join(f"item-{i}" for i in range(40)))) == retrieval.MOST_SHARDS


def test_hits_hold_all_words(spark):
    items = [(1, "red bolt", 1.0), (2, "red bolt long", None), (3, "red nut", 3.0), (4, None, 4.0), (5, "bolt red", 5.0), (6, "", 6.0)]
    texts = spark.createDataFrame([("bolt red",), ("bolt red",), ("green",), ("",), (None,), ("red",)], "text string")
    found = {r.text: [tuple(h)[:2] for h in r.hits] for r in retrieval.hits_of(texts, spark.createDataFrame(items, "item long, name string, price double"), 3).collect()}
    assert found == {"bolt red": [(0, 1), (1, 5), (2, 2)], "red": [(0, 1), (1, 3), (2, 5)]}  # ties by item, the fourth hit of `red` is cut
    none = spark.createDataFrame([], "item long, name string, price double")
    assert retrieval.hits_of(texts, none).count() == 0 and retrieval.hits_of(texts.limit(0), none).count() == 0


def hit(*rows):
    return [(k, i, s, p) for k, (i, s, p) in enumerate(rows)]


def test_early_stop_and_ranks(spark):
    hits = spark.createDataFrame([
        ("Cable-Tray", hit((1, 0.2, 1.0), (2, 0.3, None), (3, 0.1, 1.0))),
        ("cable tray", hit((9, 0.9, 1.0), (3, 0.1, 1.0))),
        ("tray", hit((1, 0.5, 1.0), (2, 0.4, 1.0))),
        ("lug", hit((7, 0.45, 1.0), (1, 0.5, 1.0), (8, 0.5, None))),
    ], HITS)
    asked = spark.createDataFrame([(1, "Cable-Tray"), (2, "tray and lug"), (3, "nothing"), (4, None)], "question long, text string")
    rows = lambda enough, limit=20: sorted(map(tuple, retrieval.search_shards(asked, hits, enough, limit).collect()))
    assert rows(0.95) == [
        (1, False, 1, 1, 0.2, 0), (1, False, 2, 3, 0.1, 2), (1, False, 3, 9, 0.9, 100),  # one clause: the first text's come first; item 2 has no price and keeps its place
        (2, False, 1, 1, 0.5, 0), (2, False, 2, 7, 0.45, 100), (2, False, 3, 2, 0.4, 1),
    ]
    assert [r for r in rows(0.5) if r[0] == 2] == [(2, True, 1, 1, 0.5, 0), (2, True, 2, 2, 0.4, 1)]  # the first text is enough
    assert [r[3] for r in rows(0.95, 2)] == [1, 9, 1, 7]  # one place of two is a hit without price, which is not filled up
    assert retrieval.search_shards(asked.limit(0), hits, 0.5).count() == 0 and retrieval.search_shards(asked, hits.limit(0), 0.5).count() == 0


def test_clauses_share_the_answer(spark):
    many = [(i, 0.5, 1.0 if i != 2 else None) for i in range(1, 9)]
    hits = spark.createDataFrame([("bolt", hit(*many)), ("nut", hit((1, 0.9, 1.0), (20, 0.8, 1.0), (21, 0.7, 1.0), (22, 0.6, 1.0)))], HITS)
    asked = spark.createDataFrame([(1, "bolt"), (2, "bolt, nut"), (3, None)], "question long, text string")
    rows = sorted(map(tuple, retrieval.clause_quotas(asked, hits, 5).collect()))
    assert [r[2] for r in rows if r[0] == 1] == [1, 3, 4, 5, 6]
    assert [(r[2], r[4]) for r in rows if r[0] == 2] == [(1, 0), (3, 1), (4, 2), (20, 1001), (21, 1002)]  # three a clause; item 1 keeps its first rank
    assert retrieval.clause_quotas(asked.limit(0), hits).count() == 0
