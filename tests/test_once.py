"""Costly values are worked out once: one parse of a document, one look at a cell."""

import random

from priceatlas.functions.electrical import N2_REWRITES, normalize_n2
from priceatlas.functions.text import N1_REWRITES, ascii_words, normalize_n1
from priceatlas.operators import canonical, engine, fulltext, ingest, matrices, recall
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once(spark):
    for query in (ingest.from_csv, ingest.from_html):
        assert _plan(query(spark, SF)).count("MapInArrow") == 1
    assert _plan(ingest.from_workbook(spark, SF)).count("MapInArrow") == 2  # one writes, one reads


def test_filters_do_not_work_cells_out_anew(spark):
    assert _plan(ingest.from_text_lines(spark, SF)).count("per\\s+.+") <= 4
    assert _plan(canonical.links(spark, SF)).count("beam\\s*angle") == 1
    assert _plan(matrices.matrix_prices(spark, SF)).count("lsoh") == 1


def test_rows_take_the_first_header_above_them(spark):
    grid = spark.createDataFrame([
        (1, 0, 0, ["Our list"]), (1, 0, 1, ["Item", "Rate"]), (1, 0, 2, ["copper wire 5", "10"]), (1, 0, 3, ["Rate", "Item"]), (1, 0, 4, ["copper wire 6", "11"]), (1, 0, 4, ["copper wire 6", "11"]),
        (2, 0, 0, ["copper wire 7", "12"]), (2, 0, 1, ["Description", "Price", "SKU"]), (2, 0, 1, ["copper wire 8", "13", "a"]), (2, 0, 2, ["copper wire 9", "12 mm", "b"]), (None, 0, 0, ["Item", "Rate"]), (None, 0, 1, ["copper wire 1", "2"]),
    ], "id long, table_no int, row_no int, cells array<string>")
    rows = sorted((r.id, r.row_no, r.raw_name, r.sku, r.price) for r in ingest.flat_price_rows(grid).collect())
    assert rows == [(1, 2, "copper wire 5", None, 10.0), (1, 4, "copper wire 6", None, 11.0), (1, 4, "copper wire 6", None, 11.0), (2, 2, "copper wire 9", "b", None)]


def test_signs_of_n1_leave_no_rewrite_out(spark):
    parts = ["fr", "ls", "h", " ", "-", "cabel", "scensior", "sq", ".", "mm", "sqmm", "mtrs", "m", "5", "2.5", "metre", "no", "pcs.", "coper", "bdl", "cu", "al", "un", "armd", "x", "×", "*", "cores", "c", "é", "\t", " ", "A"]
    dice = random.Random(3)
    texts = ["".join(dice.choices(parts, k=dice.randint(0, 9))) for _ in range(20_000)]
    plain = F.regexp_replace(F.translate(F.lower("t"), " ", " "), r"[^\x00-\x7F×]", "~")
    for pattern, to in N1_REWRITES:
        plain = F.regexp_replace(plain, pattern, to)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(F.trim(plain) != normalize_n1(F.col("t"))).count() == 0


def test_signs_of_n2_leave_no_rewrite_out(spark):
    parts = ["fr", "ls", "h", " ", "-", "/", "sq", ".", "mm", "mtrs", "metre", "m", "5", "2.5", "1p2", "1.2.3", "Cu", "al", "un", "armd", "armoured.", "x", "×", "*", "cores", "c", "é", "ß", "~", "\t", "\n", "A", "p"]
    dice = random.Random(4)
    plain = F.lower(F.coalesce("t", F.lit("")))
    for pattern, to in N2_REWRITES:
        plain = F.regexp_replace(plain, ascii_words(pattern), to)
    rows = spark.createDataFrame([("".join(dice.choices(parts, k=dice.randint(0, 10))),) for _ in range(20_000)] + [(None,)], "t string")
    assert rows.where(F.trim(plain) != normalize_n2(F.col("t"))).count() == 0
    # every look around at each letter is gone
    assert "(?<=[A-Za-z0-9_])" not in _plan(rows.select(normalize_n2(F.col("t"))))


def test_items_are_dealt_out_and_read_once(spark):
    assert engine.items(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = _plan(spark.range(1).select(normalize_n1(F.col("id").cast("string")))).count("scensior")
    assert _plan(engine.bases(spark, SF)).count("scensior") <= 2 * once
    assert _plan(engine.rates(spark, SF)).count("scensior") <= 3 * once
    assert _plan(canonical.vendors(spark, SF)).count("[^a-z0-9]+") == 1
    assert _plan(ingest.mined_aliases(spark, SF)).count("sq\\.?\\s*mm\\b|") <= 2  # one pass for all abbreviations


def test_records_that_say_the_same_are_scored_once_and_all_listed(spark):
    rows = spark.createDataFrame([(i, "copper wire", "s", i % 3) for i in range(60)] + [(99, "copper wire red", "s", 1)], "id long, text string, sku string, day int")
    kept = recall.first_members(rows, ["text"], [F.desc("day"), F.col("id")], 5).collect()
    assert sorted((r.text, r.place, r.id, r.first) for r in kept) == [("copper wire", n + 1, 2 + 3 * n, 2) for n in range(5)] + [("copper wire red", 1, 99, 99)]
    found = recall.recall(spark.createDataFrame([("copper wire",)], "query string"), rows.select("id", "text", "sku")).collect()
    assert sorted((r.rank, r.id) for r in found) == [(n + 1, n) for n in range(recall.TOP)]
    dated = rows.select("id", "text", F.col("text").alias("product"), "sku", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("uploaded"))
    got = fulltext.record_recall(spark.createDataFrame([("copper wire",)], "query string"), dated, 45).orderBy("rank").collect()
    assert [r.id for r in got] == [*range(2, 60, 3), *range(1, 60, 3), *range(0, 15, 3)]
