"""Fixed cases of full text, aliases, vendor hints and candidate reduction, and edge rows."""

import pytest
from pyspark.sql import functions as F

from priceatlas.operators import fulltext, hints

RECORDS = "id long, text string, product string, sku string, uploaded date, words string"


def density(spark, query, text, sku=""):
    docs = fulltext.text_index(spark.createDataFrame([(1, text, sku)], "id long, text string, sku string"), [("text", 1.0), ("sku", 0.4)])
    row = fulltext.matched(docs.withColumn("terms", fulltext.terms_of(F.lit(query)))).first()
    return sorted(row.alts), round(row.density, 6)


@pytest.mark.parametrize(("query", "text", "sku", "want"), [
    ("copper cable", "copper cable", "", ([0], 1.0)), ("copper cable", "Copper armoured cable", "", ([0], 0.5)), ("copper cable", "cable copper cable", "", ([0], 2.0)), ("copper", "copper copper", "", ([0], 2.0)),
    ("copper x9", "copper", "x9", ([0], round(2 / 3.5, 6))), ("x9", "copper", "X9", ([0], 0.4)), ("copper lead", "copper", "", ([], 0.0)), ('"copper cable"', "copper cable", "", ([0], 1.0)), ('"copper cable"', "copper red cable", "", ([], 0.0)),
    ('"copper cable" red', "red copper cable copper", "", ([0], 1.0)), ("copper or lead", "lead wire", "", ([0 + 1], 1.0)), ("copper or lead", "lead copper", "", ([0, 1], 2.0)), ("lead -copper", "lead copper", "", ([], 0.0)), ("lead -copper", "lead tin", "", ([0], 1.0)),
    ('lead -"copper wire"', "lead copper red wire", "", ([0], 1.0)), ("-lead", "copper", "", ([], 0.0)), ("2.5 sqmm", "2.5 sqmm", "", ([0], 1.0)), ("lead-free", "free lead free", "", ([0], 1.0)), ("or", "or", "", ([], 0.0)), ("", "copper", "", ([], 0.0)),
    ("copper OR -x or tin", "tin", "", ([2], 1.0)), ('"', "copper", "", ([], 0.0)), ("copper", "", "", ([], 0.0)), ("copper copper", "copper", "", ([0], 1.0)),
])
def test_density_and_alternatives(spark, query, text, sku, want):
    assert density(spark, query, text, sku) == want


def test_record_recall_edges(spark):
    rows = [
        (1, "copper cable red", "cable", "c1", None, "w"), (2, "copper cable red", "cable", "c1", None, "w"), (3, None, None, None, None, None), (4, "", "", "", None, ""), (5, "steel " * 5000, "steel", None, None, "w"), (6, "copper cable red", "cable", "c1", None, "w"),
    ]
    records = spark.createDataFrame(rows, RECORDS).withColumn("uploaded", F.when(F.col("id") == 6, F.lit("2024-01-01").cast("date")))
    queries = spark.createDataFrame([("copper cable",), ("copper cable",), (None,), ("",), ("zzz",), ("steel",)], "query string")
    got = [(r.query, r["rank"], r.id) for r in fulltext.record_recall(queries, records).orderBy("query", "rank").collect()]
    assert got == [("copper cable", 1, 6), ("copper cable", 2, 1), ("copper cable", 3, 2), ("steel", 1, 5)]
    assert fulltext.record_recall(queries.limit(0), records).count() == 0 and fulltext.record_recall(queries, records.limit(0)).count() == 0
    assert fulltext.record_recall(queries, records, top=1).count() == 2


ALIASES = "alias string, canonical string, confidence double, scope string, vendor long, document long"


def test_aliases_see_what_the_ones_before_have_left(spark):
    def run(rows, query, **scope):
        loaded = hints.loaded_aliases(spark, spark.createDataFrame(rows, ALIASES), **scope)
        r = hints.apply_aliases(spark.createDataFrame([(query, ["red wire", None])], "query string, terms array<string>"), loaded).first()
        return r.rewritten, r.used, r.unsure, r.product_terms

    chain = [("red", "green", 0.8, "global", None, None), ("green", "blue", 0.6, "global", None, None)]
    assert run(chain, "red red wire") == ("blue blue wire", ["red"], ["green"], ["green wire", ""])
    assert run([(a, c, 1.4 - s, *x) for a, c, s, *x in chain], "red wire") == ("green wire", [], ["red"], ["red wire", ""])
    assert run([("red wire", "cord", 0.9, "global", None, None), ("", "x", 0.9, "global", None, None), ("cord", "", 0.9, "global", None, None)], "infrared wire; red wire")[0] == "infrared wire cord"
    scoped = [("red", "v", 0.9, "vendor", 7, None), ("wire", "d", 0.9, "document", None, 3), ("low", "x", 0.3, "global", None, None)]
    assert run(scoped, "red wire low")[0] == "v wire low" and run(scoped, "red wire", vendor=8)[0] == "red wire" and run(scoped, "red wire", document=3)[0] == "v d"
    assert run([], "3 coils of cabel")[:2] == ("3 coil of cable", ["coils"]) and run([], None)[0] == ""


def test_vendor_hints(spark):
    known = [("Havells India", "FR wire with red core"), ("Polycab", "armoured cable copper"), ("Anchor", "armoured cable copper"), ("Finolex", "LAN cable"), (None, None), ("Finolex", "LAN cable")]
    asked = ["havells wire", "red wire core of fr", "FR wire", "armoured cable copper", "lan cable", "need LAN cable price", "india", None, "", "polycab anchor", "red wire core of fr"]
    found = hints.vendor_hints(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(known, "vendor string, product string"))
    assert {r.query: r.vendors for r in found.collect()} == {"havells wire": ["havells"], "red wire core of fr": ["havells india"], "lan cable": ["finolex"], "need LAN cable price": ["finolex"], "polycab anchor": ["anchor", "polycab"]}
    assert found.count() == 5 and hints.vendor_hints(spark.createDataFrame([], "query string"), spark.createDataFrame(known, "vendor string, product string")).count() == 0


def test_evidence_is_reduced_in_order(spark):
    schema = "query string, ord int, legacy_id long, record_id long, document_id long, text string, price double, score double"
    rows = [
        ("q", 1, 5, None, 1, "a", 1.0, 0.9), ("q", 2, None, 8, 1, "b", 1.0, 0.5), ("q", 3, 5, 50, 1, "a", 1.0, 0.1), ("q", 4, 5, None, 1, "a", 1.0, 0.2), ("q", 5, 5, 51, 1, "a", 1.0, 0.15), ("q", 6, None, 8, 1, "b", 1.0, 0.5),
        ("q", 7, None, None, 2, "c", 2.0, None), ("q", 8, None, None, 2, "c", 2.0, 0.3), ("r", 1, None, None, None, None, None, None),
    ]
    got = [(r.query, r["rank"], r.key, r.ord, r.record_id, r.score) for r in hints.best_evidence(spark.createDataFrame(rows, schema), 3).orderBy("query", "rank").collect()]
    assert got == [("q", 1, "legacy:5", 5, 51, 0.15), ("q", 2, "8", 2, 8, 0.5), ("q", 3, "2:c:2.0", 8, None, 0.3), ("r", 1, "null:null:null", 1, None, None)]
    assert hints.best_evidence(spark.createDataFrame(rows, schema), 1).where("query = 'q'").count() == 1 and hints.best_evidence(spark.createDataFrame([], schema), 3).count() == 0
