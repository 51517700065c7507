"""The catalogue's queries against DuckDB, text vectors and an empty table."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from priceatlas.functions.text import format_inr, normalize_n1, trigrams, unique_text
from priceatlas.operators import canonical, catalogue, engine, fulltext, hints, ingest, matrices, pages, quotes, recall, search, workspace
from priceatlas.streaming import sinks

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame)


MODULES = [quotes, search, recall, fulltext, hints, catalogue, ingest, matrices, pages, canonical, engine, workspace, sinks]


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.SQL])
def test_query_equals_sql(spark, name):
    found = {k: q for m in MODULES for k, q in m.QUERIES.items()}[name](spark, SF)
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    sql = {k: q for m in MODULES for k, q in m.SQL.items()}[name]
    columns = sorted(found.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert rows(tuple(r) for r in found.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize(("text", "want"), [
    ("6SqmmX2Core Cu Armoured Cable", "6 sqmm 2 core copper armoured cable"), ("6 sq.mm × 2C CU armoured cable please", "6 sqmm 2 core copper armoured cable please"),
    ("1.5Sqmm FR Wire 300Mtr", "1.5 sqmm fr wire 300 mtr"), ("4Sqmm*SC Red", "4 sqmm x sc red"), ("3M Plate", "3 meter plate"), ("No. of Cores", "piece . of cores"), ("₹ 1,250/-", "1 250"), ("12 nos 6Amp Switch", "12 piece 6 amp switch"),
])
def test_normalization(spark, text, want):
    assert spark.range(1).select(normalize_n1(F.lit(text))).first()[0] == want


def test_lists(spark):
    row = spark.range(1).select(unique_text(F.array(F.lit(" A  b"), F.lit("a b"), F.lit(None), F.lit("c"))), F.sort_array(trigrams(F.lit("cat"))), trigrams(F.lit(""))).first()
    assert list(row[0]) == ["A b", "c"] and list(row[1]) == ["  c", " ca", "at ", "cat"] and list(row[2]) == []


@pytest.mark.parametrize(("value", "want"), [(0.0, "₹0.00"), (999.5, "₹999.50"), (1000.0, "₹1,000.00"), (1234567.8, "₹12,34,567.80"), (-100000.0, "-₹1,00,000.00"), (None, None)])
def test_rupees(spark, value, want):
    assert spark.range(1).select(format_inr(F.lit(value).cast("double"))).first()[0] == want


@pytest.mark.parametrize(("scores", "want"), [
    ([0.90, 0.83], [0.90, 0.83]), ([0.84, 0.83], [0.84, 0.83]), ([0.95, 0.90, 0.86], [0.86, 0.84, 0.84]), ([0.95, 0.90, 0.88, 0.70], [0.84, 0.84, 0.84, 0.70]), ([0.95], [0.95]),
])
def test_near_ties_are_capped(spark, scores, want):
    """Only alternatives that match themselves count; who passes the capped ones moves up."""
    rows = [("q", f"name {i}", s) for i, s in enumerate(scores)]
    got = search.capped_five(spark.createDataFrame(rows, "query string, product string, score double")).orderBy("rank").collect()
    assert [r.score for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1)) and all(r.needs_review == (r.score < 0.85) for r in got)


def test_same_text_is_no_near_tie(spark):
    rows = [("q", "6 sq.mm cable", 0.95), ("q", "6 Sqmm Cable", 0.94), *(("p", f"n {i}", 0.9 - i / 1000) for i in range(7))]
    got = search.capped_five(spark.createDataFrame(rows, "query string, product string, score double")).collect()
    assert sorted(r.score for r in got if r.query == "q") == [0.94, 0.95] and [r.score for r in got if r.query == "p"] == [0.84] * 5


def grid(spark, rows):
    return spark.createDataFrame([(1, 0, i, r) for i, r in enumerate(rows)], "id long, table_no int, row_no int, cells array<string>")


def test_canonical_cells_of_a_matrix(spark):
    """Carried heads, descriptors by their head, a row header from above, specifications that are no prices. Numbers of cores read as pieces and thus as prices (a known quirk)."""
    rows = [["Conductor area", "No. of Cores", "Rate", "", "Wattage"], ["6 sq.mm", "2", "₹ 120", "₹ 130", "40"], ["", "4", "$ 150", None, "60"]]
    got = {(r.row_no, r.col_no): r for r in canonical.canonical_cells(grid(spark, rows), 1).collect()}
    assert sorted(k for k, r in got.items() if r.is_price) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)] and (2, 3) not in got and (0, 3) not in got
    assert got[1, 3].column_headers == ["Rate"] and got[1, 2].row_headers == ["6 sq.mm"] and got[2, 2].row_headers == ["6 sq.mm"]
    assert got[2, 2].currency == "USD" and got[1, 2].currency == "INR"
    assert [(a.name, a.value, a.unit) for a in got[1, 2].attributes] == [("size", "6", "sqmm")] * 3


def test_canonical_cells_header_quirk_and_empty_tables(spark):
    """Data rows with words of heads among the first four count as heads; tables without cells give nothing."""
    rows = [["Item", "Rate"], ["plain", "10"], ["coil of wire", "20"], ["plain", "30"]]
    assert [(r.row_no, r.col_no) for r in canonical.canonical_cells(grid(spark, rows)).where("is_price").collect()] == [(3, 1)]
    assert canonical.canonical_cells(grid(spark, rows), 1).where("is_price").count() == 3
    assert canonical.canonical_cells(grid(spark, [[], None])).count() == 0 and canonical.canonical_cells(grid(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("rr-Kabel and KEI", "RR Kabel"), ("a kei b abb", "KEI"), ("L & T", "L&T"), ("", None), (None, None), ("none", None)])
def test_vendor_of(spark, text, want):
    got = spark.range(1).select(canonical.vendor_of(F.lit(text).cast("string"), canonical.VENDORS)["name"]).first()[0]
    assert got == want


def test_answer_texts(spark):
    """A clear match, four that need a check (three are shown), one with alternatives and one without."""
    cand = "struct<score:double,needs_review:boolean,said:string,phrase:string>"
    near = [(0.45, True, '"x"', "INR 5"), (0.4, True, '"y"', "INR 6"), (0.36, True, '"z"', "INR 7"), (0.2, True, '"w"', "INR 8")]
    rows = [(1, 1, "a", [(0.9, False, '"A"', "INR 1")])] + [(1, n, f"r{n}", [(0.7 if n < 4 else 0.55, True, f'"R{n}"', "INR 2")]) for n in range(2, 6)] + [(1, 6, "u", near), (1, 7, "v", []), (2, 1, "v", [])]
    items = spark.createDataFrame(rows, f"id long, line_no int, query string, cands array<{cand}>")
    got = {r.id: r for r in workspace.answers_of(workspace.item_lines(items)).collect()}
    assert (got[1].matched, got[1].review, got[1].unresolved) == (1, 4, 2)
    parts = got[1].answer.split("\n\n")
    assert parts[0] == "Found 1 item ready to add to the quote." and parts[1].split("\n")[0] == "4 possible matches need a quick check before adding:"
    assert parts[1].split("\n")[1] == '- r2: possible match "R2" at INR 2. Please check it before adding.' and parts[1].split("\n")[-1] == "- 1 more item shown in the cards below."
    assert '"x" at INR 5; "y" at INR 6; plus 1 more possible match.' in parts[2] and parts[2].endswith(workspace.NO_PRICE) and parts[3] == workspace.SOME
    assert got[2].answer.split("\n\n")[-1] == workspace.NOTHING


@pytest.mark.parametrize(("text", "want"), [("a" * 97, '"' + "a" * 93 + '..."'), (" a  b ", '"a b"'), ("", None), (None, None)])
def test_quoted_summary(spark, text, want):
    assert spark.range(1).select(workspace.quoted_summary(F.lit(text).cast("string"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("FR-LSH x", "FR"), ("fr ls h wire", "FRLSH"), ("FRLS", "FRLS"), ("HFFR 2.5", "HFFR"), ("fr wire", "FR"), ("fry", None)])
def test_wire_kind(spark, text, want):
    assert spark.range(1).select(workspace.wire_kind(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(("query", "words", "want"), [("a b", "a x b", 0.05), ("a b", "a b a", 0.2), ("a b", "a a b", 0.1), ("a b", "a", 0.0), ("a", "a x a", 0.2), ("a b", "", 0.0), ("a b c", "a b x x c", 0.1 / 3)])
def test_cover_density(spark, query, words, want):
    found = spark.range(1).select(recall.cover_density(F.split(F.lit(query), " "), recall.words_of(F.lit(words)))).first()[0]
    assert found == pytest.approx(want)


def test_hybrid_recall_of_few_records(spark):
    items = spark.createDataFrame([(1, "armoured cable 4 core", "X-1"), (2, "junction box", "zq"), (3, None, None), (4, "", "armoured cable"), (5, "junction box", "zq"), (6, "switch", "aa armoured cable bb")], "id long, text string, sku string")
    queries = spark.createDataFrame([("armoured cable",), ("",), ("  ",), ("the junction",), ("bo",)], "query string")
    found = {}
    for r in recall.recall(queries, items).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["id"]))
    found = {q: [i for _, i in sorted(v)] for q, v in found.items()}
    # the sku that is the query comes first; a sku may hold the query; two letters are held by a compact text
    assert found == {"armoured cable": [4, 1, 6], "the junction": [2, 5], "bo": [2, 5]}


def test_hybrid_recall_of_empty_tables(spark):
    items, queries = spark.createDataFrame([], "id long, text string, sku string"), spark.createDataFrame([("a",)], "query string")
    assert recall.recall(queries, items).count() == 0
    assert recall.recall(queries.limit(0), spark.createDataFrame([(1, "a", "a")], "id long, text string, sku string")).count() == 0
