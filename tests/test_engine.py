"""Table sources on awkward documents, the second dialect, price bases, quotation rates, query parsing and the candidate score on fixed cases."""

import pytest
from pyspark.sql import functions as F

from priceatlas.functions.electrical import normalize_n2, price_basis, quotation_rate
from priceatlas.operators import engine, ingest, quotes
from priceatlas.sources import grids


@pytest.mark.parametrize(("text", "want"), [
    ('a, "b ""x"", c" ,\r\n\n,,\rd', [["a", 'b "x", c'], ["d"]]), ("", []), (None, []), ("one", [["one"]]),
])
def test_csv(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r.cells for r in grids.read_csv_text(docs).orderBy("row_no").collect()] == want


@pytest.mark.parametrize(("text", "want"), [
    ("<table><tr><td rowspan=2>a<td colspan='2'>b</tr><tr><td>c<br>d&amp;</table>", [["a", "b", "b"], ["a", "c d&", ""]]),
    ("<table><tr><td rowspan=9>a</table>", [["a"]]), ("<table><td colspan=x>q", [["q"]]), ("<p>no table</p>", []), ("</table></tr>", []), (None, []),
])
def test_html(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r.cells for r in grids.read_html_tables(docs).orderBy("row_no").collect()] == want


def test_workbook_round_trip(spark):
    rows = [["a & <b>", "", "ü"], ["", "x"]]
    made = grids.write_workbooks(spark.createDataFrame([(7, rows), (8, None)], "id long, grid array<array<string>>"))
    assert [(r.id, r.cells) for r in grids.read_workbooks(made).orderBy("row_no").collect()] == [(7, rows[0]), (7, rows[1])]
    assert grids.workbook_grids(b"no workbook") == []


def test_markdown_and_pages(spark):
    text = "a | b\nplain\n\n| Name | Rate |\n|---|---|\n| x | 1 |\n| y | 2 |\n\nh | k\n--- | ---\nno pipe"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    assert [(r.table_no, r.row_no, r.cells) for r in grids.read_markdown_tables(docs).orderBy("table_no", "row_no").collect()] == [(0, 0, ["Name", "Rate"]), (0, 1, ["x", "1"]), (0, 2, ["y", "2"])]
    mark = "\n\n{%d}" + grids.MARK + "\n\n"
    docs = spark.createDataFrame([(1, (mark % 0).lstrip() + "one" + mark % 1 + "two"), (2, "first" + mark % 3 + "last"), (3, "bare"), (4, " \n"), (5, None)], "id long, text string")
    assert {(r.id, r.page, r.text) for r in grids.split_pages(docs).collect()} == {(1, 1, "one"), (1, 2, "two"), (2, 3, "first"), (2, 4, "last"), (3, 1, "bare")}


def test_flat_rows(spark):
    grid = [["Description", "SKU", "Unit", "Rate"], ["Steel clamp 25", "SC25", "pcs", "₹ 45.50"], ["Total"], ["Brass valve 15 mm", "", "nos", "25 mm"], ["Iron hook 3 way", "", "", "1,250/-"]]
    rows = spark.createDataFrame([(1, 0, i, c) for i, c in enumerate(grid)], grids.GRID)
    got = ingest.flat_price_rows(rows).orderBy("row_no").collect()
    assert [(r.raw_name, r.sku, r.unit, r.price) for r in got] == [("Steel clamp 25", "SC25", "pcs", 45.5)]
    assert ingest.flat_price_rows(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("25 mm", None), ("2+1", None), ("3/4", None), ("abc 5", None), ("₹ 1,234.50", 1234.5), ("100 pcs", None), ("45 each", 45.0), ("", None), (None, None)])
def test_strict_price(spark, text, want):
    assert spark.range(1).select(ingest.strict_price(F.lit(text).cast("string"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("6SqmmX2Core Cu Armoured Cable", "6 sqmm 2 core copper armoured cable"), ("4Sqmm FRLs Wire 200Mtr", "4 sqmm frls wire 200 mtr"), ("1.5 sq.mm 300 metres", "1.5 sqmm 300 mtr"),
    ("25Sqmm*3.5Core XLPE Cu Armoured", "25 sqmm 3.5 core xlpe copper armoured"), ("No. of Cores", "no of cores"), ("3M Plate", "3 m plate"),
])
def test_second_dialect(spark, text, want):
    assert spark.range(1).select(normalize_n2(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(("price", "unit", "context", "want"), [
    (2500.0, None, "Rate per 100 meter", (100.0, "meter", None, "100 meter", 25.0)), (1120.0, "coil", "300 Mtr coil", (300.0, "meter", "coil", "300 meter coil", 3.73)),
    (1120.0, "coil", "300Mtr coil", (1.0, "coil", None, "coil", 1120.0)), (10.0, None, "", (1.0, None, None, None, 10.0)), (10.0, None, "0 box", (1.0, "box", None, "box", 10.0)),
])
def test_price_basis(spark, price, unit, context, want):
    assert tuple(spark.range(1).select(price_basis(F.lit(price), F.lit(unit).cast("string"), F.lit(context))).first()[0]) == want


def test_quotation_rate(spark):
    b = price_basis(F.lit(1120.0), F.lit("coil"), F.lit("300 Mtr coil"))
    row = spark.range(1).select(b.alias("b")).select(*[quotation_rate(F.lit(1120.0), F.col("b"), F.lit(q), F.lit(u)) for q, u in [(6, "bundle"), (90, "meter"), (0, "kg")]]).first()
    assert [tuple(r) for r in row] == [(6.0, "bundle", 1120.0), (90.0, "meter", 3.73), (1.0, "300 meter coil", 1120.0)]


def test_query_parts(spark):
    texts = ["12 nos 6Amp Switch", "3 PKT blank plate", "2 boxes 6Amp Switch", "25Sqmm*3.5Core XLPE Cu Armoured Cabel", "2 bdl 4SqmmXSC red wire", "2 pair telephone cable unarmoured 0.5mm 90 meter coil", "qty 12 - 10 sqmm 4 core al armoured", None]
    rows = engine.parse_queries(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, query string")).orderBy("i").collect()
    asked = [[(r["value"], r["unit"]) for r in x.requested] for x in rows]
    hints = [[(h["name"], h["value"]) for h in x.hints] for x in rows]
    assert asked[:3] == [[(12.0, "piece")], [(3.0, "packet")], [(2.0, "box")]] and rows[0].match == "6 amp switch"
    assert hints[3] == [("size", 25.0), ("cores", 3.5)] and "cable" in rows[3].terms
    assert asked[4] == [(2.0, "bundle")] and ("cores", 1.0) in hints[4]
    assert (90.0, "meter") in asked[5] and hints[5][:2] == [("pair", 2.0), ("mm", 0.5)]
    assert asked[6] == [(12.0, None)] and hints[6] == [("size", 10.0), ("cores", 4.0)] and rows[6].terms == ["aluminium", "armoured"]
    assert asked[7] == [] and rows[7].terms == []


def test_split(spark):
    split = spark.createDataFrame([("a cable; b wire",), ("switch, socket",), ("2,5 mm wire",), ("",)], "t string").select(engine.split_items(F.col("t")).alias("s")).collect()
    assert [r.s for r in split] == [["a cable", "b wire"], ["switch", "socket"], ["2,5 mm wire"], []]


_OLD = "COPPER ARMOURED CABLES • 2XWY/2XFY 6"
CANDIDATES = {
    "CAB": dict(price=693.0, unit="meter", rows="6 sqmm", columns="2 core", parents="Copper conductor", title="XLPE Armoured Cables with Copper Conductor", section="XLPE Armoured Cables with Copper Conductor", product="XLPE Armoured Cables with Copper Conductor 6 sqmm 2 core", sku="6 sqmm", attributes=[("size", 6.0, "sqmm"), ("cores", 2.0, None)], page=5, confidence=0.9, recall=1.0),
    "LEG": dict(price=693.0, unit="2 CORE", rows=f"{_OLD} 2 CORE 6", columns="2 CORE", parents="Vendor", title="Fixture Price List", section="Vendor Fixture Price List", product=f"{_OLD} 2 CORE", sku="6", attributes=[("size", 6.0, "sqmm"), ("cores", 2.0, None)], page=None, confidence=0.78, recall=0.92),
    "WB": dict(price=100.0, unit="meter", rows="25 sqmm", columns="3.5 core", parents="Copper conductor", title="XLPE Copper Armoured Cable", section="XLPE Armoured Cables with Copper Conductor", product="25 sqmm 3.5 core XLPE Copper Armoured Cable", sku=None, attributes=[("size", 25.0, "sqmm"), ("cores", 3.5, None)], page=5, confidence=0.9, recall=1.0),
    "FRW": dict(price=1120.0, unit="coil", rows="1.5 sqmm FR wire", columns="300 meter coil", parents="Copper conductor", title="FR Wire Coils", section="FR Wire", product="FR Wire 1.5 sqmm 300 meter coil", sku="1.5 sqmm", attributes=[("size", 1.5, "sqmm"), ("length", 300.0, "meter")], page=8, confidence=0.9, recall=1.0),
}
CASES = [
    ("CAB", "6SqmmX2Core copper armoured cable", 0.85, 1), ("CAB", "6 sq mm x 2 core copper armoured cable", 0.85, 1), ("CAB", "6SQMM 2C cu armoured cable", 0.85, 1), ("CAB", "XLPE copper 6 sqmm 2 core rate", 0.85, 1),
    ("LEG", "6SqmmX2Core Cu Armoured Cable", 0.85, 1), ("LEG", "6SqmmX2Core", 0, 0.8499), ("WB", "25Sqmm*3.5Core XLPE Cu Armoured Cabel", 0.85, 1), ("CAB", "6 sqmm 2 core copper unarmoured cable", 0, 0.6499),
    ("FRW", "1.5Sqmm FR Wire 300Mtr", 0.75, 1), ("FRW", "300Mtr 1.5Sqmm FR Wire", 0.75, 1), ("FRW", "fr wire 1.5sqmm 300 meter", 0.75, 1), ("FRW", "1.5sqmm frwire 300mtr", 0.75, 1),
]


def test_score(spark):
    texts = ["unit", "rows", "columns", "parents", "title", "section", "product", "sku"]
    rows = [(k, *[c[t] for t in texts], c["price"], c["page"], c["confidence"], c["recall"], c["attributes"]) for k, c in CANDIDATES.items()]
    own = spark.createDataFrame(rows, f"key string, {', '.join(f'{t} string' for t in texts)}, price double, page int, confidence double, recall double, attributes array<struct<name:string,value:double,unit:string>>")
    none = F.lit(None).cast("string")
    shown = F.concat_ws(" ", F.lit("Vendor: Fixture Section:"), "section", F.lit("Row:"), "rows", F.lit("Column:"), "columns", F.lit("Header:"), "parents", F.lit("Rate:"), F.col("price").cast("string"))
    own = engine.candidates(own.select("*", shown.alias("searchable"), F.col("product").alias("description"), none.alias("vendor"), none.alias("raw_cell"), F.lit(0.0).alias("recency"), F.lit(False).alias("duplicate")))
    asked = spark.createDataFrame([(i, k, q) for i, (k, q, _, _) in enumerate(CASES)], "i int, key string, query string")
    asked = engine.parse_queries(asked).withColumn("vendor_terms", F.array().cast("array<string>")).withColumn("alias_confidence", F.lit(None).cast("double"))
    got = {r.i: r.score for r in engine.score_candidates(asked.join(own, "key")).collect()}
    assert {i: (CASES[i], s) for i, s in got.items() if not CASES[i][2] <= s <= CASES[i][3]} == {} and len(got) == len(CASES)


def test_latency_sorts_no_whole_type(spark):
    rows = [("a", float(x)) for x in range(1, 21)] + [("a", 19.0)] * 3 + [(None, 3.0), ("b", -2.5), ("b", None)]
    out = quotes.latency_of(spark.createDataFrame(rows, "event_type string, value double"))
    assert {r.event_type: (r.n, r.p95) for r in out.collect()} == {"a": (23, 19.0), None: (1, 3.0), "b": (1, -2.5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
