"""Main text of odd pages, extraction against a plain parser on given pages, and packing of short texts."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from priceatlas.llm import html_extract, pack, queries

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(("page", "want"), [
    ("<article>story</article><div class='comments'><article>c1</article></div>", "story"),
    ("<article class='teaser'>t1</article><main>real story</main>", "real story"),
    ("<main><h1>Title</h1><p>lead</p><article>body</article></main>", "Title\n\nlead\n\nbody"),
    ("<article><section id='related-work'>rw</section><p class='share-price'>sp</p><div class='share-buttons'>a</div><p class='comment-list'>b</p></article>", "rw\n\nsp"),
    ("<p title=\"x>One</p><p>Two", "One\n\nTwo"), ("<form><div class='menu'><article>only</article></div></form>", "only"), ("<main></main><article>a</article>", "a"),
    ("<div class='widget'><article>teaser</article></div><form><main>the main text is longer</main></form>", "the main text is longer"),
])
def test_main_text_of_odd_pages(page, want):
    assert html_extract.main_text(page) == want


class Plain(HTMLParser):
    """Blocks of the article, for pages whose articles hold headings and paragraphs."""

    def __init__(self):
        super().__init__()
        self.depth, self.lost, self.blocks, self.now = 0, 0, [], ""

    def cut(self):
        if s := " ".join(self.now.split()):
            self.blocks.append(s)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.lost += tag in ("script", "style")
        if tag in html_extract._BLOCKS:
            self.cut()
        elif tag in ("br", "td", "th"):
            self.now += " "

    def handle_endtag(self, tag):
        if tag in html_extract._BLOCKS:
            self.cut()
        self.depth -= tag == "article"
        self.lost -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.lost:
            self.now += data


def test_given_pages_equal_a_plain_parser(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op1_site_templates(spark, sf).collect()}
    simple = 0
    for k, html in pages.items():
        assert got[k].n_chars == len(got[k].text)
        if html and html.count("<article") == 1 and not any(t in html for t in ("<main", "<aside", "class=\"comment", "<form")):
            p = Plain()
            p.feed(html)
            p.close()
            p.cut()
            assert got[k].text == "\n\n".join(p.blocks), k
            simple += 1
    assert len(got) == len(pages) and simple > len(pages) / 3


def test_templates_by_number_and_place(spark):
    """Five pages of a small host may share a paragraph of the article; what they share outside goes. Eight or more that share it lose it."""
    few = [(i, f"http://small/{i}", f"<div>offer of the week</div><article><p>shared words</p><p>own {i}</p></article><p>more {i}</p>") for i in range(5)]
    many = [(100 + i, f"http://large/{i}", f"<article><p>shared words</p><p>own {i}</p></article>") for i in range(20)]
    below = [(200 + i, f"http://below/{i}", f"<div><p>unmarked</p></div><p>own text {i}</p>") for i in range(4)]
    share = [(300 + i, f"http://share/{i}", f"<div>{'tie' if i < 6 else 'x' + str(i)}</div><p>own text {i}</p>") for i in range(20)]  # right at the share
    rows = few + few[:2] + many + below + share
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "shared words\n\nown 3" and got[105] == "own 5" and got[201] == "unmarked\n\nown text 1" and got[302] == "own text 2" and got[310] == "x10\n\nown text 10"


def test_pages_with_odd_columns(spark):
    schema = "`a.b` int, `odd name` string, text int, page string, cut int, url string, html string, `struct` struct<`x y`:int>"
    rows = [(1, "p", 2, "q", 3, "http://h/1", "<p>one</p>", (4,)), (None, None, None, None, None, None, None, None)] * 2
    got = html_extract.extract_main_text(spark.createDataFrame(rows, schema))
    assert set(got.columns) == {"a.b", "odd name", "text", "page", "cut", "url", "html", "struct"} and sorted(r.text for r in got.collect()) == ["", "", "one", "one"]
    assert html_extract.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_short_texts_fill_their_sequences(spark):
    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("cat"), F.when(F.col("id") % 3 == 1, " dog").otherwise(""))).alias("text"))
    rows = pack.pack_documents(docs, with_ids=False).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in rows)
    assert total == 9000 * 2 and len(rows) == -(-total // 4096) and sorted(r.n for r in rows)[1] > 0.95 * 4096
