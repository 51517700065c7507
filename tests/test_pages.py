"""Pages of tables by markers before them."""

from priceatlas.operators import pages


def test_pages_by_numbers_bodies_and_distance(spark):
    number = lambda n: f'<p class="page-number" id=x> {n} </p>'
    body = '<div class="page-body-container">'
    far = "y" * 4990
    texts = [
        (1, f"<table>a</table>{number(3)}<table>b</table>{number(4)}{number(5)}<table>c</table>{far}<table>d</table>"),
        (2, f"{body}<table>a</table>{body}<div class='not-page-body-containers'>{number(9)}{far}<table>b</table>{body}"),
        (3, f"<table>{number(7)}</table>\n<TABLE x=1>\nq</TABLE>"), (4, "no table"), (5, None), (6, ""), (7, f"{number('99999999999999999999')}<table>z</table>"), (8, "<table>open"), (3, "<table>other text</table>"), (4, "no table"),
    ]
    got = sorted((r.id, r.table_no, r.page or 0, r.html[-9:]) for r in pages.table_pages(spark.createDataFrame(texts, "id long, text string")).collect())
    assert [g[:3] for g in got] == [(1, 0, 0), (1, 1, 3), (1, 2, 5), (1, 3, 0), (2, 0, 1), (2, 1, 2), (3, 0, 0), (3, 0, 0), (3, 1, 7), (7, 0, 0)]
    assert pages.table_pages(spark.createDataFrame([], "id long, text string")).count() == 0


def test_a_text_is_cut_once_and_not_hashed(spark):
    docs = spark.createDataFrame([(1, "</table>İ-<p CLASS=\"page-number\">4<b><TABLE>a</Table></table>-page-body-container<table><table>b</table>c</table>" + "<table" * 20), (1, "<table>a</table>"), (1, "<table>a</table>")], "id long, text string")
    found = pages.table_pages(docs)
    got = sorted((r.page or 0, r.table_no, r.html) for r in found.collect())
    assert got == [(0, 0, "<table>a</table>"), (4, 0, "<TABLE>a</Table>"), (4, 1, "<table><table>b</table>")]
    plan = pages.table_pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("</table>") == 1 and "HashAggregate" not in plan
