"""Records that hold all terms of a query, on fixed cases and against brute force."""

import itertools

from priceatlas.operators import search


def test_terms_inside_words(spark):
    texts = ["Steelworks 10mm", "STEEL-clamp", "clamp", "", None, "ÜBER steel 4", "a.b%c_d"]
    terms = ["steel", "clamp", "10", "4", "m", "über", "%c_", "el", "absent", "works 1"]
    queries = [[a] for a in terms] + [list(p) for p in itertools.combinations(terms, 2)] + [["", "el"], [""], [], None, [None, "el"]]
    records = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(str(q), q) for q in queries] * 2, "query string, terms array<string>")
    got = [tuple(r) for r in search.holding_all(records, asked).collect()]
    kept = [(str(q), [t for t in q if t != ""]) for q in queries if q and None not in q]
    want = {(name, i) for name, q in kept if q for i, text in enumerate(texts) if text is not None and all(t in text.lower() for t in q)}
    assert set(got) == want and len(got) == len(want)
    assert search.holding_all(records.limit(0), asked).count() == 0
