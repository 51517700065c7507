"""Divergence audit, agenda encoding and whitening against brute force and the plain library, with edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceatlas.llm import agenda, divergence, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, term string, block long, n int"


def audit(rows, least, top):
    """The audit, one Python loop after the other."""
    held, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, k in held[lang].items() if k >= least]
        shares = {}
        for s in [None] + [s for g, s in groups if g == lang]:
            n = {t: sum(count[lang, x][t] for g, x in groups if g == lang and s in (None, x)) for t in kept}
            shares[s] = {t: 1 + 10**9 * (k + 2) // (sum(n.values()) + 2 * len(kept)) for t, k in n.items()}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        mine = shares[source]
        pairs = [(o, sum(gap(mine[t], shares[o][t]) for t in kept)) for o in shares if o not in (None, source)]
        terms = [(t, gap(mine[t], shares[None][t])) for t in kept if count[lang, source][t] and mine[t] > shares[None][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = ["the", "The", "THE,", "a-b", "x1y", "été", "Été!", "ÀÉ", "名前", "naïve", "the\x00end", "don't", "(12)", "--"] + [f"w{chr(97 + i)}{chr(97 + i * 7 % 26)}." for i in range(26)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "\n", " \t x"]), rng.choice(["en", "fr", None, "xx"]), rng.choice(["a", "b", "c", "é", None])) for _ in range(600)]
    rows += [rows[0]] * 30 + [(None, "en", "empty"), ("", None, "none"), ("one", "few", "p"), (None, "few", "q"), ("alone " * 30000, "single", "s")]
    return rows


def test_divergence_equals_brute_force(spark, prose, monkeypatch):
    docs = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(prose)], DOCS).repartition(7)
    want = audit(prose, 10, 10)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 100
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == want
    monkeypatch.setattr(divergence, "TILE", 2)  # several tiles, and no broadcast of hot chunks
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(divergence, "TERM_ROWS", 3)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == want
    assert sorted(map(tuple, divergence.divergence(docs, least_documents=1, top=3).collect())) == audit(prose, 1, 3)


def test_divergence_of_hot_chunks_and_edges(spark):
    rows = [("the the, The", "en", f"s{i % 3}") for i in range(300)] + [(f"the only{i}", "en", "s0") for i in range(30)]
    docs = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(rows)], DOCS).repartition(40)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == audit(rows, 10, 10)
    _, documents = divergence.term_counts(divergence.grouped(docs))
    assert {r.term: r.documents for r in documents.collect()}["the"] == 330
    assert divergence.divergence(docs.limit(0)).count() == 0
    assert divergence.divergence(docs.limit(1)).count() == 0  # one source, no kept term


def test_divergence_over_many_blocks_and_small_batches(spark, prose, monkeypatch):
    docs = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(prose)], DOCS).repartition(3)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 500)
    monkeypatch.setattr(divergence, "BUCKET_BITS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a term's lists go on over several batches
    try:
        assert sorted(map(tuple, divergence.divergence(docs).collect())) == audit(prose, 10, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_merge_alike_in_batches_of_any_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, b, c, sorted(rng.sample(range(40), rng.randint(1, 9)))) for t in "abc" for b in (1, 2, 7) for c in range(rng.randint(1, 4))]
    want = {t: (sum(len(h) * (c + 1) for u, _, c, h in rows if u == t), sum(len({p for u, v, _, h in rows if (u, v) == (t, b) for p in h}) for b in (1, 2, 7))) for t in "abc"}
    held = [divergence._varints(np.array([x for i, d in enumerate(np.diff(h, prepend=0)) for x in (d, 8 * 5 if i == 0 else 0)]))[0].tobytes() for *_, h in rows]
    t = pa.table({"term": [r[0] for r in rows], "times": pa.array([r[2] + 1 for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "held": pa.array(held, pa.binary())})
    for size, most in ((1, 1), (3, 1), (1, 1 << 20), (100, 1)):
        monkeypatch.setattr(divergence, "MERGE_BYTES", most)
        got = defaultdict(lambda: [0, 0])
        for b in divergence._merge_task(iter(t.to_batches(size))):
            for r in b.to_pylist():
                assert r["g"] == 5
                got[r["term"]][0] += r["n"]
                got[r["term"]][1] += r["d"]
        assert {k: tuple(v) for k, v in got.items()} == want


def test_packed_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**55 - 1, 0, 5])
    raw, width = divergence._varints(values)
    back, ends = divergence._values(raw)
    assert back.tolist() == values.tolist() and (np.diff(ends, prepend=-1) == width).all()
    assert divergence._values(divergence._varints(values[:0])[0])[0].tolist() == []


def test_shares_are_exact_beyond_long(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 9_999_999_999_999, 7)], "c long, t long, v long")
    assert big.select(divergence._share("c", "t", "v", 2, 1_000_000_000).alias("p")).first().p == 1 + 10**9 * 9_000_000_000_002 // (9_999_999_999_999 + 14)


def odd_texts():
    rng = random.Random(5)
    signs = list("ab cdeE .,\n\t▁é日本語😀\x00�<>s/_-") + ["  ", "the", "ing", " of", "<s>", "́", "ß", "क", "\U0010ffff", "<0x0A>", "</s>"]
    return ["", "   ", "▁", " a", "a" * 5000, "▁ " * 300, "日本" * 2000] + ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]


def test_agenda_equals_the_library(spark):
    texts = [*odd_texts(), None]
    sp = agenda.Pieces.of(agenda.default_vocabulary()).library
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string").repartition(5)
    for verify in ("parts", "texts", None):
        got = Counter((r.doc_id, bytes(r.ids), r.decoded, r.agrees) for r in agenda.encode_documents(docs, verify=verify).collect())
        ids = [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]
        assert got == Counter((i if i % 9 else None, np.array(x, "<u4").tobytes(), sp.decode(x), True if verify else None) for i, x in enumerate(ids))
    assert agenda.encode_documents(docs.limit(0)).count() == 0


def test_a_wrong_part_is_seen(spark, monkeypatch):
    import pyarrow as pa

    pieces = agenda.Pieces(agenda.default_vocabulary())
    monkeypatch.setattr(pieces, "agenda", lambda t: [5])
    assert pieces.encode(pa.array(["one two", ""], pa.large_string()), True)[2].tolist() == [False, True]


def test_any_ids_decode_as_in_the_library(spark):
    rng = random.Random(6)
    sp = agenda.Pieces.of(agenda.default_vocabulary()).library
    lists = [[rng.choice([0, 1, 2, 3 + rng.randint(0, 255), rng.randint(259, 31999), 28705]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)] + [(-1, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in agenda.decode_documents(rows).collect()}
    assert got == {-1: "", **{i: sp.decode(x) for i, x in enumerate(lists)}}


def test_encode_query_on_given_documents(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    sp = agenda.Pieces.of(agenda.default_vocabulary()).library
    want = []
    for d in docs:
        x = sp.encode(d["text"] or "", add_bos=True, add_eos=True)
        want.append((d["doc_id"], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest(), True))
    assert sorted(map(tuple, queries.op12_agenda_encode(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def whitened(vectors):
    """(integers, deviations, eigenvalues, eigenvectors, trace) by a dense eigenvalue routine."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, ((n * x - s) ** 2).sum(1), c, e[::-1], v[:, ::-1]


def check_whitening(spark, vectors, rank, simple=True):
    rows = [(i, [float(x) for x in v], 1, 2.0) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, z double").repartition(3)).collect()
    _, deviation, c, e, v = whitened(vectors)
    k, n = min(32, rank), len(vectors)
    assert len(got) == n * k
    z = np.zeros((n, k))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-8
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-8
    if simple:
        for j in range(k):
            want = c @ v[:, j] / np.sqrt(e[j])
            assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) < 1e-7, j


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, rng.normal(size=(300, 40)) * np.linspace(5, 0.5, 40), 40)
    check_whitening(spark, np.repeat(rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1], 3, 0), 5)


def test_whitening_of_low_rank_and_equal_eigenvalues(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(-9, 9, size=(200, 3)) @ rng.integers(-3, 4, size=(3, 12))
    check_whitening(spark, low, 3)
    axes = np.concatenate([np.eye(9), -np.eye(9)])
    check_whitening(spark, axes, 9, simple=False)  # all eigenvalues are equal
    check_whitening(spark, np.concatenate([axes, np.zeros((4, 9))]) * [4, 4, 4, 2, 2, 1, 1, 1, 1], 9, simple=False)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [0.5, 0.25])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (10, 1), (10, 2)] and {r.n for r in got} == {4}
    assert max(r.identity_error for r in got) < 1e-9
    for few in ([], rows[:1], rows[:2], rows[3:8]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows, schema)).select(F.sum("whitened")).first()[0] == pytest.approx(0, abs=1e-9)
