"""Operators against brute force, round trips and edge rows: nulls, empty and long texts, ties, repeats, extra columns, empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceatlas.llm import audio_match, chat_format, html_extract, language_id, near_dedup, pack, shard, source_mix, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score double"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, letterless and very long texts, repeated rows, and columns with names the operators use inside."""
    long = "alpha beta gamma delta epsilon zeta eta theta " * 4000
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1, 9, 0.5), (1, "the cat sat on the mat and looked at the dog", "en", "a", 1, 9, 0.5), (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 9, 0.5), (None, "the cat sat on the mat and looked at the dog", "fr", "b", 1, 9, 0.5), (4, long, "en", None, 1, 9, 0.5), (5, "123 !!", None, "b", 1, 9, 0.5), (6, "one two", "en", "b", 1, 9, 0.5),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 12)) * rng.uniform(0.1, 3, size=(400, 1))
    v[7] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(50, [float(x) for x in v[50]]), (3, [float(x) for x in v[3]]), (900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (None, [1.0] * 12), (950, [1.0, 2.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    q = np.floor(256 * v).astype(np.int64)
    for i in range(0, 400, 50):
        s = q @ q[i]
        want = [(int(s[j]), j) for j in sorted((j for j in [*range(400), 3, 50] if j != i), key=lambda j: (-s[j], j))[:5]]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 0


def test_topk_in_many_blocks(spark, monkeypatch):
    """Small groups, blocks and runs, two dimensions, clashing columns: still every query's best."""
    for name, n in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("HEAD_BLOCKS", 2), ("RUN_BLOCKS", 3)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 8)) * rng.uniform(0.01, 3, size=(900, 1))
    v[::7] = 0
    rows = [(i, [float(x) for x in r[: 8 if i % 3 else 5]], 1, 2) for i, r in enumerate(v)]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int, g int"), F.col("id") % 10 == 0, k=3).collect()
    q = [np.floor(256 * np.array(r[1])).astype(np.int64) for r in rows]
    for i in range(0, 900, 10):
        near = sorted((-int(q[i] @ q[j]), j) for j in range(900) if j != i and len(q[j]) == len(q[i]))[:3]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == near


def test_mix_follows_rates(spark, edge, none):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("replica"))
    out = source_mix.poisson_mix(docs, weights={"a": 0.75, "b": 0.25}, total=60_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 45_000) < 900 and abs(n["b"] - 15_000) < 500
    order = [r["__order"] for r in out.select("__order").collect()]
    assert order == sorted(order)
    assert set(source_mix.poisson_mix(edge).columns) >= set(edge.columns)
    assert source_mix.poisson_mix(none).count() == 0


def test_chats_fold_and_round_trip(spark):
    log = [
        (1, 0, 10, 0, "user", "message", ""), (1, 0, 10, 1, None, "delta", "he"), (1, 0, 10, 2, None, "delta", "llo"), (1, 1, 11, 0, "assistant", "message", ""), (1, 1, 11, 1, None, "delta", "bad"),
        (1, 1, 11, 2, None, "regenerate", None), (1, 1, 11, 3, None, "delta", "go"), (1, 1, 11, 4, None, "delta", "od </turn> & <turn user>"), (1, 2, 12, 0, "user", "message", ""), (1, 2, 12, 1, None, "delta", "x"), (1, 2, 12, 2, None, "edit", "y"), (None, None, 13, 0, None, "message", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, message_id long, seq int, role string, kind string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(events)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hello"), ("assistant", "good </turn> & <turn user>"), ("user", "y")]
    assert got[1].loss == ["", "good </turn> & <turn user>", ""]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    texts = [None, "", "a\\ < &lt; > </turn>\n", "é" * 9000]
    turns = spark.createDataFrame([(7, i, "assistant", t, 1) for i, t in enumerate(texts)] + [(7, 9, None, "r", 1)] * 2, "conv_id long, turn long, role string, text string, seq int")
    row = chat_format.read_back(chat_format.format_chats(chat_format.events_of(turns))).first()
    assert row.n_turns == 6 and [t.text for t in row.turns] == [t or "" for t in texts] + ["r", "r"] and row.loss == [t or "" for t in texts] + ["", ""]
    assert chat_format.format_chats(chat_format.events_of(turns.limit(0))).count() == 0


def test_chats_with_ties_equal_sql(spark, tmp_path):
    """Tied turns go by the plain text, as in the SQL, also where escaping would order them otherwise."""
    import duckdb

    from priceatlas.llm import queries

    rows = [(1, 0, "user", "a b", 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, 1, "assistant", "<", 1), (1, 1, "assistant", "0", 1), (2, None, None, None, 1), (2, 3, "assistant", "&lt;", 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message_id int").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op3_chat_format(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = c.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.OP3_SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 3


def test_shards_are_even_and_keep_groups(spark, edge, none):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).when(F.col("id") < 500, "hot").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("text"))
    rows = shard.balanced_shards(docs).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 1000 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    spread = {}
    for r in rows:
        spread.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in spread.items() if t.startswith("t")) <= 10 and len(spread["hot"]) <= 8
    got = shard.balanced_shards(edge).collect()
    assert sorted((r.id or 0, r.size) for r in got)[1:3] == [(1, 45), (1, 45)] and {r.text_crc32 for r in got if r.id in (2, 3)} == {0}
    assert shard.balanced_shards(none).count() == 0


def test_shards_swap_copies_without_unlinked_rows(spark):
    pairs = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 800).cast("string")).alias("text"))
    rows = shard.balanced_shards(pairs).join(pairs.withColumnRenamed("doc_id", "id"), "id").collect()
    sizes, spread = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
        spread.setdefault(r.text, set()).add(r.shard)
    assert len(rows) == 1600 and set(sizes.values()) == {100} and sum(len(s) > 1 for s in spread.values()) <= 40, sum(len(s) > 1 for s in spread.values())
    assert shard.flows({(0, 1): 5, (1, 2): 4, (2, 0): 3}, [0, 0, 1]) == {(0, 1): 4, (1, 2): 4, (2, 0): 3}


def test_packing_covers_every_token(edge, none):
    from tokenizers import Tokenizer

    rows = pack.pack_documents(edge.where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True).collect()
    tok = Tokenizer.from_file(pack.default_vocabulary())
    for doc in edge.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        pieces = sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.start)
        ids = np.array(tok.encode(doc.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in pieces) == ids and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)
    for s in {r.sequence_id for r in rows}:
        held = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert sum(r.length for r in held) <= 4096 and [r.offset for r in held] == list(np.cumsum([0] + [r.length for r in held])[:-1])
    assert pack.pack_documents(none).count() == 0


def test_packing_under_three_limits(spark):
    """Conversations as prompt and answer: no sequence breaks a limit, each limit binds somewhere, and all tokens are there."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    prompt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.coalesce(t.text, F.lit(""))), " ")
    pairs = turns.groupBy("conv_id").agg(prompt.alias("prompt"), last["text"].alias("text"))
    bounds = {}
    for most in ((512, 6, 60), (512, 6, 512), (4096, 3, 4096)):
        rows = pack.pack_documents(pairs, tokens=most[0], segments=most[1], loss=most[2], id_col="conv_id", prompt_col="prompt").collect()
        tok = pack.WordEncoder.of(pack.default_vocabulary()).tok
        count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
        starts = {r.conv_id: count(r.prompt) for r in pairs.collect()}
        sums = {}
        for r in rows:
            x = sums.setdefault(r.sequence_id, [0, 0, 0])
            for i, n in enumerate((r.length, 1, max(0, r.start + r.length - max(r.start, starts[r.doc_id])))):
                x[i] += n
        assert all(a <= b for x in sums.values() for a, b in zip(x, most, strict=True))
        bounds[most] = [max(x[i] for x in sums.values()) for i in range(3)]
        assert sum(r.length for r in rows) == sum(count(r.prompt) + count(r.text) + 1 for r in pairs.collect())
    assert bounds[512, 6, 60][2] == 60 and bounds[512, 6, 512][0] == 512 and bounds[4096, 3, 4096][1] == 3
    tight = pack.Packer(100, 2, 30)
    for i in range(9):
        assert not list(tight.add(i, 15, bytes(4 * 40)))
    for held in tight.pack(True):
        assert (tight.demand(held).sum(0) <= tight.limits).all()


def test_near_duplicates_equal_brute_force(spark, edge, none, monkeypatch):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(20)]
    texts = list(base)
    for t in base:
        for edits in (0, 1, 2, 3, 5):
            w = t.split()
            for at in rng.integers(0, 60, edits):
                w[at] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in near_dedup.near_duplicates(docs, words=4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    parent = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    changed = True
    assert [got[i].component_id for i in range(len(sets))] == parent and [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    monkeypatch.setattr(near_dedup, "DENSE", 3)  # regions in parts find the same
    assert {r.id: r.component_id for r in near_dedup.near_duplicates(docs, words=4).collect()} == {i: g.component_id for i, g in got.items()}
    rows = near_dedup.near_duplicates(edge, words=4).collect()
    assert sorted((r.id or 0, r.component_id, r.kept) for r in rows) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_packing_keeps_added_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pack.default_vocabulary())
    rng = random.Random(1)
    signs = ["a", "B", "é", "İ", ".", ",", "'s", " ", "\n", "\t", "1", "½", "中", "ß", "ŉ", "\u0307", "\ufb1f", "!", "<|endoftext|>", " ", "the", "ing", " ", "."]
    texts = ["a <|endoftext|> b", "a<|startoftext|>b, c.\nd <|endoftext|>", "plain <| text |>", "İ.", "İ, x", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(1000))]
    rows = pack.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_near_duplicates_of_null_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text.upper()), (5, text), (2, text.replace("w30", "z"))], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs, words=4).collect()} == {2}


def test_language(spark, edge, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.fit(docs, ~held)
    rows = language_id.identify(docs, model, ["doc_id", "lang"]).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(edge, model, edge.columns[:2]).collect()}
    assert got[2] == got[3] == got[5] == "und" and got[6] != "und"
    assert language_id.identify(none, language_id.fit(none, F.lit(True)), ["doc_id"]).count() == 0
    trie, probs = language_id.Trie.of(model[2]), model[1]
    at, m = next(language_id.by_length(["cat"]))
    alpha = trie.forward(trie.arcs(m), 1, 4, probs)[4, 0, 0]
    piece = {p: i for i, p in enumerate(trie.pieces)}

    def brute(rest):
        return 1.0 if not rest else sum(probs[piece[rest[:n]], 0] * brute(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in piece)

    assert alpha == pytest.approx(brute("▁cat"), rel=1e-9)


def test_toxicity(spark, edge, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    plain = toxicity.score(docs, model, ["doc_id", "text"]).toPandas()
    insulted = plain.text.str.contains("idiot|moron|stupid|scum", regex=True)
    above = (plain.toxicity[insulted].to_numpy()[:, None] > plain.toxicity[~insulted].to_numpy()[None, :]).mean()
    assert above >= 0.97 and (plain.toxicity[~insulted] >= 0.7).mean() <= 0.02
    assert plain.toxicity.between(0, 1).all()
    assert toxicity.score(edge, model, edge.columns).count() == 8
    assert toxicity.fit(none, labels.limit(0), F.lit(True)) is None
    assert toxicity.score(edge, None, ["doc_id"]).where("toxicity > 0").count() == 0 and toxicity.score(none, model, ["doc_id"]).count() == 0


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>Menu</li></ul></nav><header>Top</header><div class='cookie-notice'>Cookies</div><article><h1>A &amp; B</h1><p>one <b>two\n three<br>four<p>five&nbsp;six<form>x</form><article>nested comment</article><script>var a='</p>';</script></article><section id=comments><p>me too</p></section><aside>side</aside><footer>f</footer></body>"
    assert html_extract.main_text(page) == "A & B\n\none two three four\n\nfive six"
    assert html_extract.main_text("plain text") == "plain text" and html_extract.main_text(None) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html_extract.main_text(deep) == "x"
    rows = [(i, "http://h/" + str(i), f"<body><p>Join our list today</p><p>story {i} about {i * 7}</p></body>", "clash") for i in range(8)] + [(90, None, None, None), (91, "http://[bad", "", "x")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3] == "story 3 about 21" and got[90] == got[91] == ""


def test_templates_are_counted_on_the_whole_page(spark):
    notice = "<p class='x7'>" + " ".join(f"term{i}" for i in range(50)) + "</p>"
    rows = [(i, f"http://h/{i}", f"<body><div class='x1'>Top</div><article><h1>Title {i}</h1>{notice}<p>story {i}</p></article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nstory 3"


def test_templates_are_counted_per_host(spark):
    notice = "<p class='x7'>" + " ".join(f"term{i}" for i in range(50)) + "</p>"
    page = lambda i: f"<body><div class='x1'>Top line</div><article class='post comments-open'><h1>Title {i}</h1>{notice}<p>He went to <span>Paris</span> in {i}</p>{'<p>Shared quote</p>' if i < 6 else ''}</article><div class='x9'>Foot</div></body>"
    rows = [(i, f"http://big/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://plain/{i}", f"<body class='has-sidebar'><main class='has-sidebar'><p>text {i} of {i}</p></main></body>") for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nHe went to Paris in 3\n\nShared quote" and got[30] == "Title 30\n\nHe went to Paris in 30"
    assert got[101] == "text 1 of 1"


def test_audio(spark):
    rng = np.random.default_rng(2)
    tune = np.concatenate([np.sin(2 * np.pi * f * np.arange(2048) / 8000) for f in rng.uniform(100, 900, 16)])
    pcm = lambda x: (12000 * x).astype("<i2").tobytes()
    noise = rng.normal(size=len(tune)) * 0.02
    rows = [(0, pcm(tune), 8000), (1, pcm(tune + noise), 8000), (2, pcm(np.roll(tune, 512 * 4) + noise), 8000), (3, pcm(rng.normal(size=len(tune))), 8000), (4, None, None), (5, b"ab", 8000), (6, pcm(tune), 8000)]
    prints = audio_match.fingerprints(spark.createDataFrame(rows, "id long, audio binary, rate int"))
    got = audio_match.match(prints, F.col("id") == 0).orderBy("rank").collect()
    assert got[0].class_id == 0 and got[0].copies == 2 and {r.class_id for r in got} >= {1, 2} and 3 not in {r.class_id for r in got}
    assert next(r.offset for r in got if r.class_id == 2) == 4


def test_melodies_sound_every_component(spark):
    rng = np.random.default_rng(4)
    a = [float(x) for x in rng.uniform(-1, 1, 64)]
    rows = [(0, a), (1, a[:32] + [float(x) for x in rng.uniform(-1, 1, 32)]), (2, [float(x) for x in rng.uniform(-1, 1, 32)] + a[32:])]
    audio = audio_match.melodies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {len(r.audio) for r in audio.collect()} == {64 * audio_match.NOTE * 2}
    prints = audio_match.fingerprints(audio)
    assert len({tuple(r.print) for r in prints.collect()}) == 3
    assert 2 in {r.class_id for r in audio_match.match(prints, F.col("id") == 0).collect()}  # alike in the second half only


def test_audio_equals_brute_force(spark, none):
    """All pairs, all offsets, whole overlaps and stretches between shared integers; what shares no integer is the only loss."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 32, n)
    base = draw(40)
    noisy = lambda x, share: x ^ np.array([int("".join(rng.choice(["0", "1"], 32, p=[1 - share, share])), 2) for _ in x])
    prints = [base, *(noisy(base, s) for s in (0.005, 0.01, 0.03, 0.1, 0.2, 0.3, 0.45)), np.concatenate([draw(9), base[5:35]]), np.concatenate([base[30:], draw(30)]), base[:5], base, draw(40), np.full(30, 7), np.full(50, 7), *(draw(40) for _ in range(20))]
    prints = [p.astype(np.int64) for p in prints]

    def sure(n, wrong):
        e = wrong / (32 * n)
        kl = lambda x, p: x * np.log(x / p) if x > 0 else 0.0
        return n * audio_match.INDEPENDENT * (kl(e, audio_match.CHANCE) + kl(1 - e, 1 - audio_match.CHANCE)) if e < audio_match.CHANCE else 0.0

    first = {tuple(p): i for i, p in reversed(list(enumerate(prints)))}
    want, unvoted = {}, 0
    for q in (0, 8, 13):
        for p, i in first.items():
            c, x = np.array(p), prints[q]
            if i == first[tuple(x)] and sum(tuple(y) == p for y in prints) == 1:
                continue
            for o in range(-len(x) + 1, len(c)):
                a, z = max(0, -o), min(len(x), len(c) - o)
                wrong = np.bitwise_count(x[a:z] ^ c[a + o : z + o])
                hit = np.flatnonzero(wrong == 0)
                for lo, hi in {(a, z), (a + hit[0], a + hit[-1] + 1)} if len(hit) else {(a, z)}:
                    n, w = hi - lo, int(wrong[lo - a : hi - a].sum())
                    if sure(n, w) >= -np.log(audio_match.ALARM) and w <= audio_match.BIT_ERRORS * 32 * n:
                        unvoted += not len(hit)
                        if len(hit):
                            want.setdefault((q, i), []).append((round(sure(n, w), 6), len(hit), o, n, w))
    rows = [(i, p.tolist()) for i, p in enumerate(prints)] + [(90, []), (91, None), (None, base.tolist())]
    got = audio_match.match(spark.createDataFrame(rows, "id long, print array<long>"), F.col("id").isin(0, 8, 13)).collect()
    assert {(r.query_id, r.class_id) for r in got} == set(want) and {(0, 0), (0, 1), (0, 4), (0, 8), (8, 0), (13, 14)} <= set(want) and unvoted <= 2
    for r in got:
        assert (r.votes, r.offset, r.positions, r.wrong_bits) in [x[1:] for x in want[r.query_id, r.class_id] if x[0] == max(want[r.query_id, r.class_id])[0]]
    assert audio_match.match(spark.createDataFrame([], "id long, print array<long>"), F.col("id") == 0).count() == 0


def test_pipeline_stages(spark, edge, none):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "language", "near_duplicates", "source_mix", "packing"]
    names = ["lang_pred", "toxicity", "__rate", "__key", "__order", "row", "x", "features", "p", "digest", "none", "a.b"]
    documents = edge.select("doc_id", "text", "lang", "source", "n_chars", "id", "score", *[F.lit(7).alias(n) for n in names])
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0), documents):
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert name in ("packing", "source_mix") or out.columns == docs.columns
            assert name != "source_mix" or set(out.columns) == set(docs.columns)
            if name == "near_duplicates" and rows:
                assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 6]
    text = " ".join(f"w{i}" for i in range(60))
    copies = spark.createDataFrame([(7, text), (None, text), (None, text.upper()), (None, "other text of few words"), (None, "other text of few words"), (-1, "a b c d e f"), (8, ""), (8, ""), (9, None)], "doc_id long, text string")
    kept = p.drop_near_duplicates(spark, copies, SF).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept) == [(-1, "a b c"), (0, "other"), (7, "w0 w1"), (8, ""), (9, "")]
    assert p.run(spark, SF).count() > 0
