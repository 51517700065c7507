"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. For each language, piece probabilities are fitted by expectation maximisation over word
counts; the likelihood of a word sums, by the forward algorithm, over all its segmentations into pieces. A text's score for a
language is the sum over its words. Words are scored in columns: all unseen words of one length go through the trie together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from priceatlas.llm.common import materialize, packed, slices, texts_of

#: Documents of a language that its probabilities are fitted on, at most on average; chosen by a hash of id and text, so that copies of one text are not all taken.
TRAIN_DOCS = 2_000
EM_ROUNDS = 2
#: Added to each expected piece count.
SMOOTHING = 0.02
#: Words beyond this many letters are scored in parts of this length.
LONGEST = 32
UNKNOWN = 1e-7
#: A text's evidence counts as that of this many words at most in the reported score, which would else always be 0 or 1.
EVIDENCE = 16
#: Words whose scores a task remembers; it begins anew beyond.
CACHE_WORDS = 150_000
_WORDS = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """The vocabulary's pieces of letters, lower-cased, with a leading mark at word starts; transitions as sorted (node, letter) keys."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
        self.pieces = sorted(p for p in pieces if (q := p.removeprefix("▁")) and q.isalpha() or p == "▁")
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for n, p in enumerate(self.pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, int(self.letter[ord(c)])), len(nodes) + 1)
            ends[at] = n
        keys = np.array([a * self.width + c for a, c in nodes], np.int64)
        to = np.array(list(nodes.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Trie:
        return Trie(path)

    def arcs(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces found in words, a matrix of code points of one length; piece -1: an unknown letter."""
        codes = self.letter[words]
        found, length = [], words.shape[1]
        for s in range(length):
            rows, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            single = np.zeros(len(words), bool)
            for e in range(s, length):
                key = node * self.width + codes[rows, e]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (codes[rows, e] > 0)
                rows, node = rows[hit], self.to[at[hit]]
                if not len(rows):
                    break
                p = self.piece[node]
                if (full := p >= 0).any():
                    found.append((s, e + 1, rows[full], p[full]))
                    if e == s:
                        single[rows[full]] = True
            if not single.all():
                lost = np.flatnonzero(~single)
                found.append((s, s + 1, lost, np.full(len(lost), -1)))
        return found

    def forward(self, arcs: list, n: int, length: int, probs: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]; probs has a last row for unknown letters."""
        alpha = np.zeros((length + 1, n, probs.shape[1]))
        alpha[0] = 1
        for s, e, rows, p in arcs:
            alpha[e, rows] += alpha[s, rows] * probs[p]
        return alpha

    def expected(self, arcs: list, n: int, length: int, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected pieces of words that come counts[word, language] times."""
        alpha = self.forward(arcs, n, length, probs)
        beta = np.zeros_like(alpha)
        beta[length] = 1
        for s, e, rows, p in reversed(arcs):
            beta[s, rows] += beta[e, rows] * probs[p]
        out, scale = np.zeros_like(probs), counts / np.maximum(alpha[length], 1e-300)
        for s, e, rows, p in arcs:
            np.add.at(out, p, alpha[s, rows] * probs[p] * beta[e, rows] * scale[rows])
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in words, matrix of code points with the leading mark) of the words of each length, in bounded blocks."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for some in np.array_split(at, -(-len(at) // 8192)):
            m = np.array([words[i] for i in some], f"U{n}").view(np.uint32).reshape(len(some), n)
            yield some, np.hstack([np.full((len(some), 1), 0x2581, np.uint32), m])


def words_of(text: str) -> list[str]:
    out = []
    for w in _WORDS.findall(text.lower()):
        if not w.isalpha():
            w = "".join(filter(str.isalpha, w))
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return [w for w in out if w]


def _expect_task(langs: list[str], probs: np.ndarray, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total, place = Trie.of(path), np.zeros_like(probs), {x: i for i, x in enumerate(langs)}
        for b in batches:
            words, lang, n = b.column("word").to_pylist(), b.column("lang").to_pylist(), b.column("n").to_pylist()
            counts = np.zeros((len(words), len(langs)))
            counts[np.arange(len(words)), [place[x] for x in lang]] = n
            for at, m in by_length(words):
                total += trie.expected(trie.arcs(m), len(m), m.shape[1], probs, counts[at])
        p, x = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({"piece": pa.array(p, pa.int32()), "lang": pa.array(x, pa.int32()), "n": pa.array(total[p, x], pa.float64())})

    return run


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", vocabulary: str | None = None, id_col: str = "doc_id") -> tuple[list[str], np.ndarray, str]:
    """(languages, probabilities[piece or unknown, language], vocabulary): fitted on at most TRAIN_DOCS documents of a language on average.

    What comes to the driver is one number per piece and language, bounded by the vocabulary, not by the corpus.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    trie = Trie.of(path)
    probs = np.full((len(trie.pieces) + 1, len(langs)), 1.0 / max(1, len(trie.pieces)))
    probs[-1] = UNKNOWN
    if not langs:
        return langs, probs, path
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, TRAIN_DOCS / sizes[k]))]), F.col("lang"))
    picked = rows.where(F.pmod(F.col("hash"), F.lit(1_000_003)) < share * 1_000_003)
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), F.lit(0)))  # long words in the parts that are scored
    words = picked.select("lang", found.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    words = materialize(words, "language-words")
    for _ in range(EM_ROUNDS):
        sums = words.mapInArrow(_expect_task(langs, probs, path), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(trie.pieces), len(langs)), SMOOTHING)
        counts[sums["piece"], sums["lang"]] += sums["n"]
        probs[:-1] = counts / counts.sum(0)
    return langs, probs, path


def _score_task(langs: list[str], probs: np.ndarray, path: str, place: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, seen, table, used = Trie.of(path), {}, np.zeros((CACHE_WORDS, len(langs))), 0
        for b in slices(batches):
            texts = texts_of(b, place)
            best, score = [], []
            for at in range(0, len(texts), 64):
                split = [words_of(t) if t else [] for t in texts[at : at + 64]]
                new = list({w for ws in split for w in ws}.difference(seen))
                if used + len(new) > len(table):
                    new = list({w for ws in split for w in ws})
                    seen, used = {}, 0
                    if len(new) > len(table):
                        table = np.zeros((len(new), len(langs)))
                for some, m in by_length(new) if langs else ():
                    alpha = trie.forward(trie.arcs(m), len(m), m.shape[1], probs)
                    table[used + some] = np.log(np.maximum(alpha[m.shape[1]], 1e-300))
                seen.update(zip(new, range(used, used + len(new)), strict=True))
                used += len(new)
                for ws in split:
                    if not ws or not langs:
                        best.append("und")
                        score.append(0.0)
                        continue
                    ll = table[[seen[w] for w in ws]].mean(0)
                    p = np.exp((ll - ll.max()) * min(len(ws), EVIDENCE))
                    best.append(langs[int(ll.argmax())])
                    score.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, str], keep: list[str], text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns keep of docs, lang_pred and score for every row. und with score 0: a null text, one without letters, or no language learned.

    into: names of the two; kept columns called like one of them are replaced.
    """
    langs, probs, path = model
    keep = [c for c in keep if c.lower() not in {n.lower() for n in into}]
    rows, place = packed(docs, keep, text_col)
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_score_task(langs, probs, path, place), schema).select("row.*", F.col("lang_pred").alias(into[0]), F.col("score").alias(into[1]))
