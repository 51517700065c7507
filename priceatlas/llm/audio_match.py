"""Chroma audio fingerprints and their alignment.

A recording's short-time spectra are folded into twelve pitch classes; filters over an integral image of those frames give sixteen
2-bit values, packed (Gray code) into one integer per position. Recordings with the same integers form one class. A query meets the
classes that share an integer with it; the offsets of shared integers form a histogram. At each of its offsets bit errors decide: they
must be so few over so many positions that chance can't have brought them about.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceatlas.llm.common import materialize

WINDOW, HOP = 2048, 512
#: Frames that a filter set spans.
SPAN = 8
#: Filters (kind, first pitch class, height, width): kind 0 compares left and right half, 1 lower and upper half, 2 the middle third of the pitch classes and the rest.
FILTERS = [(k, y, h, w) for k, y, h, w in zip([0, 1, 2, 0] * 4, [0, 4, 8, 2, 6, 1, 5, 9, 3, 7, 0, 2, 4, 6, 8, 0], [3, 4, 3, 6, 6, 8, 6, 3, 4, 4, 12, 6, 6, 6, 3, 12], [8, 4, 8, 4, 8, 8, 4, 8, 6, 8, 8, 4, 8, 6, 4, 4], strict=True)]
STEPS = (-0.25, 0.0, 0.25)
#: Largest share of wrong bits of a match.
BIT_ERRORS = 0.25
#: Share of bits in which unrelated recordings differ, and bits of a position that are independent of all others: over random pairs of the
#: given vectors 0.428 and 8 to 9 (by the variance at 14, 27 and 54 positions), here with a margin.
CHANCE, INDEPENDENT = 0.42, 6
#: Chance with which one compared span may be a false match: one in 10^18, for 10^9 queries on 10^9 recordings.
ALARM = 1e-18
#: Positions with one value that a task meets at once.
HOT_POSTS = 20_000


def chroma(pcm: np.ndarray, rate: int) -> np.ndarray:
    """frames x 12: energy by pitch class between 28 Hz and 3520 Hz, each frame scaled to length 1."""
    n = 1 + (len(pcm) - WINDOW) // HOP if len(pcm) >= WINDOW else 0
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, WINDOW)[::HOP][:n] * np.hanning(WINDOW)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    good = (hz >= 28) & (hz <= 3520)
    pitch = np.round(12 * np.log2(hz[good] / 440.0)).astype(int) % 12
    fold = np.zeros((good.sum(), 12))
    fold[np.arange(len(pitch)), pitch] = 1
    c = power[:, good] @ fold
    return c / np.maximum(np.sqrt((c**2).sum(1, keepdims=True)), 1e-12)


def fingerprint(pcm: np.ndarray, rate: int) -> np.ndarray:
    """One unsigned 32-bit integer per position; none for recordings shorter than a filter set."""
    c = chroma(pcm, rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    x = np.arange(n)

    def area(a, b, y, z):
        return image[x + b, z] - image[x + a, z] - image[x + b, y] + image[x + a, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        z = min(12, y + h)
        if kind == 0:
            p, q = area(0, w // 2, y, z), area(w // 2, w, y, z)
        elif kind == 1:
            mid = (y + z) // 2
            p, q = area(0, w, y, mid), area(0, w, mid, z)
        else:
            third = (z - y) // 3
            p = area(0, w, y + third, z - third)
            q = area(0, w, y, z) - p
        step = np.searchsorted(STEPS, np.log1p(p) - np.log1p(q))
        out = (out << np.uint32(2)) | (step ^ (step >> 1)).astype(np.uint32)
    return out


def _fingerprint_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = []
        for raw, rate in zip(b.column("audio").to_pylist(), b.column("rate").to_pylist(), strict=True):
            pcm = np.frombuffer((raw or b"")[: len(raw or b"") // 2 * 2], "<i2").astype(float) / 32768
            prints.append(fingerprint(pcm, rate or 8000).astype(np.int64).tolist())
        yield pa.RecordBatch.from_pydict({"id": b.column("id"), "print": pa.array(prints, pa.list_(pa.int64()))})


def fingerprints(recordings: DataFrame, id_col: str = "id", audio_col: str = "audio", rate_col: str = "rate") -> DataFrame:
    """id, print array<long>: 16-bit little-endian mono samples to packed integers. Null or short audio: an empty array; a null rate: 8000."""
    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio"), F.col(rate_col).cast("int").alias("rate"))
    return rows.mapInArrow(_fingerprint_task, "id long, print array<long>")


def significance(n: Column, wrong_bits: Column) -> Column:
    """Chernoff bound, as -ln of the chance that unrelated recordings agree as well over n positions; 0 if they agree no better than by chance."""
    e = wrong_bits / (n * 32)
    term = lambda x, p: F.when(x > 0, x * F.log(x / p)).otherwise(0.0)
    return F.when(e < CHANCE, n * INDEPENDENT * (term(e, CHANCE) + term(1 - e, 1 - CHANCE))).otherwise(0.0)


def match(prints: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, class_id, copies, offset, start, positions, votes, wrong_bits: for each query (over id), every aligned class of other recordings.

    A class is named by its smallest id and has copies recordings; a query's own class shows if it has another member. All offsets in a
    class's histogram are tested, each over the whole overlap and over the stretch from the first to the last shared integer (start, in
    the query, and positions); one aligns if its bit errors are few (BIT_ERRORS) and not chance (ALARM). The most significant is given.
    Rank: most significant, then smaller class_id. Null ids and empty prints take no part; repeated rows count as copies.
    """
    prints = materialize(prints.where("id is not null and size(print) > 0"), "prints")
    classes = materialize(prints.groupBy("print").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "print-classes")
    asked = prints.where(is_query).select(F.col("id").alias("query_id"), "print").distinct()
    posts = classes.select("class_id", F.size("print").alias("c_n"), F.posexplode("print").alias("at", "value"))
    wanted = asked.select("query_id", F.size("print").alias("q_n"), F.posexplode("print").alias("q_at", "value"))
    # a value that very many positions hold (silence, a held note) is met in parts
    hot = materialize(posts.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / HOT_POSTS).alias("parts")).where("parts > 1"), "hot-values")
    posts = posts.join(hot, "value", "left").withColumn("part", F.pmod(F.xxhash64("class_id", "at"), F.coalesce("parts", F.lit(1)))).drop("parts")
    wanted = wanted.join(hot, "value", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    offset = (F.col("at") - F.col("q_at")).alias("offset")
    votes = posts.join(wanted, ["value", "part"]).groupBy("query_id", "class_id", "q_n", "c_n", offset)
    votes = votes.agg(F.count(F.lit(1)).alias("votes"), F.min("q_at").alias("first"), (F.max("q_at") + 1).alias("last"))
    begin, end = F.greatest(F.lit(0), -F.col("offset")), F.least(F.col("q_n"), F.col("c_n") - F.col("offset"))
    spans = F.array(F.struct(begin.alias("start"), end.alias("stop")), F.struct(F.col("first").alias("start"), F.col("last").alias("stop")))
    # a span without a wrong bit must reach ALARM, or no span of its length can
    tried = votes.select("query_id", "class_id", "votes", "offset", F.explode(F.array_distinct(spans)).alias("s")).select("*", "s.start", (F.col("s.stop") - F.col("s.start")).alias("positions")).drop("s")
    tried = tried.where(significance(F.col("positions"), F.lit(0.0)) >= -math.log(ALARM))
    tried = tried.groupBy("query_id", "class_id").agg(F.collect_list(F.struct("offset", "votes", "start", "positions")).alias("tried"))  # at most two per position of the two
    both = tried.join(asked.withColumnRenamed("print", "q"), "query_id").join(classes.withColumnRenamed("print", "c"), "class_id")
    both = both.where((F.col("copies") > 1) | (F.col("class_id") != F.col("query_id")))
    both = both.select("query_id", "class_id", "copies", "q", "c", F.explode("tried").alias("o")).select("query_id", "class_id", "copies", "q", "c", "o.*")
    pairs = F.arrays_zip(F.slice("q", F.col("start") + 1, F.col("positions")).alias("x"), F.slice("c", F.col("start") + F.col("offset") + 1, F.col("positions")).alias("y"))
    both = both.withColumn("wrong_bits", F.aggregate(pairs, F.lit(0), lambda a, p: a + F.bit_count(p.x.bitwiseXOR(p.y)))).withColumn("sure", significance(F.col("positions"), F.col("wrong_bits")))
    good = both.where((F.col("sure") >= -math.log(ALARM)) & (F.col("wrong_bits") <= BIT_ERRORS * 32 * F.col("positions")))
    best = F.max(F.struct("sure", "votes", -F.abs("offset"), "offset", "start", "positions", "wrong_bits")).alias("b")
    found = good.groupBy("query_id", "class_id", "copies").agg(best).select("query_id", "class_id", "copies", "b.*")
    w = Window.partitionBy("query_id").orderBy(F.desc("sure"), "class_id")
    return found.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "class_id", "copies", "offset", "start", "positions", "votes", "wrong_bits")


#: Melodies of vectors: notes of NOTE samples at RATE.
RATE, NOTE = 4096, 512


def _melody_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    time = np.arange(NOTE) / RATE
    tones = np.round(12_000 * np.sin(2 * np.pi * 110 * 2 ** (np.arange(36)[:, None] / 12) * time)).astype("<i2")
    for b in batches:
        vectors = b.column("v").to_pylist()
        for at in range(0, len(vectors), 64):
            audio = []
            for v in vectors[at : at + 64]:
                x = np.nan_to_num(np.array([c or 0.0 for c in v or []], float), posinf=0, neginf=0)
                audio.append(tones[np.floor(np.clip(x, -1, 1) * 60).astype(int) % 36].tobytes())
            yield pa.RecordBatch.from_pydict({"id": b.column("id").slice(at, 64), "audio": pa.array(audio, pa.binary()), "rate": pa.array([RATE] * len(audio), pa.int32())})


def melodies(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, audio, rate: a recording per vector, one note per component; stands in for a table of media, which the test data lack."""
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(_melody_task, "id long, audio binary, rate int")
