"""Near-duplicate classes by an LSH forest over MinHash signatures.

A document's set: its distinct shingles of `words` words. Documents with equal sets form one class. Each of TREES trees orders the
classes by its own permutation of the signature; classes that agree on a tree's first DEPTH values share a region of it. DEPTH is
fixed; a region of more than DENSE classes is sorted in parts. Sorted neighbours have the longest common prefixes of a region. First the sorted
neighbours of a few trees are candidates, then those of all trees that are still apart, which joins dense groups without their pairs. Classes of regions that still hold several
components stay open: of those, the ones of different components that share one of their rarest shingles (as many as the threshold lets
differ, plus one) are candidates, if estimate and set sizes allow the similarity; members of the largest component meet only the other
members. All links are confirmed on full sets. No region, partner or candidate count is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceatlas.llm.common import BROADCAST_ROWS, materialize, slices, small_batches

HASHES = 128
TREES = 32
DEPTH = 5
#: Classes of a region that are sorted in one task.
DENSE = 50_000
#: Values beyond DEPTH that order a region.
BEYOND = 8
#: Trees whose sorted neighbours are the first candidates.
FIRST_TREES = 3
#: Sorted neighbours on each side that are candidates in all trees, for classes not yet in one component.
NEIGHBOURS = 3
#: A pair is left out if its estimated similarity is this many standard errors below the threshold (1 in 3 million).
ERRORS = 5.0
#: Hash bins of the shingle counts that order shingles from rare to common: a table of fixed size.
BIN_BITS = 18
BINS = 1 << BIN_BITS
_MULTIPLY = np.random.default_rng(20_240_501).integers(1, 2**32, HASHES).astype(np.uint32) | np.uint32(1)
_ORDERS = np.stack([np.random.default_rng(900 + t).permutation(HASHES)[: DEPTH + BEYOND] for t in range(TREES)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes, and signatures of sets that come again, that a task remembers; it begins anew beyond.
CACHE_WORDS, CACHE_SETS = 150_000, 10_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles. Words: runs without ASCII white space, A-Z in lower case; fewer words than a shingle: all as one."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _STEP + h[i : len(h) - k + 1 + i]
        s = (s ^ (s >> np.uint64(29))) * _STEP
        return np.unique(s ^ (s >> np.uint64(32)))


def signature(s: np.ndarray) -> np.ndarray:
    hi, lo = (s >> np.uint64(32)).astype(np.uint32), s.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 512):  # small blocks stay in the cache
        out = np.minimum(out, (hi[at : at + 512] * _MULTIPLY[:, None] + lo[at : at + 512]).min(1))
    return out


def _sketch_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, known = Shingler(words), {}
        for b in slices(batches):
            n, key, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle(t)
                n.append(len(s))
                k = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if k is not None and k not in known:
                    if len(known) > CACHE_SETS:
                        known.clear()
                    known[k] = signature(s).tobytes()
                key.append(k)
                sig.append(known.get(k))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "digest": b.column("digest"), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "sig": pa.array(sig, pa.binary())})

    return run


def _forest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cid, size = np.array(b.column("cid")), np.array(b.column("n"))
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(cid), HASHES)
        for t, order in enumerate(_ORDERS):
            m = sig[:, order].astype(np.uint64)
            region = np.full(len(cid), t + 1, np.uint64)
            for d in range(DEPTH):
                region = (region ^ (region >> np.uint64(31))) * _STEP + m[:, d]
            raw = m[:, DEPTH:].astype(">u2").tobytes()
            w = 2 * BEYOND
            rest = [raw[i : i + w] for i in range(0, len(raw), w)]
            yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(cid), t, np.int32)), "region": pa.array(region.astype(np.int64)), "cid": pa.array(cid), "n": pa.array(size), "rest": pa.array(rest, pa.binary())})


def _estimate_task(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            good = np.flatnonzero((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_pydict({c: b.column(c).take(pa.array(good)) for c in ("a", "b")})

    return run


def _confirm_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b.column("set_a"), b.column("set_b"), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(s, t, assume_unique=True).size
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({c: b.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")})

    return run


def _set_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in slices(batches):
            sets = [shingle(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"cid": b.column("cid"), "set": pa.array(sets, pa.binary())})

    return run


def _bin_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS, np.int64)
    for b in batches:
        for x in b.column("set"):
            total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bin": pa.array(at, pa.int32()), "n": pa.array(total[at])})


def _rare_task(bins: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shingle, row, size, place = [], [], [], []
            for i, x in enumerate(b.column("set")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, bins[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)]))[:n]
                shingle.append(s[order].view(np.int64))
                row += [i] * n
                size += [len(s)] * n
                place += range(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(shingle) if shingle else np.empty(0, np.int64)), "cid": b.column("cid").take(at), "f": b.column("f").take(at), "n": pa.array(size, pa.int64()), "at": pa.array(place, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """v, f: every end of links (a, b) and the smallest reachable end. Minimum labels with hooking and shortcuts (FastSV), a written table per round."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    label = materialize(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("f")), "component")
    while True:
        near = both.join(label, "v").groupBy("u").agg(F.min("f").alias("m")).withColumnRenamed("u", "v")
        own = label.join(near, "v")
        hooks = own.groupBy(F.col("f").alias("v")).agg(F.min("m").alias("h"))
        hooked = own.join(hooks, "v", "left").select("v", F.col("f").alias("was"), F.least("f", "m", "h").alias("f"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("v").alias("f"), F.col("f").alias("g"))
        label = materialize(hooked.join(up, "f").select("v", "was", F.least("f", "g").alias("f")), "component")
        if not label.where("f <> was").take(1):
            return label.select("v", "f")
        label = label.select("v", "f")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, digest, set_key: one row per row of docs.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; component_id is the smallest id reachable,
    kept marks the row that has it. A null text, or one without words, has an empty set, is linked with nothing and kept. Rows with the
    same id are rows of their own (all of them kept, if theirs is the smallest id); a null id is never the smallest while its component has another,
    and is kept only if it has none. digest: xxhash64 of the text; set_key: equal for equal sets, null for an empty one. An empty table gives no rows. A link right at the threshold is missed with a
    chance of about 1 in 100,000; more similar ones practically never.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    sketches = materialize(small_batches(plain).mapInArrow(_sketch_task(words), "id long, digest long, n long, key binary, sig binary"), "sketches")
    classes = sketches.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    classes = classes.select("key", F.col("first.id").alias("rep"), F.col("first.digest").alias("digest"), "n", "sig")
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # a dense region is sorted in parts, other ones in each tree, so that its classes meet across the parts of the others
    forest = classes.select("cid", "n", "sig").mapInArrow(_forest_task, "tree int, region long, cid long, n long, rest binary")
    part = F.lit(0).cast("long")
    if classes.count() > DENSE:
        dense = forest.groupBy("tree", "region").agg(F.ceil(F.count(F.lit(1)) / DENSE).alias("parts")).where("parts > 1")
        dense = materialize(dense, "dense-regions")
        forest = forest.join(F.broadcast(dense) if dense.count() <= BROADCAST_ROWS else dense, ["tree", "region"], "left")
        part = F.pmod(F.xxhash64("cid", "tree"), F.coalesce("parts", F.lit(1)))
    ordered = Window.partitionBy("tree", "region", "part").orderBy("rest", "cid")
    forest = forest.select("tree", "region", "cid", "n", "rest", part.alias("part"))
    mark = F.struct("cid", "n")
    forest = forest.withColumns({"after": F.lead("cid").over(ordered)} | {f"before{k}": F.lag(mark, k).over(ordered) for k in range(1, NEIGHBOURS + 1)})
    shared = materialize(forest.where("before1 is not null or after is not null").drop("after", "rest", "part"), "regions")

    ids = shared.select("cid").distinct()
    wanted = classes.join(ids, "cid", "left_semi").select("cid", F.coalesce("rep", F.lit(-(2**62))).alias("id"), "digest")
    texts = plain.withColumn("id", F.coalesce("id", F.lit(-(2**62)))).join(wanted, ["id", "digest"]).select("cid", "text")
    sets = materialize(texts.mapInArrow(_set_task(words), "cid long, set binary").dropDuplicates(["cid"]), "sets")

    def possible(a, b):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("cid").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_confirm_task(percent), "a long, b long")

    def neighbours(rows: DataFrame, most: int) -> DataFrame:
        near = F.explode(F.array(*[f"before{k}" for k in range(1, most + 1)]))
        found = rows.select("cid", "n", near.alias("o")).where(F.col("o").isNotNull() & possible(F.col("n"), F.col("o.n")))
        return found.select(F.least("cid", "o.cid").alias("a"), F.greatest("cid", "o.cid").alias("b")).distinct()

    share = percent / 100
    least = share - ERRORS * (share * (1 - share) / HASHES) ** 0.5
    sig_a, sig_b = (classes.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))

    def likely(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.join(sig_a, "a").join(sig_b, "b").mapInArrow(_estimate_task(least), "a long, b long"), "likely")

    links = materialize(confirmed(neighbours(shared.where(F.col("tree") < FIRST_TREES), 1)), "links")
    joined = components(links)
    apart = neighbours(shared, NEIGHBOURS)
    for c in ("a", "b"):
        apart = apart.join(joined.select(F.col("v").alias(c), F.col("f").alias(f"f_{c}")), c, "left")
    apart = apart.where(F.coalesce("f_a", "a") != F.coalesce("f_b", "b")).select("a", "b")
    links = materialize(links.unionByName(confirmed(likely(apart))), "links")
    joined = components(links)

    # classes of regions that hold more than one component; among them, those that share one of their rarest shingles
    label = joined.select(F.col("v").alias("cid"), "f")
    placed = shared.join(label, "cid", "left").select("tree", "region", "cid", F.coalesce("f", "cid").alias("f"))
    mixed = placed.groupBy("tree", "region").agg((F.min("f") < F.max("f")).alias("mixed")).where("mixed").select("tree", "region")
    unsettled = placed.join(mixed, ["tree", "region"], "left_semi").select("cid", "f").distinct()
    unsettled = materialize(sets.join(unsettled, "cid"), "unsettled")
    counted = unsettled.select("set").mapInArrow(_bin_task, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    bins = np.zeros(BINS, np.int64)
    bins[counted["bin"]] = counted["n"]
    rare = materialize(unsettled.mapInArrow(_rare_task(bins, percent), "shingle long, cid long, f long, n long, at long"), "rare-shingles")
    parts = rare.groupBy("shingle", "f").agg(F.count(F.lit(1)).alias("rows"))
    mixed = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("rows", "f")).alias("most")).where("parts > 1").select("shingle", F.col("most.f").alias("most"))
    meeting = materialize(rare.join(mixed, "shingle"), "meeting")
    # sets that can be linked lie in the same or in neighbouring size classes
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).alias("step")
    meeting = meeting.withColumn("step", step)
    few = meeting.where("f <> most").select(F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("step"), "shingle", F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("f").alias("f2"), F.col("at").alias("at2"))
    # the first shared shingle of two sets has left all rarer ones unmatched: what is left must still suffice
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= percent * (F.col("n") + F.col("n2"))
    pairs = meeting.join(few, ["shingle", "step"]).where(enough & (F.col("f") != F.col("f2")) & ((F.col("f") == F.col("most")) | (F.col("cid") < F.col("c2"))) & possible(F.col("n"), F.col("n2")))
    pairs = materialize(pairs.select(F.least("cid", "c2").alias("a"), F.greatest("cid", "c2").alias("b")).distinct(), "pairs")
    more = materialize(confirmed(likely(pairs)), "links")
    joined = components(links.unionByName(more))

    roots = classes.join(joined.withColumnRenamed("v", "cid"), "cid", "left").select("key", "rep", F.coalesce("f", "cid").alias("f"))
    smallest = roots.groupBy("f").agg(F.min("rep").alias("component_id"))
    named = materialize(roots.join(smallest, "f").select("key", "component_id"), "components")
    out = sketches.select("id", "n", "key", "digest").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), "digest", F.col("key").alias("set_key"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
