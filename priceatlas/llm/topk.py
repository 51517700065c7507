"""Exact top-k inner products by norm-bucketed retrieval (LEMP: Teflioudi, Gemulla, Mykytiuk 2015).

Vectors are sorted by length and packed into blocks of similar length, queries into groups. First every group meets the blocks of the
longest vectors, which gives each query a threshold. A block then goes, by an explicit list of pairs, to the groups that its longest
vector can still serve, in falling length: the local cosine threshold is kth score / (query length * longest in block); above 1 the
block is skipped; from COORD_COS on, only vectors whose largest query coordinates lie in the feasible interval are kept (coordinate
pruning); else those long enough (length pruning). Every survivor's product is then computed exactly. A task holds one group and one
block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceatlas.llm.common import BROADCAST_ROWS, materialize

BLOCK_ROWS = 1024
QUERY_ROWS = 2048
#: Blocks of the longest vectors that give the first thresholds, and blocks that a group meets in one run of a task.
HEAD_BLOCKS, RUN_BLOCKS = 4, 64
COORD_COS = 0.9
FOCUS = 3


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """id, v array<long> = floor(scale * x), norm. Null ids, null vectors and vectors with a null or non-finite component are left out."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", F.sqrt(squares)).withColumn("dim", F.size("v"))


def _blocks(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, rows: list) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], np.int64)
            m = np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "top": [float(np.sqrt((m.astype(float) ** 2).sum(1).max()))], "ids": [ids.tobytes()], "m": [m.tobytes()]})

        for b in batches:
            for i, v, dim in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), b.column("dim").to_pylist(), strict=True):
                rows = held.setdefault(dim, [])
                rows.append((i, v))
                if len(rows) == size:
                    yield out(dim, held.pop(dim))
        for dim, rows in held.items():
            yield out(dim, rows)

    return pack


def _feasible(block: np.ndarray, norms: np.ndarray, q: np.ndarray, qn: float, t: float) -> np.ndarray:
    """Rows whose FOCUS largest query coordinates allow a cosine of t; a little slack covers rounding."""
    keep = np.ones(len(block), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        a = q[f] / qn
        width = np.sqrt(max(0.0, (1 - a * a) * (1 - t * t))) + 1e-6
        c = block[:, f] / np.maximum(norms, 1e-300)
        keep &= np.abs(c - a * t) <= width if abs(a) < t else (c * np.sign(a) >= abs(a) * t - width)
    return keep


class _Group:
    """A group of queries with the k best candidates of each so far; floor: scores that are known to be reached."""

    def __init__(self, k: int, dim: int, ids: bytes, m: bytes, floor: bytes | None):
        self.k, self.ids, self.q = k, np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(-1, dim)
        self.norms = np.sqrt((self.q.astype(float) ** 2).sum(1))
        self.floor = np.frombuffer(floor, float) if floor else np.full(len(self.ids), -np.inf)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def merge(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.best[n][0], scores]), np.concatenate([self.best[n][1], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.best[n] = (s[order], i[order])

    def reached(self) -> np.ndarray:
        return np.maximum(self.floor, np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.best], float))

    def need(self) -> float:
        """Shortest vector that can still serve one of the queries."""
        t = self.reached()
        lengths = np.where((t > 0) & (self.norms > 0), t / np.maximum(self.norms, 1e-300) * (1 - 1e-9) - 1e-6, 0.0)
        return float(lengths.min(initial=np.inf))

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        q, qn, qids = self.q, self.norms, self.ids
        norms = np.sqrt((c.astype(float) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        ids, c, norms = ids[order], c[order], norms[order]
        kth = self.reached()
        bound = qn * norms[0] * (1 + 1e-9) + 1e-6
        t = np.where(kth > 0, kth / np.maximum(bound, 1e-300), -1.0)
        active = kth <= bound
        exact = np.float64 if bound.max(initial=0) < 2**52 else np.int64
        coord = active & (t >= COORD_COS)
        for n in np.flatnonzero(coord):
            at = np.flatnonzero(_feasible(c, norms, q[n], qn[n], t[n]) & (ids != qids[n]))
            s = (c[at].astype(exact) @ q[n].astype(exact)).astype(np.int64)
            good = s >= kth[n]
            self.merge(n, s[good], ids[at][good])
        rest = np.flatnonzero(active & ~coord)
        for some in np.array_split(rest, -(-len(rest) // 256)) if len(rest) else ():
            least = np.where(kth[some] > 0, kth[some] / np.maximum(qn[some], 1e-300) * (1 - 1e-9) - 1e-6, 0.0).min()
            m = max(1, int(np.searchsorted(-norms, -least, side="right")))
            all_s = (q[some].astype(exact) @ c[:m].T.astype(exact)).astype(np.int64)
            for n, s in zip(some, all_s, strict=True):
                good = (s >= kth[n]) & (ids[:m] != qids[n])
                if good.sum() > 4 * self.k:
                    good &= s >= np.partition(s[good], -self.k)[-self.k]
                if good.any():
                    self.merge(n, s[good], ids[:m][good])


def _runs(k: int, done):
    """A run is a group's row (kind 0) and, behind it, its blocks; done makes a record batch of the group met by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, g = None, None
        for b in batches:
            for at in range(b.num_rows):
                r = {c: b.column(c)[at].as_py() for c in ("kind", "g", "dim", "ids", "m", "floor")}
                if r["kind"] == 0:
                    if group is not None:
                        yield done(g, group)
                    group, g = _Group(k, r["dim"], r["ids"], r["m"], r["floor"]), r["g"]
                else:
                    group.meet(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["m"], np.int64).reshape(-1, r["dim"]))
        if group is not None:
            yield done(g, group)

    return run


def _threshold(g: int, group: _Group) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int64()), "need": [group.need()], "floor": [group.reached().tobytes()]})


def _answers(g: int, group: _Group) -> pa.RecordBatch:
    n = [len(s) for s, _ in group.best]
    columns = {"query_id": np.repeat(group.ids, n), **{c: np.concatenate([x[i] for x in group.best]) for c, i in (("vec_id", 1), ("score", 0))}}
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})


def _in_runs(groups: DataFrame, met: DataFrame) -> DataFrame:
    """Each group's row with the blocks met behind it in falling length; a run has RUN_BLOCKS blocks on average."""
    columns = ["kind", "g", "run", "dim", "top", "ids", "m", "floor"]
    rows = groups.withColumn("kind", F.lit(0)).select(*columns).unionByName(met.withColumns({"kind": F.lit(1), "floor": F.lit(None).cast("binary")}).select(*columns))
    return rows.repartition("g", "run").sortWithinPartitions("g", "run", "kind", F.desc("top"))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for every row with is_query (over `id`), the k highest integer inner products among rows of other ids.

    Ties go to the smaller vec_id. Vectors of other dimensions do not meet. Left out: null ids, null vectors and vectors with a null or
    non-finite component. Repeated candidates take a rank each; repeated queries are asked once, and an id with several vectors asks
    with each and gets the k best of all. An empty table gives no rows.
    """
    q = materialize(quantize(vectors, id_col, vec_col, scale), "vectors")
    order = ("dim", F.col("norm").desc(), F.xxhash64("id"))
    kinds = "dim int, top double, ids binary, m binary"
    dealt = q.repartitionByRange(max(1, -(-q.count() // (8 * BLOCK_ROWS))), *order).sortWithinPartitions(*order)
    blocks = materialize(dealt.mapInArrow(_blocks(BLOCK_ROWS), kinds).withColumn("b", F.monotonically_increasing_id()), "vector-blocks")
    asked = q.where(is_query).select("id", "v", "norm", "dim").distinct()
    asked = asked.repartitionByRange(max(1, -(-asked.count() // (2 * QUERY_ROWS))), *order).sortWithinPartitions(*order)
    groups = materialize(asked.mapInArrow(_blocks(QUERY_ROWS), kinds).withColumn("g", F.monotonically_increasing_id()), "query-groups")

    longest = blocks.select("b", "dim", "top").withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("top"), "b"))).where(F.col("n") <= HEAD_BLOCKS)
    head = blocks.join(longest.select("b"), "b", "left_semi").join(groups.select("g", "dim"), "dim")
    single = lambda rows: rows.withColumns({"run": F.lit(0).cast("long"), "floor": F.lit(None).cast("binary")})
    first = _in_runs(single(groups), single(head)).mapInArrow(_runs(k, _threshold), "g long, need double, floor binary")
    groups = materialize(groups.join(first, "g"), "query-thresholds")

    runs = max(1, -(-blocks.count() // RUN_BLOCKS))
    wanted = groups.select("g", F.col("dim").alias("q_dim"), "need")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    met = blocks.join(wanted, (F.col("dim") == F.col("q_dim")) & (F.col("top") >= F.col("need"))).withColumn("run", F.pmod("b", F.lit(runs)))
    spread = groups.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    found = _in_runs(spread, met).mapInArrow(_runs(k, _answers), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
