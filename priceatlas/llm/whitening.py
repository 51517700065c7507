"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become integers, so their number, sums and squared deviations are exact. Of the centred matrix X, v_1, u_1, v_2, u_2, ... come from
alternating products Xv and Xᵀu, each a pass over all rows, until X V = U B with an upper bidiagonal B as wide as the vectors. The driver
holds V and B, whose size is the dimension's; a u is as long as the table and is never stored, for u_j = X w_j with the w_j known: a task
makes its part of all u from its rows. Every new u and v is made orthogonal to all the earlier ones, twice. The singular vectors of the small
B turn V into the components; where a step ends in zero (rank, equal eigenvalues), the next v begins anew, orthogonal to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceatlas.llm.common import materialize

#: Entries of a block of rows.
BLOCK_ENTRIES = 1 << 18
#: Singular values below this share of the largest one count as zero.
RANK = 1e-11


def whole_vectors(vectors: DataFrame, scale: float, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v array<long> = floor(scale * c) + shift, of vectors without null or non-finite entries."""
    c = F.col(f"`{vec_col}`")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(c, lambda e: F.floor(e.cast("double") * scale) + F.lit(shift).cast("long"))
    return vectors.where(c.isNotNull() & fine).select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return pc.list_flatten(b.column("v")).to_numpy().reshape(b.num_rows, dim)


def _block_task(dim: int):
    """Blocks of rows as bytes: later passes hand them to tasks without a step for each entry."""
    most = max(1, BLOCK_ENTRIES // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b, dim)
            yield pa.RecordBatch.from_pydict({"m": pa.array([m[i : i + most].tobytes() for i in range(0, len(m), most)], pa.binary())})

    return run


class Rows:
    """All rows, in blocks, and sums over them: each total() is one pass."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.sums, self.dim = blocks, n, sums, len(sums)

    def total(self, f) -> np.ndarray:
        """Sum of f(centred block), a vector as long for each block, over all blocks: by task, then by place."""
        dim, centre = self.dim, centred(self.n, self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for b in batches:
                for raw in b.column("m"):
                    part = f(centre(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim)))
                    found = part if found is None else found + part
            if found is not None:
                yield pa.RecordBatch.from_pydict({"place": np.arange(len(found)), "x": found})

        rows = self.blocks.mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
        return np.array([r.x for r in sorted(rows)])


def centred(n: int, sums: list[int]):
    """Function from whole numbers x to x - sum / n; n * x - sum is exact first."""
    s = np.array(sums, object)
    wide = any(abs(int(v)) > 2**62 for v in s)

    def run(x: np.ndarray) -> np.ndarray:
        if wide or np.abs(x).max(initial=0) > 2**62 // n:
            return np.array(x.astype(object) * n - s, float) / n
        return (x * n - s.astype(np.int64)) / n

    return run


def bidiagonalise(rows: Rows, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): X V = U B, V square and orthogonal, B upper bidiagonal, for the centred rows X."""
    d = rows.dim
    rng = np.random.default_rng(seed)
    v, w, back, b = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, d))
    now, scale = None, 0.0
    for j in range(d):
        if now is None:  # the first vector, or one after a zero
            now = rng.normal(size=d)
        for _ in range(2):
            now = now - v @ (v.T @ now)
        now = now / np.linalg.norm(now)
        v = np.column_stack([v, now])
        direction, known = now, w
        first = rows.total(lambda x, a=direction, w=known: np.append((x @ w).T @ (y := x @ a), y @ y))
        h, size = first[:-1], np.sqrt(first[-1])
        scale = max(scale, size)
        direction = direction - known @ h
        second = rows.total(lambda x, a=direction, w=known: np.concatenate([(x @ w).T @ (y := x @ a), [y @ y], x.T @ y]))
        again, left, pull = second[: len(h)], second[len(h)], second[len(h) + 1 :]
        direction, pull = direction - known @ again, pull - back @ again
        alpha = np.sqrt(max(0.0, left - again @ again))
        if j:
            b[j - 1, j] = (h + again)[-1] if len(h) else 0.0
        if alpha <= RANK * scale or scale == 0:  # X v is zero or in the span of the earlier u
            w, back = np.column_stack([w, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
            now = None
            continue
        b[j, j] = alpha
        w, back = np.column_stack([w, direction / alpha]), np.column_stack([back, pull / alpha])
        now = back[:, -1] - alpha * v[:, -1]
        for _ in range(2):
            now = now - v @ (v.T @ now)
        if np.linalg.norm(now) <= RANK * scale:
            now = None
    return v, b


def _project_task(n: int, sums: list[int], components: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, centre = len(sums), centred(n, sums)
        for b in batches:
            x = _matrix(b, dim)
            z = centre(x) @ components
            far = float(max(map(abs, sums), default=0)) + float(n) * float(np.abs(x).max(initial=0))
            if dim * far * far < 2.0**62:
                gap = x * n - np.array(sums, np.int64)
                deviation = (gap * gap).sum(1).tolist()
            else:
                gap = x.astype(object) * n - np.array(sums, object)
                deviation = (gap * gap).sum(1).tolist()
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]), np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(id_type), pa.array(deviation, pa.int64()), values], names=["vec_id", "deviation", "z"])

    return run


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each vector on the first components of all vectors' covariance.

    Vectors that are null or hold null or non-finite entries are left out, empty ones too; so are those of another length than most (of
    several such lengths, the largest stays). Repeated rows count as often as they come; null ids stay null. Components whose eigenvalue is
    zero within rounding cannot be whitened and are left out: equal vectors, a single one or an empty table give no rows. Equal eigenvalues
    have some orthogonal vectors of their space, the same for all rows. A deviation beyond the range of long is an error. Other columns,
    whatever their names, are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = whole_vectors(vectors, scale, shift, id_col, vec_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    sizes = whole.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["count"]
    whole = materialize(whole.where(F.size("v") == dim), "whole-vectors")
    entries = whole.select(F.posexplode("v").alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in sorted(entries.collect())]
    rows = Rows(materialize(whole.select("v").mapInArrow(_block_task(dim), "m binary"), "vector-blocks"), n, sums)
    v, b = bidiagonalise(rows)
    _, sigma, qt = np.linalg.svd(b)
    trace = float((sigma**2).sum()) / n
    rank = int((sigma > RANK * sigma[0]).sum()) if sigma[0] > 0 else 0
    k = min(components, rank)
    if k == 0:
        return spark.createDataFrame([], schema)
    e = sigma[:k] ** 2 / n
    to = (v @ qt[:k].T) / np.sqrt(e)
    mean = rows.total(lambda x: (x @ to).sum(0)) / n
    spread = rows.total(lambda x: ((z := x @ to - mean).T @ z).ravel()) / n
    error = float(np.abs(spread.reshape(k, k) - np.eye(k)).max())
    found = whole.mapInArrow(_project_task(n, sums, to, pa.int64()), "vec_id long, deviation long, z array<double>")
    shares = F.array(*[F.lit(float(x / trace)) for x in e])
    each = found.select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
