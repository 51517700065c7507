"""Shared helpers: tables in the shared folder, and numbering rows without a single-task window."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.running import running_start

#: Rows that one numbering window holds on average.
ROWS_PER_BUCKET = 4096
#: Rows that a worker turns into Python objects at once.
TASK_ROWS = 256
#: Bytes of an Arrow batch between Spark and a worker (one longer row: as many as it has).
BATCH_BYTES = 4 << 20
#: Largest table, in rows, that is broadcast after it was counted.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset in local mode, a new one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs survive lost executors and skip the work before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores behind it as keep it apart from columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int | None]:
    """Columns keep of docs as one struct `row`, whose names cannot clash with a step's own, and the text: its place in the row, or None: a column `text` beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    docs = small_batches(docs)
    if text_col in keep:
        return docs.select(row), keep.index(text_col)
    return docs.select(row, F.col(text_col).alias("text")), None


def texts_of(batch: pa.RecordBatch, place: int | None) -> list[str | None]:
    return (batch.column("text") if place is None else batch.column("row").field(place)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of TASK_ROWS rows: a worker holds few texts, and what it makes of them, as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, TASK_ROWS):
            yield b.slice(at, TASK_ROWS)
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on into the next operators' tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches at most BATCH_BYTES long: texts are as long as they like, a worker's memory is not."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def number_rows(df: DataFrame, keys: list[str], rid: str, buckets: int, into: str) -> DataFrame:
    """Gapless numbers from 0 within keys, in the order of (bucket of rid and into, rid); rid is unique. Hot keys spread over the buckets."""
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(rid, F.lit(into)), F.lit(buckets)))  # other buckets for each numbering
    counts = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = running_start(counts, keys, "__b", "__n", "__start").drop("__n")
    w = Window.partitionBy(*keys, "__b").orderBy(rid)
    joined = dealt.join(starts, [*keys, "__b"])
    return joined.withColumn(into, F.col("__start") + F.row_number().over(w) - 1).drop("__b", "__start")
