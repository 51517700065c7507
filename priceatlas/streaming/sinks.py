"""Sinks that a retry does not double: a document's rows replace its earlier ones as a whole, missing rows are put in once.

A table is a folder of batches. A batch overwrites its own folder alone, so writing it again after a failure changes nothing; of several batches
that hold a document the latest counts. No batch rewrites another, so writers need not read the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from priceatlas.functions.stored import shared_path, stored
from priceatlas.plans.entities import ITEMS_SQL, quotation_items, table


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the batch's folder anew, whatever an earlier attempt has left in it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table's rows, of each key those of the latest batch that holds it (null is a key too), with `batch`; None where nothing was written."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    last = rows.groupBy(F.col(key).alias("k")).agg(F.max("batch").alias("b"))
    return rows.join(last, rows[key].eqNullSafe(last["k"]) & (rows["batch"] == last["b"])).drop("k", "b")


def compact(spark: SparkSession, path: str, key: str, into: str) -> None:
    """The latest rows as batch 0 of another folder: readers of the old one are not disturbed, a retry writes the same."""
    rows = read_latest(spark, path, key)
    if rows is not None:
        write_batch(rows.drop("batch"), into, 0)


def insert_missing(rows: DataFrame, path: str, keys: list[str], batch: int) -> None:
    """Puts in the rows whose keys no other batch holds, of several with the same keys the first by all columns; running it again puts in the same. Null keys equal each other."""
    spark = rows.sparkSession
    first = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("r")).select(*keys, "r.*")
    try:
        held = spark.read.parquet(path).where(F.col("batch") != batch).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    except AnalysisException:
        held = None
    if held is not None:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        first = first.join(held, on, "left_anti")
    write_batch(stored(first.select(*rows.columns), "missing-rows"), path, batch)


def stream_into(stream: DataFrame, path: str, checkpoint: str, first_batch: int = 0, then: Callable[[int], None] | None = None) -> None:
    """Writes what the stream has now, a batch for each of its micro-batches; a restart with the same checkpoint writes an unfinished one again. then: called after each write."""
    def put(rows: DataFrame, epoch: int) -> None:
        write_batch(rows, path, first_batch + epoch)
        if then is not None:
            then(epoch)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation lines stream in as parsed; every third quotation is parsed again with doubled prices and without its first line, and written twice."""
    base = shared_path(spark, "sink")
    lines = quotation_items(spark, sf_dir).select("quotation_id", "line_no", F.col("unit_price").cast("double").alias("price"))
    source = f"{base}/parsed"
    lines.write.parquet(source)
    path = f"{base}/rows"
    stream_into(spark.readStream.schema(lines.schema).parquet(source), path, f"{base}/checkpoint")
    again = lines.where("quotation_id % 3 = 0 and line_no > 1").withColumn("price", F.col("price") * 2)
    for _ in range(2):
        write_batch(again, path, 1_000_000)
    insert_missing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quotation_id"), F.lit(0).alias("line_no"), F.lit(None).cast("double").alias("price")), path, ["quotation_id"], 2_000_000)
    found = read_latest(spark, path, "quotation_id")
    return found.groupBy("quotation_id").agg(F.count(F.lit(1)).alias("lines"), F.max("price").alias("most"))


REPARSED_SQL = f"""WITH i AS ({ITEMS_SQL}), l AS (SELECT quotation_id, line_no, CAST(unit_price AS DOUBLE) AS price FROM i),
r AS (SELECT quotation_id, price * 2 AS price FROM l WHERE quotation_id % 3 = 0 AND line_no > 1), k AS (SELECT quotation_id, price FROM l WHERE quotation_id NOT IN (SELECT quotation_id FROM r) UNION ALL SELECT * FROM r
UNION ALL SELECT DISTINCT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT quotation_id FROM l))
SELECT quotation_id, count(*) AS lines, max(price) AS most FROM k GROUP BY 1"""
QUERIES = {"reparse_sink": reparsed}
SQL = {"reparse_sink": REPARSED_SQL}
