"""Sinks written twice, with a failure between."""

import pytest
from pyspark.sql import functions as F

from priceatlas.streaming import sinks


def rows(found):
    return sorted((repr(r.doc), r.n, r.v) for r in found.collect())


def test_a_failed_stream_writes_its_batch_again(spark, tmp_path):
    schema = "doc long, n int, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def fail(epoch):
        raise RuntimeError("lost between the write and its commit")

    with pytest.raises(Exception, match="lost between"):
        sinks.stream_into(stream(), f"{tmp_path}/out", f"{tmp_path}/check", then=fail)
    for _ in range(2):  # the second run has nothing new
        sinks.stream_into(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
    first = [("1", 1, "a"), ("1", 2, "b"), ("None", 1, "c")]
    assert rows(sinks.read_latest(spark, f"{tmp_path}/out", "doc")) == first and spark.read.parquet(f"{tmp_path}/out").count() == 3
    for _ in range(2):  # a document is parsed again: its rows are replaced as a whole, twice
        sinks.write_batch(spark.createDataFrame([(1, 1, "new")], schema), f"{tmp_path}/out", 7)
    want = [("1", 1, "new"), ("None", 1, "c")]
    assert rows(sinks.read_latest(spark, f"{tmp_path}/out", "doc")) == want
    for _ in range(2):
        sinks.compact(spark, f"{tmp_path}/out", "doc", f"{tmp_path}/small")
    assert rows(sinks.read_latest(spark, f"{tmp_path}/small", "doc")) == want and spark.read.parquet(f"{tmp_path}/small").count() == 2


def test_missing_rows_are_put_in_once(spark, tmp_path):
    schema = "doc long, n int, v string"
    path = f"{tmp_path}/rows"
    assert sinks.read_latest(spark, path, "doc") is None
    sinks.insert_missing(spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (None, 1, "x")], schema), path, ["doc", "n"], 0)
    for _ in range(2):
        sinks.insert_missing(spark.createDataFrame([(1, 1, "z"), (None, 1, "z"), (None, 2, "y"), (2, None, None)], schema), path, ["doc", "n"], 1)
    got = sorted((repr(r.doc), repr(r.n), r.v) for r in spark.read.parquet(path).collect())
    assert got == [("1", "1", "a"), ("2", "None", None), ("None", "1", "x"), ("None", "2", "y")]
    sinks.insert_missing(spark.createDataFrame([], schema), path, ["doc", "n"], 2)
    assert spark.read.parquet(path).where(F.col("batch") == 2).count() == 0
