"""A training-corpus pipeline: toxicity, language, near duplicates, source mix, packing. Each stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceatlas.llm import language_id, toxicity
from priceatlas.llm.common import materialize, unused
from priceatlas.llm.near_dedup import near_duplicates
from priceatlas.llm.pack import pack_documents
from priceatlas.llm.source_mix import poisson_mix

#: Documents scored at or above this go.
TOXIC = 0.7
#: Documents whose language is less sure than this, or undetermined, go.
SURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below TOXIC; null and empty texts stay here. Fitted on the labelled documents of this stage."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    columns, name = docs.columns, unused("toxicity", docs.columns)
    return toxicity.score(docs, model, columns, into=name).where(F.col(name) < TOXIC).drop(name)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts without a letter, null texts among them, go. The column lang is kept as it is."""
    lang, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    found = language_id.identify(docs, language_id.fit(docs, F.lit(True)), docs.columns, into=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= SURE)).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, as in all stages without a contract of their own; similarity 0.8).

    It is the one with the smallest doc_id; a null id gives way to any other. Of several texts with that id the one with the smallest hash
    stays, of repeated rows one. Where all ids are null, equal sets form a class. Texts without words are no copies of each other; rows that agree in id and text are one document.
    """
    found = near_duplicates(docs).where("kept")
    apart = F.when(F.col("n_shingles") == 0, F.col("digest").cast("string")).when(F.col("component_id").isNull(), F.hex("set_key"))
    chosen = found.groupBy("component_id", apart.alias("apart")).agg(F.min(F.struct("id", "digest")).alias("c"))
    key = lambda id, digest: [id.isNull().alias("none"), F.coalesce(id, F.lit(0)).alias("id"), digest.alias("digest")]
    chosen = chosen.select(*key(F.col("c.id"), F.col("c.digest")))
    rows = docs.select(*key(F.col("doc_id").cast("long"), F.xxhash64("text")), F.struct("*").alias("doc"))
    kept = rows.join(chosen, ["none", "id", "digest"], "left_semi").dropDuplicates(["none", "id", "digest"])  # one exchange serves both
    return kept.select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size; a document comes as often as its Poisson count says, in global random order."""
    return poisson_mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096."""
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Trees, forward sums and bin packing are not SQL; tests hold the stages to their names, columns and kept ids, and the operators to brute force where they can.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
