"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate = target weight * total / rows. A document's count inverts the Poisson distribution of
that mean at a uniform number seeded by its id; it is exploded by its count and all copies are shuffled globally by a hash key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceatlas.llm.common import BROADCAST_ROWS

#: A rate is split into equal Poisson parts of at most this mean, whose sum has the same distribution; no rate is capped.
PART_MEAN = 16.0
#: Counts tabulated for a part: beyond 80, the rest of a Poisson of mean 16 is below the 2^-52 grid of the uniform numbers.
TABLE = 80


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: int | None, source_col: str) -> DataFrame:
    """__key (null-safe source), __rate, __parts, __cdf: one row per source; without weights, rows ** temperature."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    counts = docs.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        wanted = F.pow(F.col("__n").cast("double"), F.lit(temperature))
    else:
        wanted = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))]), F.col("__key")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("__w", wanted)
    sums = counts.agg(F.sum("__n"), F.sum("__w")).first()
    rows, weight = (sums[0] or 0), (sums[1] or 0.0)
    aim = rows if total is None else total
    rate = F.col("__w") / F.lit(weight or 1.0) * F.lit(float(aim)) / F.col("__n")
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_MEAN)).cast("int")
    mean = F.col("__rate") / F.col("__parts")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda a, k: F.struct((a.p * mean / k).alias("p"), F.concat(a.c, F.array(F.element_at(a.c, -1) + a.p * mean / k)).alias("c")),
        lambda a: a.c,
    )
    return counts.withColumn("__rate", rate).withColumn("__parts", parts).select("__key", "__rate", "__parts", cdf.alias("__cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs repeated so that sources have their target weights; columns of docs plus __replica, __replicas, __order; globally shuffled.

    weights: source -> weight; sources not named get none (a null source cannot be named). Without weights: rows ** temperature.
    total: expected rows out (default: rows in). Rows with the same id get the same count; a null id counts as the text "null".
    An empty table gives an empty table. Columns of docs called __replica, __replicas or __order are replaced; other names cannot clash.
    """
    result = ("__replica", "__replicas", "__order")
    columns = [c for c in docs.columns if c.lower() not in result]
    rates = source_rates(docs, weights, temperature, total, source_col)
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))

    def number(text):
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    def part(j):
        u = number(F.concat_ws("|", F.lit(str(seed)), j.cast("string"), name)).cast("double") / float(2**52)
        return F.size(F.filter("__cdf", lambda c: c <= u))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"), key.alias("__key"), name.alias("__name"), F.col(id_col).alias("__id"))
    name = F.col("__name")
    counted = packed.join(rates, "__key")
    counted = counted.withColumn("__replicas", F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda a, j: a + part(j)))
    copies = counted.where("__replicas > 0").withColumn("__replica", F.explode(F.sequence(F.lit(1), F.col("__replicas"))))
    order = number(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), name, F.col("__replica").cast("string")))
    return copies.withColumn("__order", order).orderBy("__order", "__id", "__replica").select("__doc.*", *result)
