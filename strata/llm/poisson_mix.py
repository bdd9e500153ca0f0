"""Mixing sources to target weights by Poisson replication.

A source with n documents and a target share s of the mixture gets the mean
repetition rate ``s * budget / n``. Each document's count is the Poisson
distribution of that mean, inverted at a number in (0, 1) that a hash of seed and
doc_id gives: a document has the same count on every run and cluster. Documents are
exploded by their count and dealt out by the hash of (doc_id, copy, text), so that the
rows of every source lie everywhere.

The default target weighs a source by ``n ** POWER``: below 1, large sources
come less often than their size says and small ones more often.

A null source is a source of its own; a null doc_id is one id. Repeated rows
have the same count. Texts only count for the order. An empty table gives no rows.
Columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import broadcast_within, free, staged

POWER = 0.7
SEED = "mix-1"
# Sources (a name and a short list of numbers each) that may be broadcast.
MAX_SOURCES = 20_000


def uniform(seed: str, *key: Column) -> Column:
    """A number in (0, 1) from the md5 of seed and key: 52 bits."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """The distribution function of Poisson(mean) at 0, 1, 2, ... until nothing is left of it."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    begin = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("out"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["out"], F.array(total)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, step)["out"]


def rates(documents: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None) -> DataFrame:
    """Per source: n, mean, and the steps of its distribution. ``weights``: target weight by source."""
    sizes = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(POWER))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = staged(sizes.withColumn("weight", weight), "mix-sources")
    total, norm = sizes.agg(F.sum("n"), F.sum("weight")).first()
    scale = float(budget or total or 0) / norm if norm else 0.0
    mean = F.col("weight") * F.lit(scale) / F.col("n")
    return sizes.select("source", "n", mean.alias("mean")).where("mean > 0").withColumn(
        "steps", poisson_steps(F.col("mean"))
    )


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    budget: int | None = None,
    seed: str = SEED,
    copy: str = "copy",
    mean: str = "mean",
) -> DataFrame:
    """``documents`` exploded by count and shuffled, with the columns ``copy`` (from 1) and ``mean`` more."""
    per = rates(documents, weights, budget)
    rows = per.count()
    documents = documents.drop(copy, mean)
    source, steps, count, order = free([*documents.columns, copy, mean], "_source", "_steps", "_count", "_order")
    per = per.select(F.col("source").alias(source), F.col("mean").alias(mean), F.col("steps").alias(steps))
    per = broadcast_within(per, rows, MAX_SOURCES)
    u = uniform(seed, F.col("doc_id"))
    out = documents.join(per, F.col("source").eqNullSafe(F.col(source)))
    out = out.withColumn(count, F.size(F.filter(steps, lambda c: c <= u))).where(F.col(count) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    # Rows of one doc_id are dealt out by their text, too.
    text = [F.xxhash64("text")] if "text" in documents.columns else []
    out = out.withColumn(order, uniform(seed + "-order", F.col("doc_id"), F.col(copy), *text))
    parts = int(math.ceil(float(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return out.repartition(parts, order).sortWithinPartitions(order).drop(source, steps, count, order)
