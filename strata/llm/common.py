"""Shared pieces of the operators: words, staged tables, link components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_dir

# Words are runs of anything but these six separators.
SEPARATORS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as parquet."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a fresh table in the shared folder and read again.

    Cuts the lineage: what follows reads files that every executor sees, so a
    lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column (and no other of them) is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_within(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast of ``df`` (fixed-width rows, counted) within ``most`` rows."""
    return F.broadcast(df) if rows <= most else df


def _observed(edges: DataFrame, purpose: str) -> tuple[DataFrame, tuple]:
    """``edges`` staged, and their number and an order-free hash of them, observed by the write itself."""
    seen = Observation()
    named = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("hash"))
    edges = staged(named, purpose)
    return edges, (seen.get["n"], seen.get["hash"])


def components(links: DataFrame, left: str, right: str, purpose: str = "components") -> DataFrame:
    """``(id, component)`` for each id in ``links``: the smallest id reachable.

    Alternating large-star and small-star steps: every node hands its larger
    neighbours to its smallest one, then its smaller ones, until each edge ends
    at the root. Every step is a partial aggregate and a join on the node, so a
    node with a third of all links only makes a join side that Spark splits.
    Self links keep an id that has no other; null ends are left out.
    """
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    edges, before = _observed(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), purpose)
    alone = edges.where("a = b").select("a")
    edges = edges.where("a <> b")
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            )
        )
        edges, after = _observed(small.where("a <> b").distinct(), purpose)
        if after == before:
            break
        before = after
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    single = alone.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return out.unionByName(roots).unionByName(single).groupBy("id").agg(F.min("component").alias("component"))
