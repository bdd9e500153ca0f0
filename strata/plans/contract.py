"""A table's schema against its declared one, as rows.

Each declared column and each column there is too many gets a row: whether it is there with its type, as
another type, missing or unexpected; for a missing one the unexpected column with the nearest
name (least edits, then the same type, then the name), as an analysis error would suggest it.
``profile`` adds what a table holds in each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.schemas import struct

OK, RETYPED, MISSING, UNEXPECTED = "ok", "retyped", "missing", "unexpected"
# Numbers that widen one after the other; the distance of two types is how far apart they are.
_WIDTHS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _type_distance(a: Column, b: Column) -> Column:
    places = F.create_map(*[x for i, w in enumerate(_WIDTHS) for x in (F.lit(w), F.lit(i))])
    apart = F.abs(F.element_at(places, a) - F.element_at(places, b))
    return F.when(a == b, 0).otherwise(F.coalesce(apart, F.lit(len(_WIDTHS))))


def schema_diff(df: DataFrame, ddl: str) -> DataFrame:
    """(column, position, expected, actual, status, suggestion, edits, type_distance), declared columns first."""
    declared = [(f.name, f.dataType.simpleString()) for f in struct(ddl)]
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [name for name, _ in declared]
    extra = [(name, kind) for name, kind in actual.items() if name not in names]
    rows = [(name, kind, actual.get(name)) for name, kind in declared] + [(name, None, kind) for name, kind in extra]
    rows = [(i, *r) for i, r in enumerate(rows)]
    table = df.sparkSession.createDataFrame(rows, "position INT, column STRING, expected STRING, actual STRING")
    status = (
        F.when(F.col("expected").isNull(), UNEXPECTED)
        .when(F.col("actual").isNull(), MISSING)
        .when(F.col("expected") == F.col("actual"), OK)
        .otherwise(RETYPED)
    )
    # The columns there are too many, each held against a missing one's name and type.
    others = [
        F.struct(
            F.levenshtein(F.col("column"), F.lit(name)).alias("edits"),
            _type_distance(F.col("expected"), F.lit(kind)).alias("types"),
            F.lit(name).alias("name"),
        )
        for name, kind in extra
    ]
    nearest = F.array_min(F.array(*others)) if others else F.lit(None).cast("struct<edits:int,types:int,name:string>")
    table = table.withColumn("status", status).withColumn("near", F.when(F.col("status") == MISSING, nearest))
    types = F.when(F.col("status") == MISSING, F.col("near.types")).when(
        F.col("status") != UNEXPECTED, _type_distance(F.col("expected"), F.col("actual"))
    )
    return table.select(
        "column",
        "position",
        "expected",
        "actual",
        "status",
        F.col("near.name").alias("suggestion"),
        F.col("near.edits").alias("edits"),
        types.alias("type_distance"),
    )


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, filled): how many rows there are, and how many have a value in each column. One scan."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(names)])
    entries = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_c{i}").alias("filled")) for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*entries)))


def contract(df: DataFrame, ddl: str) -> DataFrame:
    """``schema_diff`` with ``rows`` and ``filled`` of each column that is there."""
    diff = schema_diff(df, ddl)
    held = profile(df).withColumnRenamed("column", "_held")
    return diff.join(held, F.col("column") == F.col("_held"), "left").drop("_held")
