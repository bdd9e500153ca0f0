"""Exact median per group in three scans, without gathering any group into one task.

Spark's exact ``percentile`` merges every distinct value of a group in one task. Here, at
every size alike:

1. One aggregate sketches each group's quantiles (mergeable, of fixed size). Two of them, a
   few sketch errors below and above the middle, bracket the median; the number of values
   gives the ranks wanted, ``(n + 1) div 2`` and ``n div 2 + 1``.
2. A second aggregate counts the values below the bracket and sketches those within it, which
   narrows it to three of ``SEGMENTS`` parts: a bracket of about 8 / ``ACCURACY`` of the rows becomes
   one of about 24 / (``ACCURACY`` * ``SEGMENTS``), whatever the distribution.
3. Values below are counted, those in the narrow bracket counted by value, and a running sum over these
   (at most some ten thousandths of a thousandth of a group's rows) finds the values at the wanted ranks.

It is one lazy plan. The brackets, one row a group, meet the rows in plain joins: Spark broadcasts them when
their size allows, and else splits the join's side of a hot group. Counts are exact at each step; should a rank
lie outside its bracket, the query fails instead of giving a wrong value.

NaN counts as the greatest value, as in Spark; -0.0 is 0.0; nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sketches: the first one's relative error is 1 / ACCURACY, and the first bracket reaches MARGIN
# errors to either side of the middle; the second one's error is a tenth of a part, and a part lies to either side.
ACCURACY = 10_000
MARGIN = 4
SEGMENTS = 256


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _met(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (of the keys and ``_v``) with their group's bracket; the keys of the two sides are null-safe."""
    others = [_quoted(c) for c in brackets.columns if c not in keys]
    side = brackets.selectExpr(*[f"{_quoted(k)} AS {_quoted('_b_' + k)}" for k in keys], *others)
    same = " AND ".join(f"{_quoted(k)} <=> {_quoted('_b_' + k)}" for k in keys) or "true"
    return rows.join(side, F.expr(same)).selectExpr(*map(_quoted, keys), "_v", *others)


def exact_median(
    df: DataFrame, keys: list[str], value: str, alias: str = "median", more: dict[str, Column | str] | None = None
) -> DataFrame:
    """``keys + [alias]`` and the aggregates ``more`` (by name, as columns or SQL), one row per group of ``keys``.

    No keys: one group. Without ``more`` groups whose values are all null are left out; with it they have a null median.
    """
    every = more is not None
    more = {name: F.expr(c) if isinstance(c, str) else c for name, c in (more or {}).items()}
    # Expressions are SQL text: the plan is the same, and quicker to put together.
    number = f"CAST({_quoted(value)} AS DOUBLE)"
    normalized = f"CASE WHEN {number} = 0 THEN 0.0D ELSE {number} END AS _v"
    rows = df.selectExpr(*map(_quoted, keys), normalized)
    near = MARGIN / ACCURACY
    first = df.selectExpr("*", normalized).groupBy(*keys).agg(
        F.expr("count(_v)").alias("_n"),
        F.expr(f"percentile_approx(_v, array({0.5 - near}D, {0.5 + near}D), {ACCURACY})").alias("_bracket"),
        *[c.alias(name) for name, c in more.items()],
    )
    # What is fixed for a group goes along as grouping columns, so that no scan is needed twice.
    fixed = [*keys, "_n", *more]
    quoted = [_quoted(c) for c in fixed]
    if not every:
        first = first.where("_n > 0")
    bracket = first.selectExpr(*quoted, "_bracket[0] AS _lo", "_bracket[1] AS _hi")
    # The parts' borders as one constant.
    borders = f"CAST(split('{' '.join(str(i / SEGMENTS) for i in range(SEGMENTS + 1))}', ' ') AS ARRAY<DOUBLE>)"
    second = _met(rows, bracket, keys).groupBy(*fixed).agg(
        F.expr("count_if(_v < _lo)").alias("_below"),
        F.expr("count_if(_v >= _lo AND _v <= _hi)").alias("_within"),
        F.expr(f"percentile_approx(CASE WHEN _v >= _lo AND _v <= _hi THEN _v END, {borders}, {10 * SEGMENTS})").alias("_parts"),
    )
    low, high = "((_n + 1) div 2)", "(_n div 2 + 1)"
    missed = "CAST(raise_error('a median lies outside its bracket') AS DOUBLE)"

    def part(i: str) -> str:
        # Ranks within the bracket; the part that holds each, and one more to either side.
        held = f"{low} > _below AND {high} <= _below + _within"
        return f"CASE WHEN _n = 0 THEN NULL WHEN {held} THEN get(_parts, CAST({i} AS INT)) ELSE {missed} END"

    begin = f"greatest(0, (({low} - _below - 1) * {SEGMENTS}) div _within - 1)"
    end = f"least({SEGMENTS}, (({high} - _below) * {SEGMENTS}) div _within + 2)"
    narrow = second.selectExpr(*quoted, f"{part(begin)} AS _lo", f"{part(end)} AS _hi")
    # Values below the narrow bracket are one row, as null; so is a group without values.
    third = _met(rows, narrow, keys).where("_v <= _hi OR _n = 0")
    third = third.groupBy(*fixed, F.expr("CASE WHEN _v >= _lo THEN _v END").alias("_value")).agg(F.expr("count(1)").alias("_c"))
    upto = f"sum(_c) OVER (PARTITION BY {', '.join(quoted)} ORDER BY _value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS _upto"
    third = third.selectExpr("*", upto)
    found = third.groupBy(*fixed).agg(
        *[
            F.expr(f"max(CASE WHEN _upto - _c < {rank} AND {rank} <= _upto THEN _value END)").alias(name)
            for name, rank in (("_low", low), ("_high", high))
        ]
    )
    middle = (
        f"CASE WHEN _n = 0 THEN NULL WHEN _low IS NULL OR _high IS NULL THEN {missed}"
        f" WHEN _low = _high THEN _low ELSE (_low + _high) / 2 END AS {_quoted(alias)}"
    )
    return found.selectExpr(*map(_quoted, keys), middle, *map(_quoted, more))
