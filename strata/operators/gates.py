"""Run-metrics gates over a runs table (one row per dry-run cycle).

For each gate metric, over the passing runs only: min, max and exact median
(0 when there is no passing run), the number of passing runs under the
threshold (strict ``<``: a run exactly at the limit fails), the number of
passing runs, and ``all_pass`` (every passing run under the threshold, and at
least one). A failed run is a flake. The verdict is READY when there is no
flake, every gate passes and every run passed; otherwise it lists blockers.

The summary stacks the metrics into a long (group, metric, duration) frame and takes its figures in the
median's first scan; the verdict needs no medians and comes from one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.median import exact_median

# Gate names, the column each reads and its limit in seconds.
DEFAULT_GATES = {
    "m1": ("reset_duration", 120),
    "m2": ("total_e2e_duration", 1500),
}
PASS = "pass"


def stack_gates(runs: DataFrame, group_by: list[str], gates: dict[str, tuple[str, float]]) -> DataFrame:
    """Passing runs as (group..., metric, duration, limit), one row per gate."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(column).cast("double").alias("duration"),
                F.lit(float(limit)).alias("limit"),
            )
            for name, (column, limit) in gates.items()
        ]
    )
    return runs.where(F.col("outcome") == PASS).select(*group_by, F.inline(entries))


def _per_group(runs: DataFrame, group_by: list[str], gates: dict) -> DataFrame:
    """Run counts and every gate's figures in one aggregate, one row per group."""
    passed = F.col("outcome") == PASS
    aggs = [F.count(F.lit(1)).alias("cycles"), F.count_if(passed).alias("cycles_passed")]
    for name, (column, limit) in gates.items():
        duration = F.when(passed, F.col(column).cast("double"))
        aggs += [
            F.min(duration).alias(f"_{name}_min"),
            F.max(duration).alias(f"_{name}_max"),
            F.count_if(duration < F.lit(float(limit))).alias(f"_{name}_under"),
        ]
    return runs.groupBy(*group_by).agg(*aggs)


def _all_pass(name: str) -> Column:
    return (F.col(f"_{name}_under") == F.col("cycles_passed")) & (F.col("cycles_passed") > 0)


def gate_summary(
    runs: DataFrame,
    group_by: list[str] | None = None,
    gates: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """``group_by + [metric, min, max, p50, under_limit, passed_runs, all_pass]``."""
    group_by = list(group_by or [])
    gates = gates or DEFAULT_GATES
    passed = f"coalesce(outcome = '{PASS}', false)"
    entries = ", ".join(
        f"named_struct('metric', '{name}', 'duration', IF({passed}, CAST(`{column}` AS DOUBLE), NULL),"
        f" 'limit', {float(limit)}D, 'passed', {passed})"
        for name, (column, limit) in gates.items()
    )
    # A group without a passing run stays: its durations are null.
    groups = [f"`{c}`" for c in group_by]
    stacked = runs.selectExpr(*groups, f"inline(array({entries}))")
    figures = {
        "min": "coalesce(min(duration), 0.0D)",
        "max": "coalesce(max(duration), 0.0D)",
        "under_limit": "count_if(duration < limit)",
        "passed_runs": "count_if(passed)",
    }
    out = exact_median(stacked, [*group_by, "metric"], "duration", alias="p50", more=figures)
    return out.selectExpr(
        *groups,
        "metric",
        "min",
        "max",
        "coalesce(p50, 0.0D) AS p50",
        "under_limit",
        "passed_runs",
        "under_limit = passed_runs AND passed_runs > 0 AS all_pass",
    )


def run_verdict(
    runs: DataFrame,
    group_by: list[str] | None = None,
    gates: dict[str, tuple[str, float]] | None = None,
    expected_cycles: int | None = None,
) -> DataFrame:
    """``group_by + [cycles, cycles_passed, flakes, <gate>_all_pass..., m3_pass, ready, verdict, blockers]``.

    ``expected_cycles`` is the number of runs asked for (by default those present): with
    fewer passing runs than that, the last gate fails and a group is not READY.
    """
    group_by = list(group_by or [])
    gates = gates or DEFAULT_GATES
    flakes = F.col("cycles") - F.col("cycles_passed")
    expected = F.col("cycles") if expected_cycles is None else F.lit(expected_cycles)
    m3 = (flakes == 0) & (F.col("cycles_passed") == expected)
    blockers = F.concat_ws(
        "; ",
        F.when(flakes > 0, F.concat(flakes.cast("string"), F.lit(" flake(s) detected"))),
        *[F.when(~_all_pass(name), F.lit(f"{name} gate failed")) for name in gates],
        F.when(
            (flakes == 0) & (F.col("cycles_passed") != expected),
            F.concat(F.col("cycles_passed").cast("string"), F.lit(" of "), expected.cast("string"), F.lit(" cycles passed")),
        ),
    )
    ready = blockers == ""
    return _per_group(runs, group_by, gates).select(
        *group_by,
        "cycles",
        "cycles_passed",
        flakes.alias("flakes"),
        *[_all_pass(name).alias(f"{name}_all_pass") for name in gates],
        m3.alias("m3_pass"),
        ready.alias("ready"),
        F.when(ready, "READY").otherwise("NOT READY").alias("verdict"),
        blockers.alias("blockers"),
    )


def run_breaches(
    runs: DataFrame,
    group_by: list[str] | None = None,
    gates: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """``group_by + [cycle, metric, duration, limit]`` of each passing run over a limit (strict ``>``).

    A failed run is a flake; how long its phases took counts for nothing.
    """
    group_by = list(group_by or [])
    return stack_gates(runs, [*group_by, "cycle"], gates or DEFAULT_GATES).where("duration > limit")


def failure_phases(runs: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """``group_by + [failure_phase, flakes, first_cycle, seconds]``: failed runs by the phase they ended in.

    ``seconds`` is what these runs took in all. A failed run without a phase counts under ``unknown``.
    """
    group_by = list(group_by or [])
    failed = runs.where(F.col("outcome") != PASS)
    phase = F.coalesce("failure_phase", F.lit("unknown")).alias("failure_phase")
    return failed.groupBy(*group_by, phase).agg(
        F.count(F.lit(1)).alias("flakes"),
        F.min("cycle").cast("bigint").alias("first_cycle"),
        F.coalesce(F.sum("total_e2e_duration"), F.lit(0)).cast("bigint").alias("seconds"),
    )
