import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

import strata.operators.median as M
from pyspark.sql import functions as F

values = st.one_of(
    st.floats(allow_nan=False, width=64),
    st.integers(-5, 5).map(float),
    st.sampled_from([0.0, -0.0, 1e-310, -1e300, math.inf, -math.inf]),
)


def _expect(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: statistics.median(vs) for g, vs in groups.items()}


def _check(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in M.exact_median(df, ["g"], "v").collect()}
    exp = _expect(rows)
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g] == exp[g] or (math.isnan(got[g]) and math.isnan(exp[g])), (g, got[g], exp[g])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), values)), min_size=1, max_size=60))
def test_matches_python_median(spark, rows):
    # statistics.median of +inf and -inf is nan; the exact operator agrees.
    _check(spark, rows)


def test_hot_group_ties_and_one_value(spark):
    rows = [("hot", float(i % 13)) for i in range(200)] + [("cold", 2.5), ("cold", 4.5)]
    rows += [("t", 3.0)] * 50 + [("t", 4.0)] * 50 + [("one", -7.25)]
    _check(spark, rows)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in M.exact_median(df, [], "v").collect()] == [(2.0,)]
    assert M.exact_median(df.where("false"), [], "v").collect() == []


def test_building_the_plan_runs_no_job(spark):
    df = spark.range(10).selectExpr("cast(id % 2 as string) g", "raise_error('ran') v").selectExpr("g", "cast(v as double) v")
    M.exact_median(df, ["g"], "v")


def test_clustered_values_and_many_rows(spark):
    # Most values lie in a sliver of the range, so equal-width parts would not narrow anything.
    df = spark.range(300_000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'even' END AS g",
        "CASE WHEN id % 3 = 0 THEN 1 + pmod(hash(id), 1000003) * 1e-14 + IF(id % 30 = 0, 1e6, 0) ELSE pmod(hash(id), 99991) END AS v",
    )
    got = {r["g"]: r["median"] for r in M.exact_median(df, ["g"], "v").collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_nan_is_the_greatest_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("nan"),), (2.0,), (0.5,)], "v double")
    assert M.exact_median(df, [], "v").first()["median"] == 2.0


def test_each_scan_is_one_of_three(spark, workdir):
    spark.range(1000).selectExpr("id % 7 AS g", "id * 1.5D AS v").write.parquet(f"{workdir}/rows")
    out = M.exact_median(spark.read.parquet(f"{workdir}/rows"), ["g"], "v", more={"n": F.count("v")})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 3


def test_groups_without_values_stay_with_more_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, None)], "g string, v double")
    got = {tuple(r) for r in M.exact_median(df, ["g"], "v", more={"rows": F.count(F.lit(1))}).collect()}
    assert got == {("a", 1.5, 2), ("b", None, 1), (None, None, 1)}
