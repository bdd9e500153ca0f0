"""Pipeline stages on rows without a doc_id."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, source string"


def test_rows_without_an_id_are_decided(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, c, item = text(80), text(70), text(60), text(20)
    near = [*a[:40], "other", *a[41:]]
    rows = [
        (5, " ".join(a), "x"), (None, " ".join(a), "x"), (None, " ".join(near), "x"),
        (None, " ".join(b), "z"), (None, " ".join(b), "y"), (None, " ".join(c + item), "x"), (6, " ".join(c), "x"),
        (None, None, "x"), (None, "", "x"), (None, "", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()))
    assert got == Counter([rows[0], rows[4], *rows[5:]])
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))
    assert left.columns == df.columns
    assert Counter(map(tuple, left.collect())) == Counter(r for r in rows if r != rows[5])
