"""Columns of the input that are called as an operator calls its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import decontam, hash_tree, minhash, poisson_mix, toxicity
from strata.llm.common import free

NAMES = ["_rank", "_first", "_s", "_g", "_n", "_group", "_source", "_steps", "_count", "_order", "copy", "mean", "_bad_id"]
NAMES += ["_key", "_full", "_row", "_kept_id", "score", "seed", "doc", "key", "x", "component", "id", "a", "b", "shingles"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 7 else None, f"some words of a text that nobody has seen before {i // 2} " * 3, "en", f"s{i % 3}", 60) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame = frame.withColumns({name: F.lit(f"own {name}") for name in NAMES})
    return frame.withColumn("map", F.create_map(F.lit("k"), F.col("lang"))).cache()


def _own(frame, docs, but=()):
    assert [c for c in docs.columns if c not in frame.columns] == []
    rows = frame.select(*[c for c in NAMES if c not in but], F.to_json("map").alias("map")).distinct().collect()
    assert [tuple(r) for r in rows] in ([], [(*(f"own {c}" for c in NAMES if c not in but), '{"k":"en"}')])


def test_operators_keep_columns_called_as_their_own(spark, docs):
    benchmark = spark.createDataFrame([(1, docs.first()["text"])], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    _own(hash_tree.place(docs, 24, grown=True), docs)
    _own(poisson_mix.mix(docs), docs, but=("copy", "mean"))
    _own(decontam.clean_all(docs, benchmark), docs)
    _own(minhash.keep_first_of_all(docs), docs)
    _own(minhash.keep_first(docs), docs)
    _own(toxicity.clean(docs, labels), docs)


def test_pipeline_stages_keep_them(spark, docs, tmp_path):
    benchmark = spark.createDataFrame([(1, "nothing that any text holds at all, whichever way")], "item_id bigint, text string")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        _own(out, docs)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    _own(out, docs)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of ten words or a few more than that")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_seeds_joined_by_shuffle_give_the_same_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i % 9, " ".join(words[i : i + 80])) for i in range(0, 300, 10)], "doc_id bigint, text string")
    items = spark.createDataFrame([(j, " ".join(words[j * 20 : j * 20 + 15 + j])) for j in range(15)] + [(99, "w5 w6")], "item_id bigint, text string")
    want = sorted(tuple(r) for r in decontam.overlaps(docs, items).collect())
    monkeypatch.setattr(decontam, "MAX_SEEDS", 0)
    assert want and sorted(tuple(r) for r in decontam.overlaps(docs, items).collect()) == want


def test_free_names():
    assert free(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
