"""Long texts full of benchmark passages, and passages cut at either end of a text."""

import pytest

import corpus_pipeline
from strata.llm import decontam

ITEM = [f"w{i}" for i in range(40)]


def _found(spark, docs):
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(docs)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(ITEM))], "item_id bigint, text string")
    return sorted((r["doc_id"], r["score"], r["first_word"], r["n_words"]) for r in decontam.overlaps(docs, items).collect())


def test_no_text_is_held_for_each_hit(spark):
    # 20,000 words and about 60,000 hits: 9 GB, if each hit came with its text's words.
    assert _found(spark, [ITEM * 500, ["x", *ITEM]]) == [(0, 40, 0, 40), (1, 40, 1, 40)]


@pytest.mark.parametrize("most", [decontam.MAX_SEEDS, 0])
def test_passages_cut_by_the_ends_of_a_text(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MAX_SEEDS", most)
    docs = [ITEM[10:], ITEM[:25], ["x", "y", *ITEM[:25]], [*ITEM[28:], "x"], ITEM[15:25], ITEM[15:24], ["x", *ITEM[:20], "y", *ITEM[21:]]]
    want = [(0, 30, 0, 30), (1, 25, 0, 25), (2, 25, 2, 25), (3, 12, 0, 12), (4, 10, 0, 10), (6, 37, 1, 40)]
    assert _found(spark, docs) == want


def test_decontamination_stage_of_long_texts(spark, tmp_path):
    spark.createDataFrame([(7, " ".join(ITEM))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = " ".join(ITEM * 400)
    docs = spark.createDataFrame([(0, full), (None, "x " + full), (1, "x y z"), (None, None)], "doc_id bigint, text string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, None), (1, "x y z")]
