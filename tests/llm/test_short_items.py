"""Benchmark items of few words."""

from strata.llm import decontam


def test_items_of_few_words(spark):
    words = [f"q{i}" for i in range(7)]
    bench = [(n, " ".join(words[:n])) for n in (1, 3, 6, 7)]
    docs = [(0, "x"), (1, "Q0"), (2, "a q0 q1 Q2 b"), (3, "q0 q1 x q2"), (4, " ".join(words[:6])), (5, " "), (6, None)]
    docs += [(10 + i, " ".join(["a", *words[:i], "other", *words[i + 1 :], "b"])) for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["n_words"]) for r in decontam.overlaps(df, items).collect()}
    expect = {(d, 1) for d in (1, 2, 3, 4, *range(11, 17))} | {(d, 3) for d in (2, 4, *range(13, 17))} | {(4, 6), (16, 6)}
    expect |= {(10 + i, 7) for i in range(7)}
    seven = {p for p in got if p[1] == 7}
    assert got.keys() - seven | {p for p in seven if p[0] >= 10} == expect
    assert got[(2, 3)] == (3, 1, 3) and got[(4, 6)] == (6, 0, 6) and got[(10, 7)] == (6, 2, 6)


def test_broadcast_of_items_is_bound_by_their_words(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(decontam, "broadcast_within", lambda df, rows, most: counted.append((df.columns, rows)) or df)
    items = spark.createDataFrame([(i, f"a{i} b c") for i in range(50)], "item_id bigint, text string")
    decontam.overlaps(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), items)
    assert [rows for columns, rows in counted if "item" in columns] == [150]
