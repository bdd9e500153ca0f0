"""A doc_id that comes with different texts."""

import random

from strata.llm import minhash


def test_one_text_speaks_for_an_id(spark):
    rng = random.Random(9)
    text = lambda first, n: " ".join([first, *(f"w{rng.randrange(5000)}" for _ in range(n))])
    long, short, full = text("aaa", 90), text("zzz", 30), text("mmm", 50)
    # Of 1 the smaller string is the longer text; 4 has a null and empty rows beside a full one.
    rows = [(1, long), (1, short), (2, long), (3, short), (4, full), (4, None), (4, ""), (4, " \n"), (5, full), (6, None), (6, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {
        1: (87, 1, True), 2: (87, 1, False), 3: (27, 3, True), 4: (47, 4, True), 5: (47, 4, False), 6: (0, 6, True),
    }
