"""Rows of op8 and op10 against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from strata.llm import decontam, toxicity


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def _overlaps(docs, items):
    out = {}
    for doc_id, text in docs:
        doc = _words(text)
        for item_id, item_text in items:
            item = _words(item_text)
            if doc_id is None or item_id is None or not item:
                continue
            shifts = set()
            for mask in decontam.MASKS:
                looked = [j for j, c in enumerate(mask) if c == "1"]
                for i in range(len(doc) - len(mask) + 1):
                    for j in range(len(item) - len(mask) + 1):
                        if all(doc[i + x] == item[j + x] for x in looked):
                            shifts.add(i - j)
            if len(item) <= decontam.SHORTEST:
                for i in range(len(doc) - len(item) + 1):
                    same = sum(a == b for a, b in zip(doc[i:], item))
                    if same == len(item) or (len(item) == decontam.SHORTEST and same == len(item) - 1):
                        shifts.add(i)
            least = len(item) if len(item) < decontam.SHORTEST else min(decontam.MIN_SCORE, len(item) - 3)
            for shift in shifts:
                now = begin = best = first = end = 0
                for j, word in enumerate(item):
                    begin = j if now == 0 else begin
                    at = shift + j
                    now = max(0, now + (1 if 0 <= at < len(doc) and doc[at] == word else decontam.SUBSTITUTION))
                    if now > best:
                        best, first, end = now, begin, j + 1
                if best >= least:
                    found = (best, -shift, first, end)
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), found), found)
    return {k: (b, first + -shift_neg, end - first) for k, (b, shift_neg, first, end) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_row_by_row(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 7, 7, 9, 15, 30])))) for i in range(14)]
    items += [(None, "w1 w2 w3"), (20, None), (21, " \n"), (22, items[6][1]), (0, "another text of item nought and some words more")]
    docs = [(None, items[0][1]), (500, None), (501, "")]
    for d in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            piece = _words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                if piece:
                    piece[rng.randrange(len(piece))] = "changed"
            cut = rng.randint(0, len(piece) // 3)
            at = rng.randint(0, len(words))
            words[at:at] = piece[cut:]
        docs.append((d % 35, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs.append((600, " ".join(rng.choices(vocabulary, k=4000)) + " " + items[7][1]))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["n_words"]) for r in decontam.overlaps(df, bench).collect()}
    want = _overlaps(docs, items)
    assert got == want and len(got) > 10


def _score(text, gram, bias):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20]+", bytes(toxicity._KEEP[np.frombuffer(data, np.uint8)])) if data else []
    values = []
    for word in words:
        padded, own = b" " + word + b" ", []
        for n in toxicity.SIZES:
            for i in range(len(padded) - n + 1):
                h = n
                for c in padded[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                h ^= h >> 15
                h = h * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
                own.append(float(gram[h & (toxicity.BUCKETS - 1)]))
        values.append(sum(own) / max(len(own), 1))
    size = min(len(values), toxicity.WINDOW)
    windows = [sum(values[i : i + size]) / size for i in range(len(values) - size + 1)] if size else [0.0]
    return 1 / (1 + math.exp(-max(windows) - bias))


def test_scores_against_a_loop_over_words(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randint(1, 40))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Grumble-frotz!", "snark", "ÜBEL"]))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    extra = [(900, None), (901, ""), (902, "...,"), (903, "a"), (904, "x " * 20_000 + "snark"), (5, rows[5][1])]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string").repartition(4)
    model = toxicity.train(df, labels)
    gram, bias = np.frombuffer(model[0], np.float32), model[1]
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert math.isclose(r["score"], _score(r["text"], gram, bias), abs_tol=1e-5)


def test_the_model_depends_on_the_rows_alone(spark):
    # Several texts of an id, in any order and layout: the least one counts.
    rows = [(i, f"some words {i} " + ("grumble " if i % 2 else "") + f"t{c}") for i in range(60) for c in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = toxicity.train(df.repartition(5), labels)
    two = toxicity.train(df.orderBy("text", ascending=False).coalesce(1), labels)
    assert one == two
