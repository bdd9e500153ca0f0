"""Phrase collocations against counting every phrase in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, words[i : i + k]] += 1
    out = {}
    long = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    held = {}
    for (lang, words), a in long.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                held[part] = max(held.get(part, 0), a)
    for (lang, words), a in long.items():
        if 100 * held.get((lang, words), 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, own in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def texts(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "ça", "x", "a-b", "Zoo", "日本", "q1", "naïve"] + [f"w{i}" for i in range(60)]
    fixed = ["new york city hall", "the same five words here", "ad hoc\tad hoc"]
    rows = [(None, "en"), ("", "en"), ("...", None), (" \t ", "fr"), ("the of " * 4000, "en")]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(fixed) if rng.random() < 0.15 else rng.choices(vocabulary, range(70, 0, -1))[0])
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        rows.append(("".join(words), rng.choice(["en", "en", "fr", None])))
    return rows + rows[:30]


@pytest.mark.parametrize("bits, shard, piece", [(26, 1 << 20, 4 << 20), (8, 40, 500)])
def test_collocations_against_brute_force(spark, monkeypatch, bits, shard, piece):
    # Few bits let rare phrases pass the filters; small shards need several tries.
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "PIECE", piece)
    monkeypatch.setattr(phrases, "ROW", 64 if bits == 26 else 3)
    monkeypatch.setattr(phrases, "REMEMBERED", 1 << 22 if bits == 26 else 10)
    rows = texts(bits)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n int, phrase string")
    got = phrases.collocations(frame.repartition(3), least=20, top=50)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 50)


def test_score_passes_64_bits(spark):
    frame = spark.createDataFrame([(10**14, 10**16, 10**14, 10**15)], "a bigint, n bigint, l bigint, r bigint")
    wide = "CAST({} AS DECIMAL({},0))".format
    expression = f"({wide('a * 1000', 18)} * {wide('n', 19)}) div ({wide('l', 18)} * {wide('r', 18)})"
    assert frame.selectExpr(expression).first()[0] == 1000 * 10**14 * 10**16 // (10**14 * 10**15)


def test_empty_and_rare(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    rare = spark.createDataFrame([("one two three", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(rare).collect() == []


def test_trie_finds_each_row_and_nothing_else():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 30, (3000, 6)).astype(np.uint64)
    rows[np.arange(6)[None, :] >= rng.integers(1, 7, (3000, 1))] = 0
    rows = np.unique(rows, axis=0)
    rows = rows[rng.permutation(len(rows))]
    trie = phrases.Trie.unpacked(phrases.Trie.build(rows).packed())
    known = {tuple(int(x) for x in r if x): i for i, r in enumerate(rows)}
    for _ in range(4000):
        probe = [int(x) for x in rng.integers(0, 32, int(rng.integers(1, 7)))]
        if rng.random() < 0.5:
            probe = list(list(known)[int(rng.integers(len(known)))])
        state = np.zeros(1, np.int64)
        for x in probe:
            good, state = trie.step(state, trie.numbers(np.array([x], np.uint64)))
            if not len(state):
                break
        found = int(trie.place[state[0]]) if len(state) else -1
        assert found == known.get(tuple(probe), -1)
