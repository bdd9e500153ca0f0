"""The corpus pipeline, each stage's rows against brute force on the rows of the stage before; op6's counts likewise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import decontam, hash_tree, poisson_mix, queries, toxicity
from strata.llm.common import load

SCHEMA = "doc_id bigint, text string, source string"
COLUMNS = ["doc_id", "text", "source"]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def _fixture():
    rng = random.Random(31)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [prose(n) for n in (15, 20, 30)]
    docs, labels = [], []
    for i in range(300):
        words = prose(rng.randrange(20, 120))
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefrotz", "snarkwibbles"]))
        labels.append((i, int(i % 5 == 0)))
        if i % 11 == 1:
            words = docs[i - 1][1].split(" ")
            if len(words) > 60:
                words[7] = "other"
        if i % 13 == 2:
            passage = list(items[i % 3])
            passage[4] = "sub" if i % 2 else passage[4]
            words[9:9] = passage
        docs.append((i, " ".join(words), "abc"[i % 3] if i % 7 else "rare"))
    docs += [docs[8], (400, None, None), (401, "", "a"), (402, "two words", "b")]
    return docs, labels, [(10 + i, " ".join(w).upper()) for i, w in enumerate(items)]


def _near_kept(rows):
    sets = {}
    for d, t, _ in rows:
        w = _words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r[0]] == r[0]]


def _leaks(doc, item):
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= shift + j < len(doc) and doc[shift + j] == x for j, x in enumerate(item)]
        hit = any(all(same[j + p] for p, c in enumerate(m) if c == "1") for m in decontam.MASKS for j in range(len(item) - len(m) + 1))
        best = now = 0
        for s in same:
            now = max(0, now + (1 if s else decontam.SUBSTITUTION))
            best = max(best, now)
        if hit and best >= min(decontam.MIN_SCORE, len(item) - 3):
            return True
    return False


def _mixed(rows):
    """(row, copy) by md5 and the Poisson sum."""
    sizes = Counter(r[2] for r in rows)
    norm = sum(n**poisson_mix.POWER for n in sizes.values())
    out = []
    for row in rows:
        n = sizes[row[2]]
        mean = n**poisson_mix.POWER * len(rows) / norm / n
        digest = hashlib.md5(f"{poisson_mix.SEED}:{'' if row[0] is None else row[0]}".encode()).hexdigest()
        u, count, below = (int(digest[:13], 16) + 0.5) / 2**52, 0, math.exp(-mean)
        while below <= u:
            count += 1
            below += math.exp(-mean) * mean**count / math.factorial(count)
        out += [(row, c) for c in range(1, count + 1)]
    return out


def _shard(doc_id):
    node = hash_tree.tree(corpus_pipeline.SHARDS)
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), seed=42)
    while node.children:
        draw = lambda c: -math.log(((xxhash.xxh64_intdigest(c.name.encode(), seed=seed) >> 11) + 0.5) / 2**53) / c.weight
        node = min(node.children, key=draw)
    return node.shard


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = _fixture()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_of_run(spark, folder, monkeypatch):
    after, stage = {}, corpus_pipeline.staged

    def watched(df, purpose):
        after[purpose] = stage(df, purpose)
        return after[purpose]

    monkeypatch.setattr(corpus_pipeline, "staged", watched)
    out = corpus_pipeline.run(spark, folder).collect()
    assert list(after) == [f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES[:-1]]
    docs, _, items = _fixture()
    steps = [[tuple(r) for r in df.select(*COLUMNS).collect()] for df in after.values()]
    assert all(df.columns == COLUMNS for df in after.values())

    # Rejected are the rows whose text the trained model scores at the threshold or over it.
    given, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    model = toxicity.train(given, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(given, model).collect()
    clean = [tuple(r[c] for c in COLUMNS) for r in scored if r["score"] < toxicity.THRESHOLD]
    assert len(scored) == len(docs) and Counter(steps[0]) == Counter(clean)

    assert Counter(steps[1]) == Counter(_near_kept(steps[0]))
    benchmark = [_words(t) for _, t in items]
    assert Counter(steps[2]) == Counter(r for r in steps[1] if not any(_leaks(_words(r[1]), b) for b in benchmark))
    assert Counter(steps[3]) == Counter(r for r, _ in _mixed(steps[2]))
    # Every stage before the last one takes out or repeats something.
    assert len(docs) > len(steps[0]) > len(steps[1]) > len(steps[2]) and Counter(steps[2]) != Counter(steps[3])

    slots = {}
    for r in out:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"]) == (len(data) + 8, zlib.crc32(data), "key", _shard(r["doc_id"]))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert Counter(tuple(r[c] for c in COLUMNS) for r in out) == Counter(steps[3])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_poisson_counts(spark, folder):
    docs = _fixture()[0]
    got = Counter((tuple(r[c] for c in COLUMNS), r["copy"]) for r in queries.op6_poisson_mix(spark, folder).collect())
    assert got == Counter(_mixed(docs)) and max(c for _, c in got) > 1
