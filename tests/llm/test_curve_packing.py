"""Packing: an exact round trip through the sequences, and the curve's own laws."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strata.llm import curve_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "Straße", "don't", "it's", "a.b", "...", "x!?y", "U.S.A.", "42", "3.14", "İstanbul", "été"]
    words += ["日本語", "<|endoftext|>", "<|STARTOFTEXT|>", "a<|startoftext|>b", "mailto:x@y.zz", "—", "ΣΑΣ", " ", "ﬁn", "'s", ".'s"]
    words += ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(200)]
    out = [None, "", " \n ", "word", "x " * 9000]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", ", ", ". ", ""]) for _ in range(rng.randint(0, 150))))
    return out + out[:40]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("piece, known", [(4 << 20, 1 << 20), (700, 50)])
def test_round_trip(spark, monkeypatch, piece, known):
    monkeypatch.setattr(curve_packing, "PIECE", piece)
    monkeypatch.setattr(curve_packing, "KNOWN", known)
    rows = [(None if i % 50 == 7 else i, t, "x", i) for i, t in enumerate(texts(4, 300))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, place int").repartition(3)
    got = curve_packing.pack(frame, length=512, with_ids=True).collect()
    want, have = {}, {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append(expected(text))
    by_sequence = {}
    for r in got:
        assert len(r["ids"]) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            have.setdefault(r["doc_id"], []).append(r)
    # Each document again, from its pieces.
    for doc_id, own in have.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        ids = [i for r in own for i in r["ids"]]
        assert [ids] == want[doc_id] and {r["doc_tokens"] for r in own} == {len(ids)}
    assert have.keys() == want.keys() - {None}
    nulls = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] is None)
    assert sum(len(i) for _, i in nulls) == sum(map(len, want[None]))
    # Sequences are gapless, full or a power of two.
    sizes = []
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for sequence in sorted(by_sequence):
        spans = sorted(by_sequence[sequence])
        assert [s for s, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1])
        sizes.append(sum(n for _, n in spans))
    total = sum(len(x) for own in want.values() for x in own)
    assert sizes == [512] * (total // 512) + curve_packing._powers(total % 512)


def test_neighbours_along_the_curve_are_alike(spark):
    rng = random.Random(1)
    topics = [[f"{p}{c}{q}" for c in "bdfgklm"] for p, q in (("za", "ry"), ("qu", "ow"), ("ne", "st"))]
    rows = [(i, " ".join(rng.choices(topics[i % 3], k=60))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    by_sequence = {}
    for r in curve_packing.pack(frame, length=1024).collect():
        by_sequence.setdefault(r["sequence_id"], []).append(r["doc_id"] % 3)
    share = sum(max(own.count(t) for t in range(3)) for own in by_sequence.values()) / sum(map(len, by_sequence.values()))
    assert share > 0.8


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_each_cell_by_steps_to_a_neighbour(n, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n)
    place = curve_packing.hilbert(cells, bits)
    assert sorted(place) == list(range(side**n))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_whole_texts_where_words_have_no_suffix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = curve_packing.Encoder(path)
    some = ["Hello  there, naïve", "", "x"]
    data = np.frombuffer("".join(some).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in some])
    ids, sizes = encoder.texts(data, offsets)
    whole = Tokenizer.from_file(path)
    assert not encoder.by_words
    assert list(ids) == [i for t in some for i in whole.encode(t, add_special_tokens=False).ids]
    assert sizes[1] == 0


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert curve_packing.pack(frame).collect() == []
