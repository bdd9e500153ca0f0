"""Substring dedup with suffix automata of reference shards.

A window is ``LENGTH`` consecutive words. A word goes if a window covers it whose
words also start in a document with a smaller doc_id.

Every text is a reference for all later ones, so shards are not sent to every
task. First the windows that can match at all are found, then only these meet
the shard that can hold their match:

1. Of each window the k-gram of words with the least hash is its anchor; equal
   windows have equal anchors. Anchors of all documents are counted; only those in
   two documents or more go on.
2. The windows of those anchors are hashed, and each hash gets its smallest
   doc_id. Runs of windows that are first in their document are reference text,
   the others query a shard: the one of the document that has them first.
3. A shard's reference text becomes one suffix automaton over words, each state
   with the smallest doc_id that holds its strings. Query runs stream through it for
   matching statistics: the longest suffix at each word that a smaller doc_id
   holds. Maximal matches of ``LENGTH`` words and more are removed.

A shard has the references of a hash range of documents (about ``SHARD_WORDS``
words of the corpus, of which only repeated ones count), so its automaton is
bounded. A shard that many queries meet is copied, and its queries dealt over the
copies. Documents with the same words as one with a smaller doc_id take no part:
all their windows start there, so with ``LENGTH`` words or more they go whole.

Null texts have no words. Rows with a null doc_id lose nothing and take nothing.
Rows that share a doc_id are judged each on its own words, never against
each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import broadcast_within, staged
from strata.llm.tokens import Words, grams, pieces

LENGTH, ANCHOR = 50, 16
SHARD_WORDS = 500_000
# Query words that one copy of a shard takes, about.
COPY_WORDS = 400_000
MAX_SHARDS = 500_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _anchors(hashes: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The anchor of each window."""
    return _least(grams(hashes, anchor), length - anchor + 1)


def _texts(words: Words) -> Iterator[tuple[int, np.ndarray]]:
    hashes = words.hashes()
    for t, (s, e) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        yield t, hashes[s:e]


def _survey(length: int, anchor: int):
    """(doc_id, n_words, digest, anchors) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in pieces(batch.column(1)):
                found = [np.unique(_anchors(own, length, anchor)) if len(own) >= length else own[:0] for _, own in _texts(words)]
                at = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(words.digests()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    ],
                    ["doc_id", "n_words", "digest", "anchors"],
                )

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column as arrays."""
    flat = np.asarray(column.flatten())
    at = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def _windows(length: int, anchor: int):
    """(hash, doc_id) of the windows whose anchor is among the row's shared ones; rows (doc_id, text, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = _lists(batch.column(2))
            ids = batch.column(0).to_pylist()
            for lo, _, words in pieces(batch.column(1)):
                out, owner = [], []
                for t, own in _texts(words):
                    if len(own) >= length:
                        open_ = np.isin(_anchors(own, length, anchor).view(np.int64), shared[lo + t])
                        found = np.unique(grams(own, length)[open_])
                        out.append(found)
                        owner.append(np.full(len(found), ids[lo + t], np.int64))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], ["hash", "doc_id"]
                    )

    return run


def _runs(marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(mark, start, end) of each stretch of equal marks that are not negative."""
    if len(marks):
        edge = np.flatnonzero(np.diff(marks)) + 1
        for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(marks)])), strict=True):
            if marks[s] >= 0:
                yield int(marks[s]), int(s), int(e)


def _spread(ids: np.ndarray, shards: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


_PARTS = "shard bigint, query boolean, doc_id bigint, digest string, start bigint, words binary"


def _route(length: int, shards: int):
    """Reference and query runs of each row (doc_id, text, hashes, firsts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, firsts = _lists(batch.column(2)), _lists(batch.column(3))
            ids = batch.column(0).to_pylist()
            for lo, _, words in pieces(batch.column(1)):
                digests = words.digests()
                rows = []
                for t, own in _texts(words):
                    known, first = hashes[lo + t], firsts[lo + t]
                    if len(own) < length or not len(known):
                        continue
                    doc = ids[lo + t]
                    order = np.argsort(known)
                    known, first = known[order], first[order]
                    seen = grams(own, length).view(np.int64)
                    at = np.minimum(np.searchsorted(known, seen), len(known) - 1)
                    hit = known[at] == seen
                    shard = _spread(first, shards)[at]
                    mine = hit & (first[at] == doc)
                    for query, marks in ((False, np.where(mine, shard, -1)), (True, np.where(hit & ~mine, shard, -1))):
                        for mark, s, e in _runs(marks):
                            rows.append((mark, query, doc, digests[t], s, own[s : e + length - 1].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*rows, strict=True)],
                        ["shard", "query", "doc_id", "digest", "start", "words"],
                    )

    return run


class SuffixAutomaton:
    """All substrings of some texts, each with the smallest doc_id that has it.

    Texts are added by ascending doc_id, so the first to reach a state is the
    smallest; a separator that is no word ends each text.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.doc = [-1], [0], [float("-inf")]
        self.last, self.ends = 0, 0

    def add(self, words: list[int], doc: int) -> None:
        self.ends -= 1
        for word in (*words, self.ends):
            self._extend(word, doc)

    def _extend(self, word: int, doc: int) -> None:
        nexts, link, size, docs = self.next, self.link, self.size, self.doc
        new, at = len(nexts), self.last
        nexts.append({})
        size.append(size[at] + 1)
        docs.append(doc)
        link.append(0)
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at >= 0:
            to = nexts[at][word]
            if size[at] + 1 == size[to]:
                link[new] = to
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[to]))
                size.append(size[at] + 1)
                docs.append(docs[to])
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and nexts[at].get(word) == to:
                    nexts[at][word] = copy
                    at = link[at]
        self.last = new

    def matches(self, words: list[int], doc: int, length: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``length`` words or more that a smaller doc_id holds, joined where they overlap."""
        nexts, link, size, docs = self.next, self.link, self.size, self.doc
        state = have = 0
        spans: list[list[int]] = []
        for i, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                have = size[state]
            if word in nexts[state]:
                state = nexts[state][word]
                have += 1
                while docs[state] >= doc:
                    state = link[state]
                    have = size[state]
            if have >= length:
                if spans and i - have <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], i - have)
                    spans[-1][1] = i
                else:
                    spans.append([i - have, i])
        return [(s, e) for s, e in spans]


_SPANS = "doc_id bigint, digest string, start bigint, stop bigint"


def _match(length: int):
    def run(references: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(queries):
            automaton = SuffixAutomaton()
            for row in sorted(references.select(["doc_id", "start", "words"]).to_pylist(), key=lambda r: (r["doc_id"], r["start"])):
                automaton.add(np.frombuffer(row["words"], np.uint64).tolist(), row["doc_id"])
            for batch in queries.to_batches(max_chunksize=1024):
                for row in batch.to_pylist():
                    found = automaton.matches(np.frombuffer(row["words"], np.uint64).tolist(), row["doc_id"], length)
                    out += [(row["doc_id"], row["digest"], row["start"] + s, row["start"] + e) for s, e in found]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ("doc_id", "digest", "start", "stop")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, n_removed, kept_sha256) of each row (doc_id, text, spans)."""
    for batch in batches:
        ids, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, words in pieces(batch.column(1)):
            digests = words.digests()
            keep = np.ones(len(words.starts), bool)
            for t in range(hi - lo):
                for span in spans[lo + t]:
                    if span["digest"] == digests[t]:
                        keep[words.first[t] + span["start"] : words.first[t] + span["stop"]] = False
            total = np.concatenate(([0], np.cumsum(~keep)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo:hi], pa.int64()),
                    pa.array(digests),
                    pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
                    pa.array(words.digests(keep)),
                ],
                ["doc_id", "digest", "n_removed", "kept_sha256"],
            )


def remove_repeats(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space)."""
    texts = documents.select(F.col("doc_id").cast("bigint"), "text")
    survey = staged(
        texts.mapInArrow(_survey(length, anchor), "doc_id bigint, n_words bigint, digest string, anchors array<bigint>"),
        "substring-survey",
    )
    total = survey.agg(F.sum("n_words")).first()[0] or 0
    shards = int(min(MAX_SHARDS, 1 + total // SHARD_WORDS))
    firsts = survey.where(f"n_words >= {length} AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )
    firsts = firsts.where("first < last").select(F.col("digest").alias("_digest"), "first")
    known = survey.join(firsts, F.col("digest") == F.col("_digest"), "left").withColumn(
        "whole", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    )
    anchors = known.where("doc_id IS NOT NULL AND NOT whole").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    per_doc = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    held = staged(texts.join(per_doc, "doc_id").select("doc_id", "text", "shared"), "substring-texts")

    windows = held.mapInArrow(_windows(length, anchor), "hash bigint, doc_id bigint")
    first = windows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.where("first < last").select("hash", "first")
    repeated = windows.join(first, "hash").groupBy("doc_id").agg(
        F.collect_list(F.struct("hash", "first")).alias("found")
    )
    routed = held.select("doc_id", "text").join(repeated, "doc_id").select("doc_id", "text", "found.hash", "found.first")
    parts = staged(routed.mapInArrow(_route(length, shards), _PARTS), "substring-parts")

    load = parts.where("query").groupBy("shard").agg(F.sum(F.octet_length("words") / 8).alias("n"))
    load = load.select(F.col("shard").alias("_shard"), (1 + F.floor(F.col("n") / COPY_WORDS)).cast("int").alias("copies"))
    dealt = parts.join(broadcast_within(load, shards, MAX_SHARDS), F.col("shard") == F.col("_shard"))
    dealt = dealt.drop("_shard")
    queries = dealt.where("query").withColumn("copy", F.pmod(F.xxhash64("doc_id", "start"), F.col("copies")).cast("int"))
    references = dealt.where("NOT query").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    names = ("shard", "copy", "doc_id", "digest", "start", "words")
    sides = [side.select(*[F.col(c).alias(c) for c in names]).groupBy("shard", "copy") for side in (references, queries)]
    spans = sides[0].cogroup(sides[1]).applyInArrow(_match(length), _SPANS)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "start", "stop")).alias("spans"))
    cut = held.select("doc_id", "text").join(spans, "doc_id").select("doc_id", "text", "spans")
    cut = cut.mapInArrow(_cut, "doc_id bigint, digest string, n_removed bigint, kept_sha256 string").distinct()
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_cut"), "n_removed", "kept_sha256")
    out = known.drop("anchors").join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_cut")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM t WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM p
), f AS (
  SELECT h, min(doc_id) AS first FROM h GROUP BY h
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE first < doc_id
), g AS (
  SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id
), k AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM t LEFT JOIN g USING (doc_id)
), u AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM k WHERE n_removed > 0
), s AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.i = r.i
  WHERE r.i IS NULL GROUP BY u.doc_id
)
SELECT k.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_removed = 0 THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM k LEFT JOIN s ON k.doc_id = s.doc_id"""
