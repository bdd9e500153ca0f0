"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with its borders), each n-gram a
row of a hashed embedding table. The mean embedding of a word's n-grams is the
word's vector, and the mean over a window of consecutive words goes through a
linear softmax. Table and softmax are trained together, in numpy, by gradient
steps. Unseen spellings share n-gram rows with the ones seen.

A text's score is that of its worst window: a mean over a whole long text
would drown a few words, and the label speaks of the text, not of its windows.
Training follows the same rule, so each step moves the worst window of a text.

The fit runs in one task on a bounded sample of labelled rows (``MAX_FIT`` rows
per class, no text over ``MAX_FIT_BYTES``); scoring runs over all rows, whole
texts, with a model of fixed size.

Null and empty texts have no word; their score is that of an empty window (the
softmax's bias). Rows with a null doc_id are scored like others; repeated rows
give repeated rows. Labels that are null or of no document are left out; of
several labels of a document the highest counts, of several texts (that the fit
may see) the least. Without any label the score
is 0.5 for every text and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strata.llm.tokens import _utf8, mix

BUCKETS = 1 << 18
DIMENSIONS = 16
WINDOW = 6
SIZES = (3, 4, 5)
# Gradient steps of the fit, each over BATCH texts.
STEPS = 700
BATCH = 96
# Labelled rows of each class that the fit sees at most, and the longest text among them.
MAX_FIT = 2500
MAX_FIT_BYTES = 8_000
THRESHOLD = 0.7

# Letters, digits and all bytes over 127 make words; A-Z count as a-z.
_KEEP = np.full(256, 32, np.uint8)
_KEEP[48:58] = np.arange(48, 58)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


class Bags:
    """The words of some texts and the n-gram rows of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_texts = len(offsets) - 1
        # One separator before each text and at the end, so that no word crosses texts.
        where = np.arange(len(data)) + np.repeat(np.arange(n_texts), np.diff(offsets)) + 1
        text = np.full(len(data) + n_texts + 1, 32, np.uint8)
        text[where] = _KEEP[data]
        gap = text == 32
        start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        self.first = np.searchsorted(start, offsets + np.arange(n_texts + 1))
        self.words = len(start)
        word = np.cumsum(~gap & np.concatenate(([True], gap[:-1])), dtype=np.int32) - 1
        inner = np.concatenate(([0], np.cumsum(gap, dtype=np.int32)))
        letters = text.astype(np.uint32)
        rows, owners = [], []
        for n in SIZES:
            if len(text) < n:
                continue
            m = len(text) - n + 1
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h *= np.uint32(0x01000193)
                h ^= letters[j : j + m]
            # A border may stand at either end of an n-gram, not within.
            good = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]
            h = h[good]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            rows.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
            owners.append(word[1 : 1 + m][good])
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        self.count = np.maximum(np.bincount(self.owner, minlength=self.words), 1)

    def worst(self, gram: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the logit of its worst window, that window's first word and its length."""
        score = np.bincount(self.owner, gram[self.rows], minlength=self.words) / self.count
        total = np.concatenate(([0.0], np.cumsum(score)))
        n = np.diff(self.first)
        size = np.minimum(n, WINDOW)
        logit, at = np.full(len(n), bias), self.first[:-1].copy()
        full = np.flatnonzero(n)
        if len(full):
            # The windows of all texts, one after the other.
            many = n[full] - size[full] + 1
            begin = np.concatenate(([0], np.cumsum(many)[:-1]))
            w = np.arange(many.sum()) - np.repeat(begin - self.first[:-1][full], many)
            length = np.repeat(size[full], many)
            value = (total[w + length] - total[w]) / length
            best = np.maximum.reduceat(value, begin)
            hit = np.flatnonzero(value == np.repeat(best, many))
            of = np.searchsorted(begin, hit, "right") - 1
            first_hit = np.full(len(full), len(value))
            np.minimum.at(first_hit, of, hit)
            logit[full] = best + bias
            at[full] = w[first_hit]
        return logit, at, size


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of each n-gram row, bias): the table projected on the softmax's difference of classes."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    side = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32)
    bias, rate = 0.0, 0.5
    table_sq, side_sq, bias_sq = np.full(BUCKETS, 1e-3, np.float32), 1e-3, 1e-3
    order = rng.permutation(len(label))
    groups = []
    for lo in range(0, len(order), BATCH):
        own = order[lo : lo + BATCH]
        parts = [data[offsets[t] : offsets[t + 1]] for t in own]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        groups.append((Bags(np.concatenate(parts), ends), label[own].astype(float)))
    share = max(label.mean(), 1e-3)
    for _ in range(-(-STEPS // len(groups))):
        for g in rng.permutation(len(groups)):
            bags, y = groups[g]
            gram = table @ side
            logit, at, size = bags.worst(gram, bias)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            # Both classes weigh the same.
            slope = (p - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share + 1e-3)) / len(y) * 8
            # What each word, then each n-gram row, has in its text's worst window.
            text = np.repeat(np.arange(len(y)), size)
            word = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
            weight = np.zeros(bags.words)
            np.add.at(weight, word, slope[text] / size[text])
            part = weight[bags.owner] / bags.count[bags.owner]
            live = np.flatnonzero(part)
            by_row = np.bincount(bags.rows[live], part[live], minlength=BUCKETS)
            rows = np.flatnonzero(by_row)
            pull = by_row[rows].astype(np.float32)
            side_grad = pull @ table[rows]
            grad = pull[:, None] * side[None, :]
            table_sq[rows] += (grad**2).mean(1)
            table[rows] -= rate * grad / np.sqrt(table_sq[rows])[:, None]
            side_sq += float((side_grad**2).mean())
            side -= np.float32(0.1 * rate / np.sqrt(side_sq)) * side_grad
            b = float(slope.sum())
            bias_sq += b * b
            bias -= rate * b / np.sqrt(bias_sq)
    return (table @ side).astype(np.float32), bias


def train(documents: DataFrame, labels: DataFrame, fit_on: Column | None = None) -> tuple[bytes, float] | None:
    """The model, from labelled documents where ``fit_on`` (an expression on ``doc_id``) holds."""
    label = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    label = label.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if fit_on is not None:
        label = label.where(fit_on)
    # The sample is drawn on ids alone: the lowest hashes of each class.
    short = documents.where((F.octet_length("text") > 0) & (F.octet_length("text") <= MAX_FIT_BYTES))
    ids = label.join(short.select("doc_id").distinct(), "doc_id")
    draw = F.xxhash64("doc_id")
    chosen = ids.where("toxic = 1").orderBy(draw, "doc_id").limit(MAX_FIT).unionByName(
        ids.where("toxic = 0").orderBy(draw, "doc_id").limit(MAX_FIT)
    )
    # At most 2 * MAX_FIT ids: the texts stay where they are, and only the sample moves.
    sample = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=wanted).sort_by("doc_id").combine_chunks()
        if len(rows):
            data, offsets = _utf8(rows["text"].combine_chunks())
            gram, bias = fit(data[offsets[0] : offsets[-1]], offsets - offsets[0], rows["toxic"].to_numpy())
            yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "bias": [bias]})

    wanted = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])
    sample = sample.select(F.col("doc_id").cast("bigint"), "text", "toxic").repartition(1)
    found = sample.mapInArrow(run, "gram binary, bias double").first()
    return (bytes(found["gram"]), found["bias"]) if found else None


def score(documents: DataFrame, model: tuple[bytes, float] | None, into: str = "score") -> DataFrame:
    """``documents`` with a column ``into`` (0 to 1) more; a column of that name is replaced."""
    documents = documents.drop(into)
    if model is None:
        return documents.withColumn(into, F.lit(0.5))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*documents.schema.fields, StructField(into, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, bias = shared.value
        gram = np.frombuffer(gram, np.float32)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            out = np.zeros(len(column))
            data, at = _utf8(column) if len(column) else (None, np.zeros(1, np.int64))
            lo = 0
            while lo < len(column):
                hi = min(len(column), max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 19), "right")) - 1))
                bags = Bags(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                out[lo:hi] = bags.worst(gram, bias)[0]
                lo = hi
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, into])

    return documents.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxic_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(documents, labels, ~held_out(F.col("doc_id")))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = train(documents, labels, ~held_out(F.col("doc_id")))
    into = "score"
    while into in documents.columns:
        into += "_"
    return score(documents, model, into).where(F.col(into) < THRESHOLD).drop(into)
