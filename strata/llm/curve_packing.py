"""Packing of documents into sequences along a space-filling curve.

1. Texts become token ids, with ``END`` after each document. A document's hashed vector (square
   roots of its tokens' counts in ``BUCKETS`` buckets, of length one) is projected on ``DIMENSIONS``
   fixed rows of signs. Each coordinate, squeezed to 0..1 by a fixed curve and cut to ``BITS`` bits, is a side of
   a grid cell, and the cell's place on the Hilbert curve is the document's key: neighbours
   on the curve have similar words. Bits of a hash of the row follow, so that a group of
   equal texts, however large, spreads over ranges.
2. Keys are range-sorted (without texts). Within a range a running sum gives each
   document its place, and the ranges' totals, one row a range, theirs: its place among all tokens.
3. The stream of all tokens is cut every ``length`` tokens, so documents that lie next
   to each other on the curve share sequences. The rest at the end is cut into
   powers of two, which need no padding either: nothing is ever padded.

Every id lies in exactly one piece. The ids are written once, with their rows' numbers, and meet
their places in a join on these.

A null text is empty: one token, ``END``. Repeated rows and rows without a doc_id are packed
like others; an empty table gives an empty result; extra columns are ignored.

Tokenizers that end words with a suffix and drop white space see each distinct word of a task once
(words cannot reach over white space, nor over a point after a letter); others see whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strata.llm.common import staged
from strata.llm.tokens import _utf8, mix

LENGTH = 4096
END = 2
DIMENSIONS, BITS = 4, 11
BUCKETS = 1024
# Bits of the row's hash under the curve's.
_SALT = 63 - DIMENSIONS * BITS
# Bytes of text that a task holds in arrays at once, or one text.
PIECE = 4 << 20
# Distinct words whose ids a task keeps, about.
KNOWN = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Encoder:
    """Ids of texts by a tokenizer's file."""

    def __init__(self, path: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.at = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone, many at a time: each gives one token that ends a word."""
        ids, sizes = [], []
        for lo in range(0, len(words), 4096):
            some = words.slice(lo, 4096).to_pylist()
            own = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            end = np.flatnonzero(self.ends[own]) + 1
            if len(end) == len(some) and (not len(end) or end[-1] == len(own)):
                size = np.diff(end, prepend=0)
            else:
                own, size = self._each(some)
            ids.append(own)
            sizes.append(size)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _learn(self, words: pa.Array) -> None:
        plain = pc.utf8_is_alpha(words)
        for some, find in ((words.filter(plain), self._letters), (words.filter(pc.invert(plain)), lambda w: self._each(w.to_pylist()))):
            if len(some):
                ids, sizes = find(some)
                self.words = pa.concat_arrays([self.words, some])
                self.ids = np.concatenate((self.ids, ids))
                self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8 bytes, offsets), one after the other, and how many each has."""
        if not self.by_words:
            return self._each([bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        n = len(data)
        space = _SPACE[data]
        word = ~space
        first = word.copy()
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first[1:] &= space[:-1] | edge[1:-1] | (_MARK[data[1:]] & _LETTER[data[:-1]])
        starts = np.flatnonzero(first)
        place = np.cumsum(word, dtype=np.int32)
        at = np.concatenate((place[starts] - 1, [place[-1] if n else 0])).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[word])])
        coded = array.dictionary_encode()
        if len(self.words) > KNOWN:
            self._forget()
        fresh = coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.words)))
        if len(fresh):
            self._learn(fresh)
        known = pc.index_in(coded.dictionary, value_set=self.words).to_numpy(zero_copy_only=False)
        entry = known[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        size = np.diff(self.at)[entry]
        total = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.at[entry] - total[:-1], size)
        take += np.arange(len(take))
        return self.ids[take], np.diff(total[np.searchsorted(starts, offsets)])


def _signs() -> np.ndarray:
    """Fixed rows of signs, one column a dimension."""
    h = mix(np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(0x51ED))
    return np.where(h >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)


def _cells(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The grid cell of each document: ``DIMENSIONS`` sides of ``BITS`` bits."""
    n = len(sizes)
    bucket = (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    out = np.zeros((n, DIMENSIONS))
    signs = _signs()
    step = 4096
    total = np.concatenate(([0], np.cumsum(sizes)))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = np.repeat(np.arange(hi - lo), sizes[lo:hi]) * BUCKETS + bucket[total[lo] : total[hi]]
        vector = np.sqrt(np.bincount(own, minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS))
        norm = np.sqrt((vector**2).sum(1, keepdims=True))
        out[lo:hi] = (vector / np.maximum(norm, 1)) @ signs
    squeezed = 1 / (1 + np.exp(-1.702 * out))
    return np.minimum((squeezed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of coordinates) on the Hilbert curve that fills the grid."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    # Turn and mirror sub-cubes from the coarsest bit down, all cells at once.
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[:, i] >> b) & 1 == 1
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def _encoded(path: str, end: int):
    """Rows (row, doc_id, text): (row, doc_id, key, tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            row = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = _utf8(batch.column(2))
            lo = 0
            while lo < len(row):
                hi = min(len(row), max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1))
                ids, sizes = encoder.texts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                salt = mix(row[lo:hi].astype(np.uint64)) >> np.uint64(64 - _SALT)
                key = (hilbert(_cells(ids, sizes), BITS) << _SALT) | salt.astype(np.int64)
                stop = np.cumsum(sizes + 1)
                out = np.full(int(stop[-1]), end, encoder.kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), sizes)] = ids
                width = out.itemsize
                offsets = (np.concatenate(([0], stop)) * width).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[lo:hi]), batch.column(1).slice(lo, hi - lo), pa.array(key), pa.array(sizes + 1), packed],
                    ["row", "doc_id", "key", "tokens", "ids"],
                )
                lo = hi

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, row, tokens) of a range: (range, row, tokens before it in the range, with it)."""
    before, number = 0, TaskContext.get().partitionId()
    for batch in batches:
        tokens = batch.column(2).to_numpy()
        upto = before + np.cumsum(tokens)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(tokens), number)), batch.column(1), pa.array(upto - tokens), pa.array(upto)],
            ["range", "row", "at", "upto"],
        )
        before = int(upto[-1]) if len(upto) else before


def _powers(rest: int) -> list[int]:
    """``rest`` as powers of two, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(kind: pa.DataType, width: int, total: int, length: int, with_ids: bool):
    """Rows (doc_id, at, tokens, ids): the document's pieces."""
    full = total // length
    tail = full * length + np.concatenate(([0], np.cumsum(_powers(total % length)))).astype(np.int64)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, ids = [], [], []
            places, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for t, (at, n) in enumerate(zip(places, counts, strict=True)):
                own = np.frombuffer(batch.column(3)[t].as_buffer(), f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    place = at + start
                    if place < tail[0]:
                        sequence, offset = divmod(place, length)
                        room = length - offset
                    else:
                        last = int(np.searchsorted(tail, place, "right")) - 1
                        sequence, offset = full + last, place - int(tail[last])
                        room = int(tail[last + 1]) - place
                    size = min(room, n - start)
                    piece = own[start : start + size]
                    of.append(t)
                    rows.append((start, size, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        ids.append(piece)
                    start += size
            columns = [batch.column(0).take(pa.array(of, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(
    documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizer's file on every executor.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = documents.schema["doc_id"].dataType
    name = kind.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    encoded = rows.mapInArrow(_encoded(tokenizer, end), f"row bigint, doc_id {name}, key bigint, tokens bigint, ids binary")
    encoded = staged(encoded, "packing-ids")
    ranges = encoded.select("key", "row", "tokens").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    places = ranges.mapInArrow(_running, "range bigint, row bigint, at bigint, upto bigint")
    places = staged(places, "packing-places")
    # One row a range.
    totals = places.groupBy("range").agg(F.max("upto").alias("size"))
    upto = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = totals.select("range", (upto - F.col("size")).alias("begin"))
    total = totals.agg(F.sum("size")).first()[0] or 0
    place = places.join(begins, "range").select("row", (F.col("begin") + F.col("at")).alias("place"))
    placed = encoded.join(place, "row").select("doc_id", "place", "tokens", "ids")
    width = int(Encoder(tokenizer).kind[-1])
    schema = f"doc_id {name}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    cut = _pieces(to_arrow_type(kind), width, total, length, with_ids)
    return placed.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))
