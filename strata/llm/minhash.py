"""MinHash near-dedup with circulant permutations.

A document's set holds its distinct shingles of ``k`` words (A-Z lower-cased;
with fewer words the whole sequence is one shingle, with none the set is empty
and links with nothing). One permutation spreads a shingle over the universe of
32-bit values; a second one, shifted circularly by j, gives coordinate j of the
signature: the least permuted value over the set. ``BANDS`` bands of ``ROWS``
coordinates make bucket keys (at a similarity of 0.8 a pair shares none of
them with a probability of 5e-8); every candidate is confirmed on full sets.

Copies: documents with equal sets are one class, whose smallest doc_id stands
for it. Within a bucket no list of pairs is made. First each member is held
against the bucket's smallest one; the confirmed links are joined into components,
and only members that are still in different components meet further hubs, more each
round, until no bucket has a pair that is neither confirmed, refused, nor joined through
others. Which members are hubs follows from a hash of the id and the size of the bucket, so no
bucket is sorted or numbered in one task, and a large one is dealt into cells, each with a copy
of the hubs. There numpy holds the longer signatures of members and hubs against each
other, block by block: of ``LONG`` coordinates (further shifts of the same permutation, one
bit each) a pair at the wanted similarity differs in more than ``_most_apart`` once in a million. Pairs
that pass are made in one of their buckets only (that of the least key both have) and proved
on their full sets. So a group of near copies costs about one comparison a member, not one for each pair.

Nulls: a null text is empty; rows with a null doc_id are left out (an id is
needed to be linked). Repeated rows of one doc_id count once: the row with the
smallest text that has a word. Extra columns are ignored here and kept by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.llm.common import components, free, staged
from strata.llm.tokens import grams, mix, pieces, powers

BANDS, ROWS = 32, 4
# Hubs of a bucket, about, in the second round; each later round has GROWTH times as many.
HUBS, GROWTH = 16, 128
# Members of a bucket, about, that meet its hubs in one place; each such cell gets a copy of the hubs.
CELL = 1024
# Coordinates of the longer signature, a multiple of 64.
LONG = 2048


def _sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and their offsets."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(offsets[-1], np.uint64)
    all_grams = grams(hashes, k)
    long = np.flatnonzero(n >= k)
    if len(long):
        at = np.repeat(first[:-1][long] - offsets[:-1][long], many[long])
        place = np.flatnonzero(np.repeat(n >= k, many))
        out[place] = all_grams[at + place]
    for t in np.flatnonzero((n > 0) & (n < k)):
        own = hashes[first[t] : first[t + 1]]
        out[offsets[t]] = mix((own * powers(k)[: len(own)]).sum(keepdims=True) ^ np.uint64(len(own)))[0]
    kept, sizes = [], np.zeros(len(n), np.int64)
    for t in range(len(n)):
        own = np.unique(out[offsets[t] : offsets[t + 1]])
        kept.append(own)
        sizes[t] = len(own)
    return (np.concatenate(kept) if kept else out), np.concatenate(([0], np.cumsum(sizes)))


def _signatures(values: np.ndarray, offsets: np.ndarray, begin: int = 0, end: int = BANDS * ROWS) -> np.ndarray:
    """Circulant signature of each nonempty set: coordinates ``begin`` to ``end``."""
    # The first permutation: a bijection of the 32-bit universe.
    x = (values >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    full = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(full), end - begin), np.uint32)
    for j in range(begin, end):
        # The second permutation, shifted circularly by j.
        y = x + np.uint32(j * 0x9E3779B1 & 0xFFFFFFFF)
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x21F0AAAD)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x735A2D97)
        y ^= y >> np.uint32(15)
        out[:, j - begin] = np.minimum.reduceat(y, full) if len(full) else 0
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in pieces(batch.column(1), lower=True):
                values, offsets = _sets(words.hashes(), words.first, k)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                bands = _signatures(values, offsets).reshape(len(full), BANDS, ROWS).astype(np.uint64)
                keys = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(31) + bands[:, :, r] + np.uint64(1))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                flat = pa.array(keys.reshape(-1).view(np.int64))
                many = np.zeros(hi - lo, np.int64)
                many[full] = BANDS
                at = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                # Two sums over the set's mixed values name it.
                name = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    name[full, 0] = np.add.reduceat(values, offsets[:-1][full])
                    name[full, 1] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array(name[:, 0].view(np.int64)),
                        pa.array(name[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(at, flat),
                    ],
                    ["doc_id", "n_shingles", "name_1", "name_2", "keys"],
                )

    return run


def _marked(k: int):
    """(x, n_shingles, bits): one bit of each coordinate of the longer signature, 64 in a number; rows (doc_id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(64, dtype=np.uint64)
        for batch in batches:
            sets = batch.column(1)
            ends = sets.offsets.to_numpy()
            for lo in range(0, batch.num_rows, 64):
                hi = min(batch.num_rows, lo + 64)
                values = sets.values.to_numpy(zero_copy_only=False)[ends[lo] : ends[hi]].view(np.uint64)
                packed = np.empty((hi - lo, LONG // 64), np.uint64)
                for i in range(LONG // 64):
                    begin = BANDS * ROWS + 64 * i
                    bit = _signatures(values, ends[lo : hi + 1] - ends[lo], begin, begin + 64).astype(np.uint64) & np.uint64(1)
                    packed[:, i] = (bit << place).sum(1, dtype=np.uint64)
                at = pa.array((np.arange(hi - lo + 1) * (LONG // 64)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(ends[lo : hi + 1]).astype(np.int64)),
                        pa.ListArray.from_arrays(at, pa.array(packed.reshape(-1).view(np.int64))),
                    ],
                    ["x", "n_shingles", "bits"],
                )

    return run


def _most_apart(percent: int) -> int:
    """Coordinates in which the longer signatures of a pair at ``percent`` differ at most, but for one in a million."""
    differs = (100 - percent) / 200
    return min(LONG, math.ceil(LONG * differs + 5 * math.sqrt(LONG * differs * (1 - differs))))


# Pairs of a cell's members and hubs that are held against each other at once.
_BLOCK = 1 << 16


def _meet(percent: int):
    """Pairs (a, b) of a cell's hubs and members that may be links.

    Rows (key, cell, member, x, component, n_shingles, draw, bits, keys), sorted by the first three:
    a cell's hubs come before its members.
    """
    most = _most_apart(percent)

    def block(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        plain = [rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)]
        wide = [rows.column(i).flatten().to_numpy(zero_copy_only=False) for i in (7, 8)]
        return (*plain, wide[0].view(np.uint64).reshape(-1, LONG // 64), wide[1].reshape(-1, BANDS))

    def pairs(key: int, hubs: list[tuple], members: tuple) -> Iterator[pa.RecordBatch]:
        for x, c, n, draw, bits, keys in hubs:
            step = max(1, _BLOCK // len(x))
            for lo in range(0, len(members[0]), step):
                y, d, m, own, marks, bands = (part[lo : lo + step] for part in members)
                # Each pair once: the one drawn first is its hub.
                good = (own[:, None] > draw) | ((own[:, None] == draw) & (y[:, None] > x))
                good &= d[:, None] != c
                good &= 100 * np.minimum(m[:, None], n) >= percent * np.maximum(m[:, None], n)
                i, j = np.nonzero(good)
                apart = np.zeros(len(i), np.int64)
                for at in range(0, len(i), 1 << 14):
                    some = slice(at, at + (1 << 14))
                    apart[some] = np.bitwise_count(marks[i[some]] ^ bits[j[some]]).sum(1)
                i, j = i[apart <= most], j[apart <= most]
                # In one bucket only, that of the least key both have.
                both = np.where(bands[i] == keys[j], bands[i], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                i, j = i[both == key], j[both == key]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(y[i], x[j])), pa.array(np.maximum(y[i], x[j]))], ["a", "b"]
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fresh = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (member[1:] != member[:-1])
            bounds = np.concatenate(([0], np.flatnonzero(fresh) + 1, [len(key)]))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (key[lo], cell[lo]) != at:
                    at, hubs = (key[lo], cell[lo]), []
                if not member[lo]:
                    hubs.append(block(batch.slice(lo, hi - lo)))
                elif hubs:
                    yield from pairs(key[lo], hubs, block(batch.slice(lo, hi - lo)))

    return run


def _held(k: int):
    """(doc_id, shingles): each text's set of shingle hashes, sorted; rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in pieces(batch.column(1), lower=True):
                values, offsets = _sets(words.hashes(), words.first, k)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """(a, b, linked) of the pairs (a, b, set_a, set_b): whether the sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                ends = batch.column(c).offsets.to_numpy()
                sides.append((batch.column(c).values.to_numpy(zero_copy_only=False), ends[:-1], ends[1:]))
            (left, a, b), (right, c, d) = sides
            good = []
            for s, e, t, u in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
                if min(e - s, u - t) * 100 < percent * max(e - s, u - t):
                    good.append(False)
                    continue
                both = len(np.intersect1d(left[s:e], right[t:u], assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (e - s + u - t - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def _contracted(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """``pairs`` with ``c`` and ``d``, the components that ``a`` and ``b`` are in so far."""
    of_a = joined.select(F.col("id").alias("a"), F.col("component").alias("c"))
    of_b = joined.select(F.col("id").alias("b"), F.col("component").alias("d"))
    both = pairs.join(of_b, "b", "left").join(of_a, "a", "left")
    return both.withColumns({"c": F.coalesce("c", "a"), "d": F.coalesce("d", "b")})


def _joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components after ``links``: only components that a link touches are joined anew."""
    between = _contracted(links, joined).where("c <> d").select("c", "d").distinct()
    moved = staged(components(between, "c", "d", "minhash-star"), "minhash-moved")
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    kept = joined.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    every = kept.unionByName(moved).groupBy("id").agg(F.min("component").alias("component"))
    return staged(every, "minhash-components")


def _chosen(documents: DataFrame) -> DataFrame:
    """One row (doc_id, text) for each doc_id: sketches and proofs are all of its text."""
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = staged(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "minhash-again")
    # Ids that come once (as a rule all) keep their row where it is.
    full = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text"))
    one = texts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(full).alias("text"))
    return texts.join(again, "doc_id", "left_anti").unionByName(one)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per doc_id: ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``."""
    texts = _chosen(documents)
    sketch = staged(
        texts.mapInArrow(
            _sketch(k), "doc_id bigint, n_shingles bigint, name_1 bigint, name_2 bigint, keys array<bigint>"
        ),
        "minhash-sketch",
    )
    name = ["n_shingles", "name_1", "name_2"]
    classes = staged(
        sketch.where("n_shingles > 0").groupBy(*name).agg(F.min("doc_id").alias("rep")), "minhash-classes"
    )
    # Buckets of at least two classes.
    rows = sketch.join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(
        F.col("doc_id").alias("x"), F.explode("keys").alias("key")
    )
    hubs = rows.groupBy("key").agg(F.min("x").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(rows.join(hubs.select("key", "hub", "n"), "key"), "minhash-buckets")
    # Each hub's pairs; the sets of all that are in a bucket.
    pairs = members.where("x <> hub").select(F.col("hub").alias("a"), F.col("x").alias("b")).distinct()
    needed = members.select(F.col("x").alias("doc_id")).distinct()
    held = staged(texts.join(needed, "doc_id").mapInArrow(_held(k), "doc_id bigint, shingles array<bigint>"), "minhash-sets")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The proved links and their number."""
        left = held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        right = held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
        seen = Observation()
        links = both.mapInArrow(_confirm(percent), "a bigint, b bigint, linked boolean").where("linked").select("a", "b")
        links = staged(links.observe(seen, F.count(F.lit(1)).alias("n")), "minhash-links")
        return links, seen.get["n"]

    joined = staged(components(confirmed(pairs)[0], "a", "b", "minhash-star"), "minhash-components")
    # Only buckets of three and more can hold a pair that has not met.
    open_rows, marks = members.where("n > 2").select("key", "x", "n"), None
    made, size = 0, HUBS
    while True:
        now = open_rows.join(joined, open_rows["x"] == joined["id"], "left").select(
            "key", "x", "n", F.coalesce("component", "x").alias("component")
        )
        mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        mixed = mixed.where("least <> most").select("key")
        left = staged(now.where(f"n > {made}").join(mixed, "key"), "minhash-open")
        if left.isEmpty():
            break
        if marks is None:
            ids = left.select(F.col("x").alias("doc_id")).distinct()
            marks = held.join(ids, "doc_id").mapInArrow(_marked(k), "x bigint, n_shingles bigint, bits array<bigint>")
            marks = staged(marks.join(sketch.select(F.col("doc_id").alias("x"), "keys"), "x"), "minhash-marks")
        marked = left.withColumn("draw", F.xxhash64("x")).join(marks, "x")
        cells = F.ceil(F.col("n") / CELL)
        # The hubs of a bucket: those whose draw, as a share of all, is under size / n (and was not before).
        share = F.expr(f"(draw / {2.0**64}D + 0.5D) * n")
        own = ["x", "component", "n_shingles", "draw", "bits", "keys"]
        hubs = marked.where((share >= made) & (share < size)).select(
            "key", F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1)).alias("cell"), F.lit(False).alias("member"), *own
        )
        others = marked.where(share >= made).select("key", F.pmod("draw", cells).alias("cell"), F.lit(True).alias("member"), *own)
        dealt = hubs.unionByName(others).repartition("key", "cell").sortWithinPartitions("key", "cell", "member")
        fresh = staged(dealt.mapInArrow(_meet(percent), "a bigint, b bigint"), "minhash-pairs")
        links, linked = confirmed(fresh)
        if linked:
            joined = _joined_further(joined, links)
        open_rows = left.select("key", "x", "n")
        made, size = size, size * GROWTH
    of_class = classes.join(joined, classes["rep"] == joined["id"], "left").select(
        *name, F.coalesce("component", "rep").alias("component_id")
    )
    out = sketch.select("doc_id", *name).join(of_class, name, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def keep_first(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays.

    Rows with a null doc_id stay; repeated rows of a kept doc_id all stay.
    """
    (kept_id,) = free(documents.columns, "_kept_id")
    kept = near_duplicates(documents, k, percent).where("kept").select(F.col("doc_id").alias(kept_id))
    known = documents.join(kept, documents["doc_id"].cast("bigint") == kept[kept_id], "left_semi")
    return known.unionByName(documents.where("doc_id IS NULL"))


def keep_first_of_all(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """As ``keep_first``, but rows with a null doc_id are decided, too.

    Their text's hash gives them a key over all ids (63 bits, less what the ids take), so
    they give way to near copies that have an id; of equal texts without an id the least row stays.
    """
    nulls, most = documents.agg(F.count_if(F.col("doc_id").isNull()), F.max(F.col("doc_id").cast("bigint"))).first()
    if not nulls:
        return keep_first(documents, k, percent)
    begin = 0 if most is None else most + 1
    hashed = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit((1 << 63) - 1 - begin)) + F.lit(begin)
    key, full, row = free(documents.columns, "_key", "_full", "_row")
    keyed = documents.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), hashed))
    kept = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k, percent).where("kept")
    rows = keyed.join(kept.select(F.col("doc_id").alias(key), (F.col("n_shingles") > 0).alias(full)), key)
    # The least row by its JSON, which any type of column has.
    whole = F.struct(*documents.columns)
    one = rows.where(F.col("doc_id").isNull() & F.col(full)).groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    others = rows.where(F.col("doc_id").isNotNull() | ~F.col(full)).select(*documents.columns)
    return others.unionByName(one.select(f"{row}.*"))
