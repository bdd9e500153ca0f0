"""Phrase collocations, counted with double-array tries of Apriori-safe candidates.

Texts (A-Z lower-cased) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``. Within a language (null: ``und``) a candidate is a phrase of 2 to
``LONGEST`` words of one piece that occurs ``least`` times, overlaps included.

1. Words are counted, and each text becomes the list of its frequent words' 64-bit symbols; all
   else is one 0, over which no phrase reaches.
2. Level by level, only phrases whose two parts (without the last, without the first word)
   are frequent are looked at (Apriori): tasks sum them up by a 64-bit key, and keys that reach
   ``least`` in all tasks together go into the level's filter, a bitmap of fixed size that
   every task gets. A filter may let a rare phrase pass, never hold a frequent one back.
3. The phrases that pass all filters are the candidates. They are dealt by hash into shards of about
   ``SHARD`` phrases; one task builds a shard's double-array trie (language, then words).
4. Each trie is broadcast in turn. A task advances the states of all positions of its texts
   by one word at a time, all at once in numpy, and counts accepting states with a bincount; the
   tasks' counts are summed. These counts, and no others, are the phrases' frequencies.
5. Every cut of a candidate gets its score ``floor(1000 * a * n / (l * r))`` in exact decimals (38 digits;
   a under 10^15); the lowest counts, ties to the shortest first part. A candidate within a longer
   one that is as frequent is dropped: if any holds it, one that is one word longer does.
6. Each language's first ``top`` by score and frequency (both descending), then phrase in UTF-8 byte order.

Nothing that grows with the texts is broadcast: filters have a fixed size, a trie a
bounded number of phrases. A frequent phrase costs one row for each batch of texts.

A null or empty text has no words; repeated rows count each time; other columns are ignored;
an empty table gives an empty result. Words are told apart by their 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import staged
from strata.llm.tokens import _LOWER, _utf8, mix, powers

LONGEST = 5
# What ends a piece, and what else ends a word.
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _CUT.copy()
_GAP[list(b" \t")] = True
UNKNOWN = "und"

# Bytes of text that a task holds in arrays at once, or one text.
PIECE = 4 << 20
# A filter has 2^FILTER_BITS bits.
FILTER_BITS = 26
# Phrases of a trie, about.
SHARD = 1 << 20
# Symbols of a row, about: rows of a bounded size keep the batches that tasks get small.
ROW = 64
# Keys that a task remembers, about.
REMEMBERED = 1 << 22

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Cut:
    """The words of some texts: their bytes without gaps, whose they are, where no phrase goes on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        n = len(data)
        gap = _GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = ~gap
        first = word.copy()
        first[1:] &= gap[:-1] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        place = np.cumsum(word, dtype=np.int32)
        at = np.concatenate((place[self.starts] - 1, [place[-1] if n else 0]))
        self.bytes, self.offsets = data[word], at.astype(np.int64)
        #: The words of text t are those from first[t] to first[t + 1].
        self.first = np.searchsorted(self.starts, offsets)
        # A word that does not go on the one before it: a cut or a border lies between.
        cuts = np.cumsum(_CUT[data], dtype=np.int32)
        self.fresh = np.ones(len(self.starts), bool)
        if len(self.starts):
            self.fresh[1:] = cuts[self.starts[1:]] > cuts[self.starts[:-1]]
            border = self.first[:-1]
            self.fresh[border[border < len(self.starts)]] = True

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's code, and the words that the codes stand for."""
        array = pa.Array.from_buffers(
            pa.large_string(), len(self.starts), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.bytes)]
        ).dictionary_encode()
        return array.indices.to_numpy(zero_copy_only=False), array.dictionary


def _symbols(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word (none of them empty), never 0."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, at = _utf8(words)
    lengths = np.diff(at)
    data = data[at[0] : at[-1]]
    begin = at[:-1] - at[0]
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return np.maximum(mix(np.add.reduceat(value, begin)), np.uint64(1))


def _tongue(lang: str) -> np.uint64:
    """The symbol of a language."""
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") | 1)


def _next(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The keys of phrases one word longer."""
    return mix(key * _STEP + symbol)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Cut, np.ndarray, list[str]]]:
    """Rows (lang, text), some at a time: their words, each text's language as a number, and the languages."""
    langs = batch.column(0).cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    names = langs.dictionary.to_pylist()
    of = langs.indices.to_numpy(zero_copy_only=False)
    data, at = _utf8(batch.column(1))
    lo = 0
    while lo < len(of):
        hi = min(len(of), max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1))
        yield Cut(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), of[lo:hi], names
        lo = hi


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, symbol, key, n) for the words of each part; a null word for all words of a language."""
    for batch in batches:
        for cut, of, names in _parts(batch):
            code, words = cut.distinct()
            if not len(code):
                continue
            lang = np.repeat(of, np.diff(cut.first)).astype(np.int64)
            pair, n = np.unique(lang * len(words) + code, return_counts=True)
            own, word = np.divmod(pair, len(words))
            symbol = _symbols(words)[word]
            key = _next(np.array([_tongue(x) for x in names], np.uint64)[own], symbol)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()).take(pa.array(own)),
                    words.cast(pa.string()).take(pa.array(word)),
                    pa.array(symbol.view(np.int64)),
                    pa.array(key.view(np.int64)),
                    pa.array(n),
                ],
                ["lang", "word", "symbol", "key", "n"],
            )
            total = np.bincount(lang, minlength=len(names))
            none = pa.nulls(len(names), pa.string())
            zero = pa.array(np.zeros(len(names), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), none, zero, zero, pa.array(total)], ["lang", "word", "symbol", "key", "n"]
            )


class Filter:
    """A bitmap of 64-bit keys by their highest bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From a column ``key``; at most 2^(FILTER_BITS - 6) numbers come to the driver, whatever the rows."""
        bit = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit & 63 AS INT))")
        found = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bits[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return cls(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> np.uint64(64 - FILTER_BITS)
        return (self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _to_symbols(words: Filter):
    """(lang, symbols) of the texts' frequent words, in rows of about ``ROW``; 0 between what no phrase reaches over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, of, names in _parts(batch):
                code, distinct = cut.distinct()
                if not len(code):
                    continue
                own = _symbols(distinct)
                lang = np.repeat(of, np.diff(cut.first))
                symbol = own[code]
                key = _next(np.array([_tongue(x) for x in names], np.uint64)[lang], symbol)
                good = words.has(key)
                # A 0 before each word that begins a piece; rare words are 0; zeros in a row are one.
                n = len(symbol)
                at = np.arange(n) + np.cumsum(cut.fresh)
                out = np.zeros(n + int(cut.fresh.sum()), np.uint64)
                out[at] = np.where(good, symbol, np.uint64(0))
                keep = out != 0
                zero = ~keep
                keep[1:] |= zero[1:] & ~zero[:-1]
                keep[0] = True
                # Rows end where a text does, and at the first 0 behind every ROW symbols.
                bounds = np.concatenate((at - cut.fresh, [len(out)]))[cut.first]
                total = np.concatenate(([0], np.cumsum(keep)))
                values = out[keep]
                zeros = np.concatenate((np.flatnonzero(values == 0), [len(values)]))
                inner = zeros[np.searchsorted(zeros, np.arange(0, len(values), ROW))]
                offsets = np.unique(np.concatenate((total[bounds], inner, [0, len(values)])))
                own = np.searchsorted(total[bounds], offsets[:-1], "right") - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                known = np.concatenate(([0], np.cumsum(values != 0)))[offsets]
                rows = [pa.array(names, pa.string()).take(pa.array(of[np.clip(own, 0, len(of) - 1)])), lists]
                yield pa.RecordBatch.from_arrays(rows, ["lang", "symbols"]).take(pa.array(np.flatnonzero(np.diff(known))))

    return run


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Rows (lang, symbols), some at a time: all symbols with a 0 after each text, their language's number, the languages."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    of = langs.indices.to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    lo = 0
    while lo < len(of):
        hi = min(len(of), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE // 8, "right")) - 1))
        size = np.diff(offsets[lo : hi + 1])
        many = int(size.sum())
        at = np.arange(many) + np.repeat(np.arange(hi - lo), size)
        symbol = np.zeros(many + hi - lo, np.uint64)
        symbol[at] = values[offsets[lo] : offsets[hi]]
        yield symbol, np.repeat(of[lo:hi], size + 1), names
        lo = hi


def _alive(symbol: np.ndarray, lang: np.ndarray, names: list[str], filters: list[Filter], level: int):
    """For each level up to ``level``: the positions of phrases whose parts are frequent, and their keys.

    ``filters`` holds the filters of levels 2, 3 ...; a level that has one yields only what passes it.
    """
    at = np.flatnonzero(symbol)
    key = _next(np.array([_tongue(x) for x in names], np.uint64)[lang[at]], symbol[at])
    for j in range(2, level + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, key = at[both], _next(key[both], symbol[at[both] + j - 1])
        if j - 2 < len(filters):
            good = filters[j - 2].has(key)
            at, key = at[good], key[good]
        yield j, at, key


def _count_level(filters: list[Filter], level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol, lang, names in _flat(batch):
                *_, (_, _, key) = _alive(symbol, lang, names, filters, level)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def _candidates(filters: list[Filter]):
    """(lang, phrase) once for each task and phrase of two and more words that passes all filters.

    A task remembers the keys it has returned, up to ``REMEMBERED``; beyond these it may return one again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for symbol, lang, names in _flat(batch):
                fresh = []
                for j, at, key in _alive(symbol, lang, names, filters, len(filters) + 1):
                    key, first = np.unique(key, return_index=True)
                    there = np.searchsorted(seen, key)
                    new = np.ones(len(key), bool)
                    new[there < len(seen)] = seen[there[there < len(seen)]] != key[there < len(seen)]
                    at = at[first[new]]
                    fresh.append(key[new])
                    phrases = symbol[at[:, None] + np.arange(j)].reshape(-1).view(np.int64)
                    offsets = pa.array((np.arange(len(at) + 1) * j).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.string()).take(pa.array(lang[at])),
                            pa.ListArray.from_arrays(offsets, pa.array(phrases)),
                        ],
                        ["lang", "phrase"],
                    )
                seen = np.sort(np.concatenate([seen if len(seen) < REMEMBERED else seen[:0], *fresh]))

    return run


class Trie:
    """A double-array trie of rows of symbols, the language's first.

    ``alphabet`` holds the symbols in order; a symbol's number is its place there from 1. The child
    of the state s by number c is ``base[s] + c`` if ``check`` there is s. ``place`` is the row that
    ends in a state, or -1.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray, place: np.ndarray):
        self.alphabet, self.base, self.check, self.place = alphabet, base, check, place

    @classmethod
    def build(cls, rows: np.ndarray) -> Trie:
        """``rows``: distinct, one symbol a column, 0 after the last."""
        alphabet = np.unique(rows)
        alphabet = alphabet[alphabet != 0]
        number = np.where(rows == 0, 0, np.searchsorted(alphabet, rows) + 1)
        order = np.lexsort(number.T[::-1])
        number = number[order]
        # Nodes, level by level: prefixes, of which each is new in one row of the order.
        parents, symbols, ends = [], [], np.full(len(rows), -1)
        up = np.zeros(len(rows), np.int64)
        changed = np.zeros(len(rows), bool)
        if len(rows):
            changed[0] = True
        nodes = 1
        for d in range(rows.shape[1]):
            changed[1:] |= number[1:, d] != number[:-1, d]
            here = number[:, d] > 0
            new = changed & here
            own = nodes - 1 + np.cumsum(new)
            parents.append(up[new])
            symbols.append(number[new, d])
            ends[here] = own[here]
            up = np.where(here, own, up)
            nodes += int(new.sum())
        parent = np.concatenate([[0], *parents]).astype(np.int64)
        symbol = np.concatenate([[0], *symbols]).astype(np.int64)
        base_of = _bases(parent, symbol, nodes)
        slot = np.zeros(nodes, np.int64)
        slot[1:] = base_of[parent[1:]] + symbol[1:]
        size = int(slot.max()) + 1
        base, check, place = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        base[slot] = base_of
        check[slot[1:]] = slot[parent[1:]]
        place[slot[ends]] = order
        return cls(alphabet, base.astype(np.int32), check.astype(np.int32), place.astype(np.int32))

    def numbers(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols' numbers; 0 for one that is not in the trie."""
        if not len(self.alphabet):
            return np.zeros(len(symbol), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, symbol), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbol, at + 1, 0)

    def step(self, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a child by their number, and these children."""
        to = self.base[state] + number
        good = (number > 0) & (to >= 0) & (to < len(self.check))
        good[good] = self.check[to[good]] == state[good]
        return good, to[good]

    def packed(self) -> bytes:
        parts = [self.alphabet.astype("<u8"), self.base, self.check, self.place]
        head = np.array([len(x) for x in parts], "<i8").tobytes()
        return head + b"".join(x.astype(x.dtype.newbyteorder("<")).tobytes() for x in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        sizes, at, parts = np.frombuffer(data, "<i8", 4), 32, []
        for n, kind in zip(sizes, ("<u8", "<i4", "<i4", "<i4"), strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        return cls(*parts)


def _bases(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> np.ndarray:
    """A base for each node such that no two nodes' children share a slot; slot 0 is the root's."""
    order = np.argsort(parent[1:], kind="stable") + 1
    owner, begin, many = np.unique(parent[order], return_index=True, return_counts=True)
    base = np.zeros(nodes, np.int64)
    free = np.ones(2 * nodes + int(symbol.max(initial=0)) + 2, bool)
    free[0] = False
    low = 1
    # Those with the most children first, each behind the one before; what is left over holds the single ones.
    for g in np.argsort(-many, kind="stable"):
        if many[g] == 1:
            break
        children = np.sort(symbol[order[begin[g] : begin[g] + many[g]]])
        window = int(np.clip((1 << 16) // many[g], 16, 512))
        while True:
            while low + window + children[-1] - children[0] >= len(free):
                free = np.concatenate((free, np.ones(len(free), bool)))
            at = low + np.flatnonzero(free[low : low + window])
            hit = np.flatnonzero(free[at[:, None] + (children - children[0])].all(1))
            if len(hit):
                low = int(at[hit[0]])
                break
            low += window
        base[owner[g]] = low - children[0]
        free[low + (children - children[0])] = False
    single = many == 1
    left = np.flatnonzero(free)
    if single.sum() > len(left):
        left = np.concatenate((left, np.arange(len(free), len(free) + int(single.sum()))))
    base[owner[single]] = left[: int(single.sum())] - symbol[order[begin[single]]]
    return base


def _tries(table: pa.Table) -> pa.Table:
    """A shard's phrases with their places in its trie, and one row that has the trie."""
    langs, phrases = table["lang"].to_pylist(), table["phrase"].combine_chunks()
    sizes = np.diff(phrases.offsets.to_numpy())
    rows = np.zeros((len(langs), LONGEST + 1), np.uint64)
    known = {x: _tongue(x) for x in set(langs)}
    rows[:, 0] = [known[x] for x in langs]
    own = np.repeat(np.arange(len(langs)), sizes)
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[own, at + 1] = phrases.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    n, shard = len(langs), table["shard"][0].as_py()
    return pa.table(
        {
            "shard": pa.array([shard] * (n + 1), pa.int64()),
            "place": pa.array([*range(n), None], pa.int64()),
            "lang": pa.array([*langs, None], pa.string()),
            "phrase": pa.concat_arrays([phrases, pa.nulls(1, phrases.type)]),
            "trie": pa.array([*[None] * n, Trie.build(rows).packed()], pa.binary()),
        }
    )


def _count_phrases(shared, shard: int):
    """(shard, place, n) of the phrases of one trie in all texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.unpacked(shared.value)
        total = np.zeros(int(trie.place.max(initial=-1)) + 1, np.int64)
        for batch in batches:
            for symbol, lang, names in _flat(batch):
                number = trie.numbers(symbol)
                tongue = trie.numbers(np.array([_tongue(x) for x in names], np.uint64))
                at = np.flatnonzero(number)
                good, state = trie.step(np.zeros(len(at), np.int64), tongue[lang[at]])
                at = at[good]
                for j in range(LONGEST):
                    # Every text has a 0 at its end, so no phrase goes on into the next.
                    inside = at + j < len(number)
                    at, state = at[inside], state[inside]
                    good, state = trie.step(state, number[at + j])
                    at = at[good]
                    place = trie.place[state]
                    total += np.bincount(place[place >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), shard)), pa.array(some), pa.array(total[some])], ["shard", "place", "n"]
        )

    return run


def frequent_phrases(documents: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to ``LONGEST`` words with f >= least, (lang, word, symbol, n)).

    A phrase is the array of its words' symbols. The second table has the frequent words and,
    with a null word, the number of all words of a language.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(_count_words, "lang string, word string, symbol bigint, key bigint, n bigint")
    words = words.groupBy("lang", "word", "symbol", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = staged(words, "phrases-words")
    own = words.where("word IS NOT NULL")
    symbols = staged(texts.mapInArrow(_to_symbols(Filter.of(own)), "lang string, symbols array<bigint>"), "phrases-symbols")
    filters: list[Filter] = []
    for level in range(2, LONGEST + 1):
        counts = symbols.mapInArrow(_count_level(filters, level), "key bigint, n bigint")
        keys = counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
        filters.append(Filter.of(keys))
        if not filters[-1].bits.any():
            break
    # Tasks return a row for each candidate: as many tasks as cores, however many texts.
    cores = spark.sparkContext.defaultParallelism
    found = symbols.coalesce(cores).mapInArrow(_candidates(filters), "lang string, phrase array<bigint>").distinct()
    found = staged(found.unionByName(own.select("lang", F.array("symbol").alias("phrase"))), "phrases-candidates")
    shards = -(-found.count() // SHARD)
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, shards))))
    built = dealt.groupBy("shard").applyInArrow(
        _tries, "shard bigint, place bigint, lang string, phrase array<bigint>, trie binary"
    )
    built = staged(built, "phrases-tries")
    counted = []
    for shard in range(shards):
        # One trie at a time: of bounded size here and in the tasks.
        trie = built.where((F.col("shard") == shard) & F.col("trie").isNotNull()).select("trie").first()
        if trie is None:
            continue
        shared = spark.sparkContext.broadcast(bytes(trie[0]))
        part = symbols.coalesce(cores).mapInArrow(_count_phrases(shared, shard), "shard bigint, place bigint, n bigint")
        part = part.groupBy("shard", "place").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        place = built.where(F.col("shard") == shard).where("place IS NOT NULL").select("place", "lang", "phrase")
        counted.append(staged(place.join(part, "place").select("lang", "phrase", "f"), "phrases-counted"))
        shared.destroy()
    if not counted:
        return spark.createDataFrame([], "lang string, phrase array<bigint>, f bigint"), words
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out, words


def collocations(documents: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    counts, words = frequent_phrases(documents, least)
    totals = words.where("word IS NULL").select(F.col("lang").alias("of"), "n")
    size = F.size("phrase")
    long = counts.where(size >= 2).select("lang", "phrase", F.col("f").alias("a"))
    part = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")

    def with_count(rows: DataFrame, piece: str, name: str) -> DataFrame:
        same = (F.col("lang") == F.col("of")) & (F.col(piece) == F.col("part"))
        return rows.join(part, same).select(*rows.columns, F.col("f").alias(name)).drop(piece)

    cuts = long.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("front", F.slice("phrase", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("back", F.slice("phrase", F.col("k") + 1, size - F.col("k")))
    cuts = with_count(with_count(cuts, "front", "l"), "back", "r")
    cuts = cuts.join(totals, F.col("lang") == F.col("of")).drop("of")
    wide = "CAST({} AS DECIMAL({},0))".format
    score = F.expr(
        f"({wide('a * 1000', 18)} * {wide('n', 19)}) div ({wide('l', 18)} * {wide('r', 18)})"
    ).alias("score")
    scored = cuts.select("lang", "phrase", "a", F.struct(score, "k", "l", "r", "n").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.*")
    # What a phrase that is one word longer holds, and how often that comes.
    inner = long.where(size >= 3).select(
        F.col("lang").alias("of"),
        F.col("a").alias("outer"),
        F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("part"),
    )
    inner = inner.groupBy("of", "part").agg(F.max("outer").alias("outer"))
    same = (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (F.col("outer") >= F.col("a"))
    scored = scored.join(inner, same, "left_anti")
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    scored = staged(scored.withColumn("tied", F.rank().over(first)).where(F.col("tied") <= top), "phrases-scored")
    # The words themselves, for the phrases that may be among the first.
    spelled = scored.select("lang", "phrase", F.posexplode("phrase").alias("i", "symbol")).join(
        words.where("word IS NOT NULL").select(F.col("lang").alias("of"), F.col("symbol").alias("own"), "word"),
        (F.col("lang") == F.col("of")) & (F.col("symbol") == F.col("own")),
    )
    spelled = spelled.groupBy("lang", "phrase").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("text")
    )
    out = scored.join(spelled, ["lang", "phrase"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "text"))
    out = out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return out.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


# DuckDB SQL for collocations(documents).
ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
),
pieces AS (
  SELECT lang, d, unnest(range(len(pieces))) AS p, string_split_regex(unnest(pieces), '[\\x20\\x09]+') AS words FROM docs
),
words AS (
  SELECT lang, d, p, i, w FROM (
    SELECT lang, d, p, unnest(range(len(words))) AS i, unnest(words) AS w FROM pieces
  ) x WHERE w <> ''
),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)
),
counts AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, [w1] AS phrase FROM ahead
    UNION ALL SELECT lang, [w1, w2] FROM ahead WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3] FROM ahead WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3, w4] FROM ahead WHERE w4 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM ahead WHERE w5 IS NOT NULL
  ) x GROUP BY lang, phrase HAVING count(*) >= 100
),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
long AS (SELECT lang, phrase, f AS a FROM counts WHERE len(phrase) >= 2),
cuts AS (SELECT lang, phrase, a, unnest(range(1, len(phrase))) AS k FROM long),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[:c.k]
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1:]
  JOIN totals t ON t.lang = c.lang
),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_ AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, phrase[:len(phrase) - 1] AS part FROM long WHERE len(phrase) >= 3
    UNION ALL SELECT lang, a, phrase[2:] FROM long WHERE len(phrase) >= 3
  ) x GROUP BY lang, part
),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.part = b.phrase
  WHERE i.longer IS NULL OR i.longer < b.a
),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
         array_to_string(phrase, ' ') AS phrase, a, l, r, n, score
  FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""
