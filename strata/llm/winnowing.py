"""Document fingerprints by winnowing.

The query winnows characters (``of_characters``): the text in lower case without its
separators, each ``CHARS`` consecutive characters one k-gram, windows of ``CHAR_WINDOW``.
Two texts that share a run of ``CHARS + CHAR_WINDOW - 1`` such characters share a
fingerprint. A text of fewer than ``SHORT`` such characters has too few windows
to be told from others: ``CHARS - 1`` characters that occur in no text are put before and
behind it, and all its k-grams are chosen, so that one with any character left at
its beginning or end is found again. Which form a text has follows from its length alone.

``of_words`` is the coarse form, on words as they are: the words of a text are hashed,
and each ``K`` consecutive ones make a k-gram hash; two texts need a common run of
``K + WINDOW - 1`` words to be sure of a common fingerprint.

In both, of each window of consecutive k-grams the one with the least
hash is chosen, of equal ones the rightmost. Neighbouring windows mostly choose
the same k-gram, which counts once, with its position.

A hash and its position are one number: the hash above, the position counted
down below, so that the least number is the least hash and, of equal ones, the
rightmost. The least of a window comes from two windows of half its width.
All of it is array code within a row: no row meets another but its neighbour.

A text with fewer words than ``K`` has one k-gram of all its words; with fewer
k-grams than a window, one window holds all. No word: an empty fingerprint.
Null texts count as empty. Positions over 2**25 - 1 count as that.
The likeness of two fingerprints is the share of common hashes in all hashes of
either; two empty ones are alike (1).

The next document is the next row by doc_id (null first), after the last the
first; rows that share a doc_id follow one another by text. Rows are dealt into
ranges of doc_id that hold about ``RANGE_ROWS`` rows (the bounds, at most
``MAX_BOUNDS`` numbers, come from one aggregate), and each range also gets the
next one's first row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SEPARATORS, words

K, WINDOW = 4, 16
# Of characters; a power of two each, the window too.
CHARS, CHAR_WINDOW = 8, 8
# From so many characters on, the three quarters that an edit leaves hold a whole window.
SHORT = 32
RANGE_ROWS = 4_000
MAX_BOUNDS = 20_000
# Bits of a hash and of a position.
_BITS, _PLACES = 32, 25
_LAST = (1 << _PLACES) - 1


def _least(grams: Column, window: int) -> Column:
    """The chosen of an array (bound in a one-element array) of packed k-grams, by windows of a power of two."""

    def halves(width: int):
        def least(g: Column) -> Column:
            shifted = F.slice(g, width + 1, F.greatest(F.size(g) - width, F.lit(0)))
            return F.zip_with(g, shifted, lambda a, b: F.least(a, b))

        return least

    # Each step is bound by a one-element array, so that it is computed once.
    step, width = grams, 1
    while width < window:
        step = F.transform(step, halves(width))
        width *= 2
    windows = F.transform(step, lambda m: F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.lit(1))))
    return F.array_distinct(F.get(windows, F.lit(0)))


def of_words(text: Column) -> Column:
    """The chosen word k-grams of a text, in order: hash * 2**25 + (2**25 - 1 - position)."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    # With fewer than K words the missing ones are left out of the one k-gram.
    def gram(h: Column) -> Column:
        def at(i: Column) -> Column:
            hashed = F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), 64 - _BITS)
            return F.shiftleft(hashed, _PLACES) + (F.lit(_LAST) - F.least(i, F.lit(_LAST)))

        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - K, F.lit(0))), at)
        return F.when(F.size(h) == 0, none).otherwise(grams)

    return _least(F.transform(F.array(hashes), gram), WINDOW)


def of_characters(text: Column) -> Column:
    """The chosen character k-grams of a text, in order, packed as in ``of_words``; positions of a short text count its padding."""
    none = F.array().cast("array<bigint>")
    # Four bytes a character, so that the place of each is known.
    plain = F.encode(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, ""), "utf-32")
    pad = F.unhex(F.lit("FF" * 4 * (CHARS - 1)))

    def grams(b: Column) -> Column:
        def at(i: Column) -> Column:
            hashed = F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * CHARS)))
            return F.shiftrightunsigned(hashed, 64 - _BITS - _PLACES).bitwiseOR(F.lit(_LAST)) - F.least(i, F.lit(_LAST))

        return F.transform(F.sequence(F.lit(0), F.shiftright(F.length(b), 2) - CHARS), at)

    def chosen(b: Column) -> Column:
        padded = F.get(F.transform(F.array(F.concat(pad, b, pad)), grams), F.lit(0))
        return (
            F.when(F.length(b) == 0, none)
            .when(F.length(b) < 4 * SHORT, F.array_distinct(padded))
            .otherwise(_least(F.transform(F.array(b), grams), CHAR_WINDOW))
        )

    return F.get(F.transform(F.array(plain), chosen), F.lit(0))


def written(chosen: Column) -> Column:
    """A fingerprint as text: its numbers, each a hash and a position, in order."""
    return F.array_join(chosen.cast("array<string>"), " ")


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, _PLACES)))


def likeness(x: Column, y: Column) -> Column:
    """Of two hash sets."""
    both = F.size(F.array_intersect(x, y))
    all_of = F.size(x) + F.size(y)
    return F.when(all_of == 0, F.lit(1.0)).otherwise(both / (all_of - both))


def with_next(documents: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, next_text, chosen, hashes, next_hashes) for each row, in ranges of doc_id."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    total, nulls, least = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")
    ).first()
    ranges = max(1, min(MAX_BOUNDS, total // RANGE_ROWS))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    bounds = sorted({b for b in found or [] if least is not None and b > least}) if ranges > 1 else []
    own, after = F.lit(0), F.lit(False)
    if bounds:
        all_bounds = F.array(*[F.lit(b) for b in bounds])
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        own = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, s: F.when(
                (at + s <= len(bounds)) & (F.get(all_bounds, at + s - 1) <= F.col("doc_id")), at + s
            ).otherwise(at),
        )
        after = F.coalesce(F.get(all_bounds, F.col("_range") - 1) == F.col("doc_id"), F.lit(False))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    rows = rows.withColumn("_range", own)
    # 0: a row of the range; 1: the first of the next range; 2: the first of all, after the last.
    copies = F.filter(
        F.array(
            F.struct(F.col("_range").alias("at"), F.lit(0).alias("turn")),
            F.when(after, F.struct((F.col("_range") - 1).alias("at"), F.lit(1).alias("turn"))),
            F.when(first, F.struct(F.lit(len(bounds)).alias("at"), F.lit(2).alias("turn"))),
        ),
        lambda c: c.isNotNull(),
    )
    rows = rows.withColumn("_copy", F.explode(copies)).select("doc_id", "text", "_copy.at", "_copy.turn")
    order = "PARTITION BY at ORDER BY turn, doc_id, text"
    rows = rows.selectExpr("*", f"lead(text) OVER ({order}) AS next_text")
    rows = rows.withColumn("chosen", fingerprint(F.col("text"))).withColumn("hashes", hash_set(F.col("chosen")))
    rows = rows.selectExpr("*", f"lead(hashes) OVER ({order}) AS next_hashes")
    return rows.where("turn = 0").select("doc_id", "text", "next_text", "chosen", "hashes", "next_hashes")


def edited(text: Column, other: Column) -> Column:
    """The text with its last quarter replaced by as much of the other's beginning."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))


def fingerprints(documents: DataFrame, fingerprint: Callable[[Column], Column] = of_words) -> DataFrame:
    """Per row: its fingerprint, its edited text's, and their likeness."""
    rows = with_next(documents, fingerprint).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("_edited_chosen", fingerprint(F.col("_edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        written(F.col("chosen")).alias("fingerprint"),
        written(F.col("_edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hash_set(F.col("_edited_chosen"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
