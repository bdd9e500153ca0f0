"""Benchmark decontamination by spaced-seed hashing.

Words (lower-cased) are hashed. A mask is a short run of positions, some of
which are ignored; a seed is the hash of the words at a mask's other positions.
Seeds of all masks, at every position of every benchmark item, are joined with
those at every position of every document. Each hit gives an alignment of item
and document, which is verified word by word: a match counts 1, a substitution
-2, and the best-scoring stretch of the alignment must reach ``MIN_SCORE`` (or
all but 3 words of a shorter item). So a passage is found with substituted
words in it, while chance hits and short common phrases are not.

Everything is DataFrame code: positions are exploded and hashed within one
generated stage, and the seeds of the benchmark, counted first, are broadcast;
beyond ``MAX_SEEDS`` they are joined by shuffle, without the words. Documents are whole.
A hit keeps only the words that its item is laid over, and hits of one alignment become
one in the stage that finds them, so no text is held once for each hit in it.

Items with fewer words than the shortest mask covers are hits where a document holds
all their words in order; items of just as many words have a seed for each word
left out besides. Null or empty texts have no seed and are never a hit. Rows with a null doc_id are not
reported and are kept by ``clean``. Repeated documents give one row for each
(doc_id, item_id). Extra columns are ignored here and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import broadcast_within, free, staged, words

# 1 is looked at, 0 is ignored.
MASKS = ("1110111", "11011011", "10111101")
MIN_SCORE = 10
SUBSTITUTION = -2
SHORTEST = min(map(len, MASKS))
# Seeds of the benchmark (28 bytes each) that may be broadcast, and, counted by themselves, the words of its items.
MAX_SEEDS = 2_000_000


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _mask_seeds(hashes: str, at: str) -> list[Column]:
    """The seed of each mask at a position, null where it reaches over the end."""
    seeds = []
    for m, mask in enumerate(MASKS):
        looked = [F.get(F.col(hashes), F.col(at) + j) for j, c in enumerate(mask) if c == "1"]
        fits = F.col(at) + len(mask) <= F.size(hashes)
        seeds.append(F.when(fits, F.xxhash64(F.lit(m), *looked)))
    return seeds


def _short_seeds(hashes: str, at: str, lengths: list[int], whole: bool) -> list[Column]:
    """The seeds of windows as long as a short item (``whole``: of the text itself only) at a position.

    Windows of SHORTEST words have a seed for each word left out, shorter ones one of all their words.
    """
    seeds = []
    for n in lengths:
        fits = F.size(hashes) == n if whole else F.col(at) + n <= F.size(hashes)
        for out in range(n) if n == SHORTEST else (None,):
            looked = [F.get(F.col(hashes), F.col(at) + j) for j in range(n) if j != out]
            seeds.append(F.when(fits, F.xxhash64(F.lit(f"{n}:{out}"), *looked)))
    return seeds


def _exploded(df: DataFrame, hashes: str, at: str, shortest: int, seeds: list[Column]) -> DataFrame:
    """A row for each position and seed that there is: ``at``, seed.

    One explode of positions and one of seeds, joined on in the same generated stage, so that
    no row with a text's words is held but the one that is looked at.
    """
    df = df.where(F.size(hashes) >= shortest)
    df = df.withColumn(at, F.explode(F.sequence(F.lit(0), F.size(hashes) - shortest)))
    return df.withColumn("seed", F.explode(F.array(*seeds))).where("seed IS NOT NULL")


def _laid_over(doc: Column, shift: Column, length: Column) -> Column:
    """The words of the document that an item of ``length`` words is laid over from ``shift`` on; before the first there are none."""
    return F.slice(doc, F.greatest(shift, F.lit(0)) + 1, length + F.least(shift, F.lit(0)))


def _best(over: Column, item: Column, shift: Column) -> Column:
    """The best-scoring stretch of the item over the words under it (from ``shift`` on): (score, first, end)."""
    before = F.least(shift, F.lit(0))
    none = F.struct(
        F.lit(0).alias("now"), F.lit(0).alias("begin"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("end")
    )

    def step(s: Column, j: Column) -> Column:
        value = F.when(F.get(over, before + j) == F.get(item, j), F.lit(1)).otherwise(F.lit(SUBSTITUTION))
        now = F.greatest(F.lit(0), s["now"] + value)
        begin = F.when(s["now"] == 0, j).otherwise(s["begin"])
        more = now > s["best"]
        return F.struct(
            now.alias("now"),
            begin.alias("begin"),
            F.when(more, now).otherwise(s["best"]).alias("best"),
            F.when(more, begin).otherwise(s["first"]).alias("first"),
            F.when(more, j + 1).otherwise(s["end"]).alias("end"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), none, step)


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, score, first_word, n_words."""
    items = benchmark.select("item_id", _word_hashes(F.col("text")).alias("item")).where("item_id IS NOT NULL")
    items = staged(items.where(F.size("item") > 0).distinct(), "decontam-items")
    lengths = sorted(r[0] for r in items.where(F.size("item") <= SHORTEST).select(F.size("item")).distinct().collect())
    seeds = _exploded(items, "item", "j", SHORTEST, _mask_seeds("item", "j"))
    if lengths:
        short = items.withColumn("j", F.lit(0)).withColumn("seed", F.explode(F.array(*_short_seeds("item", "j", lengths, True))))
        seeds = seeds.unionByName(short.where("seed IS NOT NULL"))
    seeds = staged(seeds.select("seed", "item_id", "item", "j"), "decontam-seeds")
    n = seeds.count()
    n_words = items.agg(F.sum(F.size("item"))).first()[0] or 0
    # An item_id may come with several texts; each is held by its own words.
    text = [F.hash("item").alias("text_no"), F.size("item").alias("length")]
    seeds = broadcast_within(seeds.select("seed", F.col("item_id").alias("of"), "j", *text), n, MAX_SEEDS)
    items = broadcast_within(
        items.select("item_id", "item", F.hash("item").alias("item_no")), n_words, MAX_SEEDS
    )
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", _word_hashes(F.col("text")).alias("doc"))
    if n > MAX_SEEDS:
        docs = docs.withColumn("doc_no", F.xxhash64("doc"))
    every = [*_mask_seeds("doc", "i"), *_short_seeds("doc", "i", lengths, False)]
    looked = _exploded(docs, "doc", "i", min([SHORTEST, *lengths]), every)
    if n <= MAX_SEEDS:
        hits = looked.join(seeds, "seed").withColumn("shift", F.col("i") - F.col("j"))
    else:
        # Seeds travel without the words; these come back for what was hit.
        small = looked.select("doc_id", "doc_no", "i", "seed")
        shift = (F.col("i") - F.col("j")).alias("shift")
        hits = small.join(seeds, "seed").select("doc_id", "doc_no", "of", "text_no", "length", shift)
        back = docs.select(F.col("doc_id").alias("back_id"), F.col("doc_no").alias("back_no"), "doc")
        same = (F.col("doc_id") == F.col("back_id")) & (F.col("doc_no") == F.col("back_no"))
        hits = hits.distinct().join(back, same)
    # One row for each alignment is enough, and the best alignment speaks for the pair.
    over = _laid_over(F.col("doc"), F.col("shift"), F.col("length")).alias("over")
    hits = hits.select("doc_id", "of", "text_no", "length", "shift", over).distinct()
    same_text = (F.col("text_no") == F.col("item_no")) & (F.col("length") == F.size("item"))
    hits = hits.join(items, (F.col("of") == F.col("item_id")) & same_text)
    found = hits.select(
        "doc_id", "item_id", "shift", "length",
        _best(F.col("over"), F.col("item"), F.col("shift")).alias("s"),
    )
    least = F.when(F.col("length") < SHORTEST, F.col("length")).otherwise(F.least(F.lit(MIN_SCORE), F.col("length") - 3))
    good = found.where(F.col("s.best") >= least)
    best = good.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("s.best"), (-F.col("shift")).alias("shift"), F.col("s.first"), F.col("s.end"))).alias("s")
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("s.best").alias("score"),
        (F.col("s.first") - F.col("s.shift")).alias("first_word"),
        (F.col("s.end") - F.col("s.first")).alias("n_words"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item."""
    (bad_id,) = free(documents.columns, "_bad_id")
    bad = overlaps(documents, benchmark).select(F.col("doc_id").alias(bad_id)).distinct()
    return documents.join(bad, F.col("doc_id") == F.col(bad_id), "left_anti")


def clean_all(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``clean``, but rows with a null doc_id are decided, too: on the hash of their text."""
    known = clean(documents.where("doc_id IS NOT NULL"), benchmark)
    if documents.where("doc_id IS NULL").isEmpty():
        return known
    (key,) = free(documents.columns, "_key")
    keyed = documents.where("doc_id IS NULL").withColumn(key, F.sha2("text", 256))
    texts = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text").distinct()
    bad = overlaps(texts, benchmark).select(F.col("doc_id").alias(key)).distinct()
    return known.unionByName(keyed.join(bad, key, "left_anti").select(*documents.columns))
