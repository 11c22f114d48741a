"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed hashes the words at the fixed positions of a mask and ignores those in
between, so a copy with some words replaced still shares seeds.  Training
texts and benchmark items are seeded at every word; equal seeds give hits on a
diagonal (document position minus item position).  Around each hit the item is
laid over the text and the best window of words must agree in three of four.
The masks leave out no such window: wherever the replaced words of a window of
LEAST to WINDOW words lie, one mask fits between them.  Items of fewer words are
seeded whole and must occur word for word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.llm.common import stored

# Positions that count, of each mask.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6))
SHORTEST = 5
# Words from which an item may have some replaced; shorter ones must occur whole.
LEAST = 8
# Words of the window that is verified (whole items, if shorter) and the share that must agree.
WINDOW = 13
AGREE = 0.75
# Largest number of benchmark seeds that is broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
BROADCAST_WORDS = 4_000_000

_NOT_WORD = r"[^\p{L}\p{N}]+"
# Scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han).
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
# The same in fewer ranges, with some letters between: what a text must hold to
# be looked through.
_NEAR_UNSPACED = r"[\u0E00-\u109F\u1780-\u17FF\u3040-\uFAFF\x{20000}-\x{3FFFF}]"

Masks = list[tuple[int, tuple[int, ...]]]
_LONG: Masks = list(enumerate(MASKS))


def text_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; of scripts without spaces each
    letter with its marks is a word."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    apart = F.regexp_replace(raw, rf"({_UNSPACED}\p{{M}}*)", " $1 ")
    spaced = F.when((F.octet_length(raw) > F.char_length(raw)) & raw.rlike(_NEAR_UNSPACED), apart).otherwise(raw)
    return F.filter(F.split(F.lower(spaced), _NOT_WORD), lambda w: w != "")


def short_masks(sizes: Sequence[int]) -> Masks:
    """Masks of the whole items of fewer than LEAST words."""
    return [(len(MASKS) + n, tuple(range(n))) for n in sorted(sizes)]


def seeded(frame: DataFrame, keys: list[str], masks: Masks = _LONG) -> DataFrame:
    """``keys``, ``at`` (word position from 0) and ``seed``; ``frame`` has the
    column ``words``.  Each word becomes a row with the words that the masks
    reach from it, so that seeds are hashed from columns and no lambda runs
    once a seed."""
    reached = sorted({k for _, mask in masks for k in mask})
    hashed = frame.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # the words from the k-th on: at every place the one that is k words further, null past the end
    later = [F.slice("h", k + 1, F.greatest(F.lit(0), F.size("h") - k)).alias(f"h{k}") for k in reached]
    rows = hashed.select(*keys, F.posexplode(F.arrays_zip(*later)).alias("at", "w"))
    seeds = [F.when(F.col(f"w.h{mask[-1]}").isNotNull(), F.xxhash64(F.lit(number), *[F.col(f"w.h{k}") for k in mask]))
             for number, mask in masks]
    return rows.select(*keys, "at", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _row_key(id_col: str, text_col: str) -> Column:
    """Stands for a row; equal for repeated rows only."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(row_key, doc_id, item_id, start_word, matched, window)``: for every
    document and item that overlap, the first word of the best window in the
    document, its agreeing words and its length.

    Null and blank texts, and items without a word, share nothing; items
    under 8 words match where they occur word for word, be it a single word.
    Rows with a null id are searched too; repeated rows give one result,
    repeated items (same id) one result for each document.  A text is searched
    whole, whatever its length.  Empty tables give no rows; other columns are
    ignored.
    """
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), text_words(F.col(item_text)).alias("item"))
                   .where(F.size("item") > 0).distinct(), "items")
    keyed = items.withColumnRenamed("item", "words").withColumn("item_key", F.xxhash64("words"))
    by = ["item_id", "item_key"]
    tests = seeded(keyed.where(F.size("words") >= LEAST), by)
    # the lengths of short items, at most LEAST - 1 numbers
    short = short_masks([r[0] for r in items.where(F.size("item") < LEAST).select(F.size("item")).distinct().collect()])
    for mask in short:
        tests = tests.unionByName(seeded(keyed.where(F.size("words") == len(mask[1])), by, [mask]))
    tests = stored(tests.withColumnRenamed("at", "item_at"), "item-seeds")
    if tests.count() <= BROADCAST_SEEDS:
        tests = F.broadcast(tests)
    size = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    laid = items.withColumn("item_key", F.xxhash64("item"))
    if size <= BROADCAST_WORDS:
        laid = F.broadcast(laid)
    texts = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"),
                        text_words(F.col(text_col)).alias("words"))
    hits = stored(seeded(texts, ["row_key"], _LONG + short).join(tests, "seed")
                  .select("row_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))
                  .distinct(), "hits")
    window = F.least(F.lit(WINDOW), F.size("item"))
    same = F.transform("item", lambda w, i: F.coalesce(F.get("words", F.col("diagonal") + i) == w, F.lit(False)).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("window") + 1),
                       lambda i: F.struct(F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, b: a + b).alias("matched"),
                                          (-i).alias("back")))
    found = (texts.join(hits, "row_key").join(laid, ["item_id", "item_key"])
             .select("row_key", "doc_id", "item_id", "diagonal", window.alias("window"), same.alias("same"))
             .select("row_key", "doc_id", "item_id", "diagonal", "window", F.array_max(sums).alias("best"))
             .where(F.col("best.matched") >= F.when(F.col("window") < LEAST, F.col("window")).otherwise(F.ceil(F.col("window") * AGREE))))
    best = found.groupBy("row_key", "item_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.struct(F.col("best.matched").alias("matched"), (-(F.col("diagonal") - F.col("best.back") - 1)).alias("back"),
                       "window")).alias("b"))
    return best.select("row_key", "doc_id", "item_id", F.greatest(F.lit(0), -F.col("b.back")).alias("start_word"),
                       F.col("b.matched").alias("matched"), F.col("b.window").alias("window"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, unchanged."""
    leaked = stored(overlaps(docs, benchmark, id_col, text_col).select(F.col("row_key").alias("__row")).distinct(), "leaked")
    return docs.join(leaked, _row_key(id_col, text_col) == leaked["__row"], "left_anti")
