"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words.  Its documents are counted by exact
length; whole passes over the source are taken first, and what is left of the
target is filled by length: a bounded knapsack chooses how many documents of
every length to take, and a seeded hash picks which.  Only counts by length are
gathered per source, never its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaysight.llm.common import stored, word_count

# Weights repeat over the sources in order of code points, null last.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MOST_PASSES = 2
SEED = 17
# Words of a source's target that are left to the knapsack.
KNAPSACK_WORDS = 4096
# Parts that the documents of one source and length are split into.
CELLS = 256


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS,
                   share: float = BUDGET_SHARE, passes: float = MOST_PASSES) -> list[tuple[str | None, int, float]]:
    """(source, size) -> (source, size, target): the budget ``share * total``
    is dealt by weight; a target stops at ``passes`` times its source's size
    and the excess is dealt again to the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    caps = [passes * n for _, n in order]
    target = [0.0] * len(order)
    free, left = list(range(len(order))), share * sum(n for _, n in order)
    while free:
        unit = left / sum(weight[i] for i in free)
        above = [i for i in free if weight[i] * unit >= caps[i]]
        for i in above or free:
            target[i] = float(caps[i]) if above else weight[i] * unit
        if not above:
            break
        left -= sum(caps[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def choose_lengths(counts: dict[int, int], budget: int, reserve: int = KNAPSACK_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come as
    near to ``budget`` from below as the knapsack finds.

    All but ``reserve`` words are filled in proportion to the counts, longest
    first, each length taking up what the longer ones left; a bounded knapsack
    over the rest fits the remaining words.
    """
    total = sum(n * c for n, c in counts.items())
    budget = min(budget, total)
    lengths = sorted((n for n in counts if n > 0), reverse=True)
    take = dict.fromkeys(lengths, 0)
    goal = max(0, budget - reserve)
    seen = spent = 0
    for n in lengths:
        seen += n * counts[n]
        due = goal * seen // total - spent
        take[n] = max(0, min(counts[n], due // n))
        spent += take[n] * n
    left = budget - spent
    # bounded knapsack: bit w of reach[i] tells whether w words can be made of the first i items
    items: list[tuple[int, int]] = []
    for n in lengths:
        have, k = min(counts[n] - take[n], left // n), 1
        while have > 0:
            items.append((n, min(k, have)))
            have -= k
            k *= 2
    mask, reach = (1 << (left + 1)) - 1, [1]
    for n, k in items:
        reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
        if reach[-1] >> left & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            n, k = items[i - 1]
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


def _source_key(source: Column) -> Column:
    """The source as a join key: null is a value of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        weights: Sequence[float] = WEIGHTS, share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` and ``mix_size``, ``mix_source_size``,
    ``mix_target``, ``mix_times``: how often (0 to 2 times) a row is taken.

    The size of a row is its number of words; null and blank texts have none
    and are never taken.  A null source is a source of its own, the last.
    Every row counts, repeated rows too; the same rows and seed give the same
    choice (rows equal in all columns are interchangeable).  Columns of
    ``docs`` that have one of these names are replaced.  An empty table gives
    no rows.
    """
    sized = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_times").select(
        "*", word_count(F.col(text_col)).alias("mix_size"), _source_key(F.col(source_col)).alias("__source"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__hash"))
    sized = sized.withColumn("__cell", F.pmod("__hash", F.lit(CELLS)).cast("int"))
    spark = docs.sparkSession
    cells = stored(sized.groupBy("__source", "mix_size", "__cell").agg(F.count("*").alias("__cell_n")), "mix-cells")
    by_length = cells.groupBy("__source", "mix_size").agg(F.sum("__cell_n").alias("n"))
    sums = by_length.groupBy("__source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("size"))
    # one row per source, which the weights are stated for
    dealt = source_targets([(None if r[0] == "n" else r[0][1:], r[1]) for r in sums.collect()], weights, share)
    targets = spark.createDataFrame(
        [("n" if s is None else "s" + s, n, t) for s, n, t in dealt],
        "__source string, mix_source_size long, mix_target double")

    def fit(counts):
        import pandas as pd

        have = dict(zip(counts["mix_size"].tolist(), counts["n"].tolist(), strict=True))
        size, target = int(counts["mix_source_size"].iloc[0]), float(counts["mix_target"].iloc[0])
        whole = int(target // size) if size else 0
        more = choose_lengths(have, round(target - whole * size))
        return pd.DataFrame({"__source": counts["__source"], "mix_size": counts["mix_size"],
                             "__whole": whole, "__more": [more.get(n, 0) for n in counts["mix_size"].tolist()]})

    fitted = by_length.join(targets, "__source").groupBy("__source").applyInPandas(
        fit, "__source string, mix_size long, __whole int, __more long")
    before = Window.partitionBy("__source", "mix_size").orderBy("__cell")
    plan = stored(
        cells.join(fitted, ["__source", "mix_size"])
        .withColumn("__earlier", F.sum("__cell_n").over(before) - F.col("__cell_n"))
        .withColumn("__extra", F.greatest(F.lit(0), F.least("__cell_n", F.col("__more") - F.col("__earlier"))))
        .join(targets, "__source")
        .select("__source", "mix_size", "__cell", "__cell_n", "__whole", "__extra", "mix_source_size", "mix_target"), "mix-plan")
    # Only cells that are taken in part need an order; they hold 1/CELLS of a length.
    keys = ["__source", "mix_size", "__cell"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__hash", id_col))
    return (sized.join(plan, keys)
            .withColumn("mix_times", F.when(F.col("mix_size") == 0, 0).otherwise(
                F.col("__whole") + F.when(rank <= F.col("__extra"), 1).otherwise(0)).cast("int"))
            .drop("__source", "__cell", "__hash", "__cell_n", "__whole", "__extra"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it."""
    columns = docs.columns
    return (mix(docs, **options).where("mix_times > 0")
            .withColumn("mix_times", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*columns))
