"""Seeds of the masks, each word a row: the right ones, without a lambda a seed."""

from pyspark.sql import functions as F

from quaysight.llm import decontaminate

MASKS = [*enumerate(decontaminate.MASKS), *decontaminate.short_masks([1, 3])]


def _frame(spark, texts):
    rows = [(i, t.split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, words array<string>")


def test_seeds_are_those_of_every_mask_at_every_place(spark):
    texts = ["", "a", "a b c", "a b c d e", " ".join("abcdefgh"), "x x x x x x x x x"]
    found = decontaminate.seeded(_frame(spark, texts), ["id"], MASKS).collect()
    wanted = [(i, at, number, [t.split()[at + k] for k in mask]) for i, t in enumerate(texts) for number, mask in MASKS
              for at in range(len(t.split()) - mask[-1])]
    hashed = [F.xxhash64(F.lit(number), *[F.xxhash64(F.lit(w)) for w in words]) for *_, number, words in wanted]
    seeds = spark.range(1).select(*hashed).first()
    assert sorted(map(tuple, found)) == sorted((i, at, s) for (i, at, *_), s in zip(wanted, seeds, strict=True))


def test_a_seed_is_hashed_without_a_lambda(spark):
    plan = decontaminate.seeded(_frame(spark, ["a b c d e f g h"]), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 1, plan   # the words' own hashes
