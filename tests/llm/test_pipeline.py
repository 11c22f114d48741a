"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quaysight.llm import decontaminate, toxicity
from quaysight.llm.common import stored, table

from tests.conftest import SMALL
from tests.llm.test_operators import WORD
from tests.llm.test_parity_join import brute


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, frames = docs.columns, [docs]
    for name, stage in cp.STAGES:
        frames.append(stored(stage(spark, frames[-1], SMALL), "test-stage"))
    rows = [f.collect() for f in frames]
    assert [f.columns for f in frames[:5]] == [columns] * 5

    models = toxicity.train(docs, table(spark, SMALL, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, models).where("toxic = 1").collect()}
    assert toxic and Counter(rows[1]) == Counter(r for r in rows[0] if r.doc_id not in toxic)

    comp = brute([(r.doc_id, r.text) for r in rows[1]])
    assert Counter(rows[2]) == Counter(r for r in rows[1] if comp[r.doc_id][1] == r.doc_id)

    leaked = {r.doc_id for r in decontaminate.overlaps(frames[2], table(spark, SMALL, "benchmark")).collect()}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if r.doc_id not in leaked)

    taken, total = Counter(), Counter()
    for part, sums in ((rows[4], taken), (rows[3], total)):
        for r in part:
            sums[r.source] += len(WORD.findall(r.text or ""))
    assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 2
    # a source here has a handful of documents, which fit its target only roughly
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= 0.02 * sum(total.values())

    places = defaultdict(list)
    for r in rows[5]:
        places[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_repeated_and_null_ids_in_the_join_stage(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (None, "a b c"), (3, None)],
                                 "doc_id long, text string")
    kept = sorted((r.doc_id for r in cp.keep_one_of_each_group(spark, docs, SMALL).collect()), key=str)
    assert kept == [1, 3, None, None]
    assert cp.keep_one_of_each_group(spark, docs.limit(0), SMALL).count() == 0


def test_texts_that_share_an_id_are_separate_documents(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "pqr"]
    docs = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (3, texts[1] + " more"), (4, texts[2]), (5, texts[2]),
            (6, None), (6, None), (6, "other text"), (7, "")]
    kept = cp.keep_one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(1, texts[0]), (1, texts[1]), (4, texts[2]), (6, None), (6, "other text"), (7, "")], key=str)


def test_columns_named_like_helpers_keep_their_values(spark):
    names = ("toxic", "p_toxic", "p_low_quality", "__node", "node", "__row", "extra", "whole", "size", "shard", "record")
    docs = table(spark, SMALL, "documents").select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names))
    plain = frames = table(spark, SMALL, "documents")
    for _, stage in cp.STAGES[:-1]:
        docs, plain = (stored(stage(spark, d, SMALL), "test-stage") for d in (docs, plain))
        assert docs.columns == [*plain.columns, *names]
        rows = docs.collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in plain.collect())
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    last = cp.into_shards(spark, docs, SMALL).collect()
    assert Counter(tuple(r.record) for r in last) == Counter(map(tuple, rows))
    assert frames.limit(0).count() == 0
    empty = table(spark, SMALL, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
