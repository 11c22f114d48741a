"""Stages called on their own bound the batches that travel to Python workers."""

import corpus_pipeline
from quaysight.session import BATCH_CONF


def test_every_stage_bounds_its_batches(spark):
    for name, stage in corpus_pipeline.STAGES:
        fresh = spark.newSession()
        docs = fresh.createDataFrame([(1, "a b c")], "doc_id long, text string")
        try:
            stage(fresh, docs, "/nonexistent")
        except Exception:   # stages that read further tables
            pass
        assert fresh.conf.get(BATCH_CONF[0]) == BATCH_CONF[1], name
