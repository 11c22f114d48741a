"""The corpus pipeline: five stages from ``documents`` to sharded records.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.llm import decontaminate, mixture, parity_join, toxicity, virtual_slots
from quaysight.llm.common import stored, table
from quaysight.session import tune_session


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under other column names, which no helper column has, and the
    names by those of ``docs``."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; all columns keep their
    values, also ones named like the model's.  Empty tables give no rows."""
    models = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, at = _numbered(docs)
    scored = toxicity.score(rows, models, id_col=at["doc_id"], text_col=at["text"], keep=list(at.values()))
    return scored.where("toxic = 0").select(*at.values()).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id
    stays, once if its row is repeated; documents without an id stay.  Rows
    that share an id but not the text are documents of their own.  An empty
    table gives no rows; columns may have any names."""
    rows, at = _numbered(docs)
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    named = rows.where(doc_id.isNotNull())
    digest = F.coalesce(F.sha2(text, 256), F.lit(""))
    unclear = named.groupBy(doc_id).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high")
    if unclear.isEmpty():
        nodes = named.withColumn("node", doc_id)
    else:
        # written, so that a row keeps its number; numbers follow the ids
        nodes = stored(named.orderBy(doc_id, text).withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = parity_join.near_duplicate_components(nodes.select(F.col("node").alias("doc_id"), text.alias("text")))
    kept = stored(groups.where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct(), "kept")
    once = nodes.join(kept, "node", "left_semi").dropDuplicates([at["doc_id"], at["text"]])
    return once.drop("node").unionByName(rows.where(doc_id.isNull())).select(*at.values()).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them (not, once or twice)."""
    return mixture.mixed_rows(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, place and virtual slot of every row, and in ``record`` the row
    itself with all its columns: the sharded corpus."""
    return virtual_slots.shard(docs, whole=True)[0]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tuned(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune_session(spark), docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _tuned(drop_toxic)),
    ("n-gram Jaccard join", _tuned(keep_one_of_each_group)),
    ("benchmark decontamination", _tuned(drop_leaks)),
    ("mixing sources to target weights", _tuned(mix_sources)),
    ("sharding", _tuned(into_shards)),
]

# Classifiers, sketches and crc32 have no SQL form; tests/llm holds the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
