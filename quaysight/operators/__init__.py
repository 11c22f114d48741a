"""Relational operators shared by the reports (DataFrame -> DataFrame)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.session import ensure_checkpoint_dir

# Folders written by ``materialize`` outside of any ``intermediates`` block (see
# ``drop_materialized``).
_WRITTEN: list[str] = []
# The folders of the block that the current thread runs in.
_OWNER: ContextVar[list[str] | None] = ContextVar("quaysight_intermediates", default=None)


@contextmanager
def intermediates(spark) -> Iterator[list[str]]:
    """A block that owns the intermediates written in it: they are deleted when
    it ends, those of other reports - of this driver or of another - are not.

        with intermediates(spark):
            save_report(dock_doors(wms), path)
    """
    mine: list[str] = []
    token = _OWNER.set(mine)
    try:
        yield mine
    finally:
        _OWNER.reset(token)
        _delete(spark, mine)


def restrict_to(big: DataFrame, keys: DataFrame, big_col: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``big`` whose ``big_col`` appears in ``keys[key_col]``.

    A LEFT SEMI join with the big table on the streamed (left) side, so when
    the key set is small Spark builds a hash table from it (broadcast, after
    its size check) and the big table is filtered during its scan, without a
    shuffle.  Used to cut the inputs of a report to the rows its driving
    shipments or appointments need before anything is aggregated.
    """
    k = keys.select(keys[key_col or big_col].alias(big_col))
    return big.join(k, big_col, "left_semi")


def left_join_dealt(big: DataFrame, small: DataFrame, big_col: str, small_col: str, deal_by: list[str]) -> DataFrame:
    """LEFT JOIN on ``big_col = small_col`` whose rows without a key, which
    meet nothing, are dealt by ``deal_by``: in a plain outer join that is
    shuffled they would all meet in one task."""
    key = F.when(F.col(big_col).isNull(), F.xxhash64(*deal_by)).otherwise(F.lit(0).cast("long"))
    # 0 on every row, but no constant: that would not be a key of the shuffle
    zero = F.xxhash64(small_col).bitwiseAND(F.lit(0).cast("long"))
    big, small = big.withColumn("_deal", key), small.withColumn("_deal_to", zero)
    met = (big[big_col] == small[small_col]) & (big["_deal"] == small["_deal_to"])
    return big.join(small, met, "left").drop("_deal", "_deal_to")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate result that several branches of a report
    reuse (the driving shipments, their pieces, ...) to the session's
    checkpoint folder as parquet, and read it back.

    * each large table behind it is scanned once instead of once per branch;
    * the lineage is cut, so the report's plan stays small and a lost
      executor does not recompute the scans;
    * the read-back relation carries its real size, so Spark's broadcast size
      check (``spark.sql.autoBroadcastJoinThreshold``) decides on measured
      bytes rather than on an estimate of a filtered scan.

    The folder is ``spark.checkpoint.dir`` (a shared folder on a cluster); a
    local one is created only when the session names none (tests).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quaysight-{name}-{uuid.uuid4().hex}"
    # REBALANCE lets AQE merge the splits of a filtered scan to the advisory
    # size (and split skewed ones), so the folder holds right-sized files.
    df = df.hint("rebalance")
    df.write.mode("overwrite").parquet(path)
    owner = _OWNER.get()
    (_WRITTEN if owner is None else owner).append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``materialize`` several independent intermediates at once: each write
    is its own Spark job, submitted from its own driver thread, so their
    scans share the cluster instead of running one after another."""
    from concurrent.futures import ThreadPoolExecutor

    if len(frames) <= 1:
        return {name: materialize(df, name) for name, df in frames.items()}
    ensure_checkpoint_dir(next(iter(frames.values())).sparkSession)   # resolve once, before the threads
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        # each thread in a copy of this context: the folders keep their owner
        futures = {name: pool.submit(copy_context().run, materialize, df, name) for name, df in frames.items()}
        return {name: f.result() for name, f in futures.items()}


def drop_materialized(spark) -> int:
    """Delete the folders ``materialize`` wrote outside of ``intermediates``
    blocks, once the reports that read them have been written out (e.g. at the
    end of a dashboard refresh).  Returns the number of folders removed."""
    return _delete(spark, _WRITTEN)


def _delete(spark, folders: list[str]) -> int:
    """Delete folders with the Hadoop file system of the session, so that it
    works for any shared store."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:   # no driver-side JVM (Spark Connect): leave the folders to the store's retention
        return 0
    removed = 0
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        fs = path.getFileSystem(conf)
        removed += bool(fs.delete(path, True))
    return removed
