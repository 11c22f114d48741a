"""Ordered string lists (LISTAGG ... WITHIN GROUP) of groups of any size.

``ordered_list`` is the aggregate itself: one task gathers and sorts a group.
``lists_in_parts`` lists a group over many tasks: its values are dealt by range,
each part is listed in order, and the parts - one string each - are joined in
range order.  Only that last join holds a group in one place, as the string it
is.  ``grouped_lists`` sends the hot groups that way and all others the short
one; rows, NULL rules and strings are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.operators import materialize

# Rows of a group from which it is listed in parts.
HOT_ROWS = 100_000


def ordered_list(column: str, sep: str = " ") -> Column:
    """LISTAGG(column, sep) WITHIN GROUP (ORDER BY column): NULLs skipped,
    duplicates kept, NULL for an empty group."""
    return F.expr(f"listagg({column}, '{sep}') within group (order by {column})")


def lists_in_parts(rows: DataFrame, keys: list[str], column: str, out: str, sep: str = " ") -> DataFrame:
    """(keys, ``out``) for the groups that have a value; without keys one row,
    NULL when there is no value.

    The range partitioning goes by keys, value and a hash of the row's place,
    so that a group is cut within equal values too (their order is no matter);
    the number of a partition is then the place of its part.
    """
    values = rows.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_value"))
    dealt = values.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, "_value", "_tie")
    parts = dealt.withColumn("_part", F.spark_partition_id()).groupBy(*keys, "_part").agg(ordered_list("_value", sep).alias("_list"))
    return parts.groupBy(*keys).agg(F.expr(f"listagg(_list, '{sep}') within group (order by _part)").alias(out))


def hot_groups(rows: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """The keys of groups of more than ``limit`` rows, written; None if there
    are none.  A table of at most ``limit`` rows isn't grouped for it."""
    if rows.count() <= limit:
        return None
    hot = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys), "hot_groups")
    return None if hot.isEmpty() else hot


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_h_{k}"]) for k in keys])


def grouped_lists(rows: DataFrame, keys: list[str], lists: dict[str, str], others: list[Column] = (),
                  hot: DataFrame | None = None, sep: str = " ") -> DataFrame:
    """Per group the ordered lists (output -> column) and the aggregates
    ``others``; ``hot`` holds the keys of groups to be listed in parts."""
    def short(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(*[ordered_list(c, sep).alias(o) for o, c in lists.items()], *others)

    if hot is None:
        return short(rows)
    rows = materialize(rows, "listed_rows")
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    large = rows.join(hot, _same(rows, hot, keys), "left_semi")
    marker = F.count(F.lit(1)).alias("_rows")
    out = large.groupBy(*keys).agg(marker, *others)
    for name, column in lists.items():
        made = lists_in_parts(large, keys, column, name, sep).select(*[F.col(k).alias(f"_h_{k}") for k in keys], name)
        out = out.join(made, _same(out, made, keys), "left").drop(*[f"_h_{k}" for k in keys])
    rest = short(rows.join(hot, _same(rows, hot, keys), "left_anti"))
    return rest.unionByName(out.select(*rest.columns))
