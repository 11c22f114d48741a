"""LEFT JOINs of several tagged values on one key.

The source joins a tall table (key, tag, value) once per tag: attributes of an
appointment, notes of a shipment.  A tag stored twice for a key doubles the
rows of that key, and several repeated tags multiply.

``attach_by_joins`` is that shape.  ``attach_checked`` gives the same rows from
one pass over the tall table, and decides by what that pass proves:

* the pass groups by key: per tag the greatest value and the number of values.
  Where every number is 0 or 1 the greatest value *is* the value, so the join
  with this pivot is complete.  The pivot is written, and the number of keys
  with a repeated tag is observed while it is;
* only keys with a repeated tag go on: their values are gathered as one list
  per tag and exploded again;
* a key whose tags multiply to more than ``SALTED_ROWS`` rows is never gathered:
  the values of its most frequent tag are dealt over salts, those of the other
  tags are copied to every salt, and the joins run on (key, salt).  So no task
  sees all values of such a key, and none emits all its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quaysight.operators import materialize, restrict_to

# Output rows of one key from which its values are salted; about as many rows
# come out of one salt.
SALTED_ROWS = 1_000_000


def attach_by_joins(base: DataFrame, tall: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """One filtered LEFT JOIN per tag; ``tall`` is (key, tag, value), ``wanted``
    maps an output column to a tag."""
    out = base
    for alias, tag in wanted.items():
        out = out.join(tall.filter(F.col("tag") == tag).select(key, F.col("value").alias(alias)), key, "left")
    return out.select(*base.columns, *wanted)


def _count(alias: str) -> str:
    return f"_n_{alias}"


def checked_pivot(tall: DataFrame, key: str, wanted: dict[str, str], salted_rows: int) -> DataFrame:
    """(key, one value per wanted tag, the counts, ``_repeated``, ``_rows``):
    ``_rows`` is the number of rows that the joins make of one base row."""
    tag, value = F.col("tag"), F.col("value")
    found = (tall.filter(tag.isin(*wanted.values()) & F.col(key).isNotNull()).groupBy(key)
             .agg(*[F.max(F.when(tag == t, value)).alias(a) for a, t in wanted.items()],
                  *[F.count(F.when(tag == t, 1)).alias(_count(a)) for a, t in wanted.items()]))
    rows = reduce(lambda x, y: x * y, [F.greatest(F.col(_count(a)), F.lit(1)).cast("double") for a in wanted])
    most = F.greatest(*[F.col(_count(a)) for a in wanted], F.lit(0))
    return found.withColumns({"_rows": rows, "_repeated": most > 1, "_hot": (most > 1) & (rows > salted_rows)})


def _with_lists(base: DataFrame, tall: DataFrame, pivot: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """Keys with a repeated tag get one list per tag, exploded; all others
    their value from the pivot."""
    tag, value = F.col("tag"), F.struct(F.col("value"))   # the struct keeps a stored NULL apart from no value
    lists = (restrict_to(tall.filter(tag.isin(*wanted.values())), pivot.filter("_repeated").select(key), key).groupBy(key)
             .agg(*[F.collect_list(F.when(tag == t, value)).alias(f"_l_{a}") for a, t in wanted.items()]))
    out = base.join(pivot.select(key, "_repeated", *wanted), key, "left").join(lists, key, "left")
    for alias in wanted:
        one = F.array(F.struct(F.col(alias).alias("value")))
        out = out.withColumn(alias, F.explode_outer(F.when(F.col("_repeated"), F.col(f"_l_{alias}")).otherwise(one)))
        out = out.withColumn(alias, F.col(f"{alias}.value"))
    return out.select(*base.columns, *wanted)


def _salted(base: DataFrame, tall: DataFrame, hot: DataFrame, key: str, wanted: dict[str, str], salted_rows: int) -> DataFrame:
    """Hot keys: the most frequent tag's values over salts, the others copied."""
    most = F.greatest(*[F.col(_count(a)) for a in wanted], F.lit(0))
    lead: Column = F.lit(None).cast("string")
    for alias in reversed(wanted):
        lead = F.when(F.col(_count(alias)) == most, F.lit(alias)).otherwise(lead)
    salts = F.least(F.ceil(F.col("_rows") / salted_rows), most).cast("int")
    plan = hot.select(key, lead.alias("_lead"), salts.alias("_salts"))
    every = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    out = base.join(plan, key).withColumn("_salt", every)
    for alias, tag in wanted.items():
        values = tall.filter(F.col("tag") == tag).select(key, F.col("value").alias(alias), F.monotonically_increasing_id().alias("_at"))
        own = F.pmod(F.xxhash64("_at"), F.col("_salts")).cast("int")
        values = values.join(plan, key).select(
            key, alias, F.explode(F.when(F.col("_lead") == alias, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("_salts") - 1))).alias("_salt"),
            F.lit(True).alias("_met"))
        # a salt that holds none of the leading tag's values makes no row
        out = out.join(values, [key, "_salt"], "left").filter((F.col("_lead") != alias) | F.col("_met")).drop("_met")
    return out.select(*base.columns, *wanted)


def attach_checked(base: DataFrame, tall: DataFrame, key: str, wanted: dict[str, str], name: str = "tagged",
                   salted_rows: int = SALTED_ROWS) -> DataFrame:
    """The rows of ``attach_by_joins``, in one pass over ``tall`` while no key
    repeats a tag.  A NULL key matches nothing; stored NULL values count as
    values.  ``base`` must not hold the wanted columns."""
    seen = Observation()
    pivot = materialize(checked_pivot(tall, key, wanted, salted_rows).observe(
        seen, F.sum(F.col("_repeated").cast("int")).alias("repeated"), F.sum(F.col("_hot").cast("int")).alias("hot")), f"{name}_pivot")
    values = pivot.select(key, *wanted)
    if not seen.get["repeated"]:
        return base.join(values, key, "left").select(*base.columns, *wanted)
    if not seen.get["hot"]:
        return _with_lists(base, tall, pivot, key, wanted)
    base, hot = materialize(base, f"{name}_base"), pivot.filter("_hot")
    others = base.join(hot.select(key), key, "left_anti").select(*base.columns)
    return _with_lists(others, tall, pivot.filter("NOT _hot"), key, wanted).unionByName(
        _salted(base, tall, hot, key, wanted, salted_rows))
