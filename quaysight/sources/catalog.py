"""``Wms``: the set of warehouse tables a report reads.

Three ways to obtain it:

* ``Wms.from_parquet(spark, root)``   one parquet folder per table (production
  layout; ``root/<table>``), read with the explicit schema so only the used
  columns are scanned;
* ``Wms.from_catalog(spark, database)`` tables of a metastore database;
* ``Wms.from_testdata(spark, sf_dir)`` derived from the shipped test tables.

Tables are resolved lazily and memoised, so a report only touches the tables
it uses and one table object is shared by all operators of a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.sources.schemas import DAY_COLUMNS, DAY_PARTITION, KEYS, SCHEMAS, TABLE_NAMES


class KeyViolation(ValueError):
    """A declared key that the table's rows contradict."""


def is_key(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether no two rows agree on ``columns``; rows with a NULL among them
    match nothing in a join and are not asked."""
    named = df.select(*columns).dropna()
    return named.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


class Wms:
    def __init__(self, loader: Callable[[str], DataFrame]):
        self._loader = loader
        self._cache: dict[str, DataFrame] = {}
        self._keys: dict[str, tuple[str, ...]] = dict(KEYS)
        self._on_violation = "fall back"
        self._verified: dict[str, bool] = {}

    def declare_keys(self, keys: dict[str, tuple[str, ...]], on_violation: str = "fall back") -> "Wms":
        """Declare the tables' keys, in place of those of ``schemas.KEYS``.
        ``on_violation``: what a plan does when the rows contradict a
        declaration, "fall back" to the plan without it or raise an "error"."""
        if on_violation not in ("fall back", "error"):
            raise ValueError(f"unknown reaction {on_violation!r}")
        for name, columns in keys.items():
            unknown = set(columns) - set(SCHEMAS[name].names) if name in SCHEMAS else {name}
            if unknown or not columns:
                raise KeyError(f"no such table or columns: {name} {sorted(unknown)}")
        self._keys, self._on_violation, self._verified = dict(keys), on_violation, {}
        return self

    def has_key(self, name: str, columns: tuple[str, ...]) -> bool:
        """Whether ``columns`` are declared as the key of the table and its rows
        confirm it: one aggregate over the key columns, once for this ``Wms``."""
        if self._keys.get(name) != tuple(columns):
            return False
        if name not in self._verified:
            self._verified[name] = is_key(self.table(name), columns)
        if not self._verified[name] and self._on_violation == "error":
            raise KeyViolation(f"{', '.join(columns)} is declared as the key of {name}, but repeats")
        return self._verified[name]

    def table(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"unknown warehouse table {name!r}; known: {', '.join(TABLE_NAMES)}")
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.table(name)
        except KeyError as exc:
            raise AttributeError(str(exc)) from None

    def stage(self, root: str, names=TABLE_NAMES, files: int | None = None, by_day: bool = False) -> "Wms":
        """Write the tables to ``root/<table>`` as parquet and return a
        ``Wms`` reading them (e.g. to turn the test-data derivation into
        stored tables, as a warehouse extract would be).  ``files`` spreads
        each table over that many files, as a stored table would be, so that
        its scans can run in parallel.  With ``by_day`` the tables that the
        clock windows cut are partitioned by day, so that a report opens the
        days of its window only."""
        root = root.rstrip("/")
        spark = None
        for name in names:
            df = self.table(name)
            spark = df.sparkSession
            if files:
                df = df.repartition(files)
            if by_day and name in DAY_COLUMNS:
                # a day's rows in few files; AQE splits a large day
                df = df.withColumn(DAY_PARTITION, F.to_date(DAY_COLUMNS[name])).hint("rebalance", F.col(DAY_PARTITION))
                df.write.mode("overwrite").partitionBy(DAY_PARTITION).parquet(f"{root}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{root}/{name}")
        return Wms.from_parquet(spark, root)

    def days(self, name: str, first: Column, last: Column | None = None) -> DataFrame:
        """The table, of its days from ``first`` to ``last`` if it is stored by
        day; the whole table otherwise.  Callers filter by time as well."""
        df = self.table(name)
        if DAY_PARTITION not in df.columns:
            return df
        day = F.col(DAY_PARTITION)
        return df.filter(day >= first if last is None else day.between(first, last)).drop(DAY_PARTITION)

    # -- constructors -------------------------------------------------------
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Wms":
        root = root.rstrip("/")

        def load(name: str) -> DataFrame:
            schema = SCHEMAS[name]
            return spark.read.schema(schema).parquet(f"{root}/{name}")

        return cls(load)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Wms":
        def load(name: str) -> DataFrame:
            schema = SCHEMAS[name]
            df = spark.table(f"{database}.{name}")
            return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])

        return cls(load)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Wms":
        from quaysight.sources.testdata import TestDataDerivation

        derivation = TestDataDerivation(spark, sf_dir)
        return cls(derivation.build)
