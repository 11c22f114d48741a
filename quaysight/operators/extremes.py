"""First and last events per group, ties kept.

Two uses in the shipment activity report:

* loading (``load_first_last``): per shipment code, the time of the first
  'load' transaction and the proper-cased names of the users who made the
  last one (several on a tie);
* locks (``lock_first_last``): per shipment, first and last 'OP' lock time,
  each with the smallest user name found at that time.

Rules kept from the source queries: the extreme time is taken over ALL
matching events, including those whose user is unknown; an event by an
unknown user at the extreme removes that user, it does not promote the next
event; ties give several users.

Plans
-----
``*_first_last`` (default) - one scan of the events, skew-safe: a map-side
    combined aggregation reduces them to one row per (key, time), hashed on
    key AND time, so a group holding a third of all events is spread over many
    tasks and its repeated events collapse before they are shuffled; the
    earliest and the latest of those rows per key are the MIN and MAX of a
    struct that starts with the time (again combined map-side), no join back.
``*_first_last_selfjoin`` - the source shape: the extreme aggregate joined
    back to the events twice (min side, max side), grouped, then joined.
``*_first_last_window`` - ``rank()`` / ``min().over`` per group; one shuffle
    by the group key (a hot group lands in one task).
All three give the same rows (tests/test_rewrites.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaysight.functions.semantics import proper_name

# Codes of the events that count.
LOAD_MENU_OPTION = "RF CHARGER OLPN"
OPEN_LOCK_CODE = "OP"


def _known_users(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_name"), F.col("user_first_name"))


# ---------------------------------------------------------------- loading ---
def load_events(prod_trkg_tran: DataFrame, menu_option: str = LOAD_MENU_OPTION) -> DataFrame:
    return prod_trkg_tran.filter(F.col("menu_optn_name") == menu_option).select(
        F.col("ref_field_1").alias("tc_shipment_id"), F.col("create_date_time"), F.col("user_id"))


def _attach_names(events: DataFrame, user_col: str, users: DataFrame) -> DataFrame:
    """LEFT JOIN the user table: ``_known`` tells whether the user exists."""
    u = _known_users(users).withColumn("_known", F.lit(True))
    return events.join(u, events[user_col] == u.user_name, "left").drop("user_name")


def load_first_last(prod_trkg_tran: DataFrame, ucl_user: DataFrame,
                    menu_option: str = LOAD_MENU_OPTION) -> DataFrame:
    """(tc_shipment_id, start_of_loading, last_loader), skew-safe plan.

    One row per proper-cased last loader; a shipment code whose first load
    was made by an unknown user has no row; when no known user made the last
    load the row carries a NULL last_loader.

    One row per (code, time) holds whether a known user is there and the set
    of their names (a known user may have a NULL name, hence a set of structs);
    events without a code or a time are never an extreme.
    """
    ev = _attach_names(load_events(prod_trkg_tran, menu_option), "user_id", ucl_user)
    known = F.coalesce(F.col("_known"), F.lit(False))
    per_time = (ev.filter(F.col("tc_shipment_id").isNotNull() & F.col("create_date_time").isNotNull())
                .groupBy("tc_shipment_id", "create_date_time").agg(
                    F.max(known).alias("_known"),
                    F.collect_set(F.when(known, F.struct(proper_name("user_first_name").alias("name")))).alias("_names")))
    ends = per_time.groupBy("tc_shipment_id").agg(
        F.min(F.struct("create_date_time", "_known")).alias("_first"),
        F.max(F.struct("create_date_time", "_names")).alias("_last"))
    return ends.filter("_first._known").select(
        "tc_shipment_id", F.col("_first.create_date_time").alias("start_of_loading"),
        F.explode_outer("_last._names").alias("_one")).select(
        "tc_shipment_id", "start_of_loading", F.col("_one.name").alias("last_loader"))


def load_first_last_selfjoin(prod_trkg_tran: DataFrame, ucl_user: DataFrame,
                             menu_option: str = LOAD_MENU_OPTION) -> DataFrame:
    """Source shape: extreme aggregate joined back on (key, time), per side."""
    ev = load_events(prod_trkg_tran, menu_option)
    known = ev.join(_known_users(ucl_user), ev.user_id == F.col("user_name"), "inner")

    def side(fn, name: str) -> DataFrame:
        ext = ev.groupBy("tc_shipment_id").agg(fn("create_date_time").alias(name)).alias("x")
        k = known.alias("k")
        j = k.join(ext, (F.col("k.tc_shipment_id") == F.col("x.tc_shipment_id"))
                   & (F.col("k.create_date_time") == F.col(f"x.{name}")), "left")
        return (j.filter(F.col(f"x.{name}").isNotNull())
                .groupBy(F.col("k.tc_shipment_id").alias("tc_shipment_id"), F.col(f"x.{name}").alias(name),
                         F.col("k.user_first_name").alias("user_first_name"))
                .agg(F.lit(1).alias("_g"))
                .select("tc_shipment_id", name, "user_first_name"))

    mn = side(F.min, "min_created_dttm")
    mx = side(F.max, "max_created_dttm").withColumnRenamed("user_first_name", "last_user")
    j = mn.join(mx, "tc_shipment_id", "left")
    return j.groupBy(
        F.col("tc_shipment_id"), F.col("min_created_dttm").alias("start_of_loading"),
        proper_name("last_user").alias("last_loader")).agg(F.lit(1).alias("_g")).drop("_g")


def load_first_last_window(prod_trkg_tran: DataFrame, ucl_user: DataFrame,
                           menu_option: str = LOAD_MENU_OPTION) -> DataFrame:
    """rank() over each shipment code, computed before the user join."""
    ev = load_events(prod_trkg_tran, menu_option)
    w = Window.partitionBy("tc_shipment_id")
    ranked = ev.select(
        "*", F.min("create_date_time").over(w).alias("_first"),
        F.max("create_date_time").over(w).alias("_last"))
    known = ranked.join(_known_users(ucl_user), ranked.user_id == F.col("user_name"), "inner")
    first = (known.filter(F.col("create_date_time") == F.col("_first"))
             .select("tc_shipment_id", F.col("_first").alias("start_of_loading")).distinct())
    last = (known.filter(F.col("create_date_time") == F.col("_last"))
            .select("tc_shipment_id", proper_name("user_first_name").alias("last_loader")).distinct())
    return first.join(last, "tc_shipment_id", "left").select(
        "tc_shipment_id", "start_of_loading", "last_loader")


# ------------------------------------------------------------------ locks ---
LOCK_COLUMNS = ("shipment_id", "min_created_dttm", "min_first_name", "max_created_dttm", "max_first_name")


def lock_events(lpn: DataFrame, lpn_lock: DataFrame, lock_code: str = OPEN_LOCK_CODE) -> DataFrame:
    """Open locks of pieces that belong to a shipment: (shipment_id, created_dttm, created_source)."""
    pieces = lpn.filter(F.col("shipment_id").isNotNull()).select("lpn_id", "shipment_id")
    locks = lpn_lock.filter(F.col("inventory_lock_code") == lock_code).select(
        "lpn_id", "created_dttm", "created_source")
    return pieces.join(locks, "lpn_id", "inner").select("shipment_id", "created_dttm", "created_source")


def lock_first_last(lpn: DataFrame, lpn_lock: DataFrame, ucl_user: DataFrame,
                    lock_code: str = OPEN_LOCK_CODE) -> DataFrame:
    """Per shipment: first / last open-lock time and the smallest user name at
    each, skew-safe plan.  A side whose extreme was set only by unknown users
    reads NULL; a shipment with neither side known has no row.

    One row per (shipment, time) holds the smallest known user name there and
    whether any known user is there; locks without a time are never an extreme.
    """
    ev = _attach_names(lock_events(lpn, lpn_lock, lock_code), "created_source", ucl_user)
    per_time = ev.filter(F.col("created_dttm").isNotNull()).groupBy("shipment_id", "created_dttm").agg(
        F.max(F.coalesce(F.col("_known"), F.lit(False))).alias("_known"),
        F.min(F.when(F.col("_known"), F.col("user_first_name"))).alias("user_first_name"))
    at = F.struct("created_dttm", "_known", "user_first_name")
    ends = per_time.groupBy("shipment_id").agg(F.min(at).alias("_min"), F.max(at).alias("_max"))
    # an unknown user at the extreme leaves that side NULL
    side = lambda name, field: F.when(F.col(f"{name}._known"), F.col(f"{name}.{field}"))
    return ends.filter("_min._known OR _max._known").select(
        "shipment_id",
        side("_min", "created_dttm").alias("min_created_dttm"), side("_min", "user_first_name").alias("min_first_name"),
        side("_max", "created_dttm").alias("max_created_dttm"), side("_max", "user_first_name").alias("max_first_name"))


def lock_first_last_selfjoin(lpn: DataFrame, lpn_lock: DataFrame, ucl_user: DataFrame,
                             lock_code: str = OPEN_LOCK_CODE) -> DataFrame:
    """Source shape: min and max aggregates LEFT JOINed back on (shipment, time),
    rows kept when either side matched, then MIN per shipment."""
    ev = lock_events(lpn, lpn_lock, lock_code)
    known = ev.join(_known_users(ucl_user), ev.created_source == F.col("user_name"), "inner")
    mn = ev.groupBy("shipment_id").agg(F.min("created_dttm").alias("min_created_dttm"))
    mx = ev.groupBy("shipment_id").agg(F.max("created_dttm").alias("max_created_dttm"))
    k = known.alias("k")
    j = (k.join(mn.alias("mn"), (F.col("k.shipment_id") == F.col("mn.shipment_id"))
                & (F.col("k.created_dttm") == F.col("mn.min_created_dttm")), "left")
         .join(mx.alias("mx"), (F.col("k.shipment_id") == F.col("mx.shipment_id"))
               & (F.col("k.created_dttm") == F.col("mx.max_created_dttm")), "left"))
    matched = F.when(F.col("mn.shipment_id").isNotNull(), 1).when(F.col("mx.shipment_id").isNotNull(), 1).otherwise(0)
    rows = j.filter(matched == 1).select(
        F.col("k.shipment_id").alias("shipment_id"), F.col("mn.min_created_dttm"), F.col("mx.max_created_dttm"),
        F.when(F.col("k.created_dttm") == F.col("mn.min_created_dttm"), F.col("k.user_first_name")).alias("min_first_name"),
        F.when(F.col("k.created_dttm") == F.col("mx.max_created_dttm"), F.col("k.user_first_name")).alias("max_first_name"))
    return rows.groupBy("shipment_id").agg(
        F.min("min_created_dttm").alias("min_created_dttm"), F.min("min_first_name").alias("min_first_name"),
        F.min("max_created_dttm").alias("max_created_dttm"), F.min("max_first_name").alias("max_first_name")
    ).select(*LOCK_COLUMNS)


def lock_first_last_window(lpn: DataFrame, lpn_lock: DataFrame, ucl_user: DataFrame,
                           lock_code: str = OPEN_LOCK_CODE) -> DataFrame:
    """min/max over a window per shipment, before the user join."""
    ev = lock_events(lpn, lpn_lock, lock_code)
    w = Window.partitionBy("shipment_id")
    marked = ev.select("*", F.min("created_dttm").over(w).alias("_first"),
                       F.max("created_dttm").over(w).alias("_last"))
    known = marked.join(_known_users(ucl_user), marked.created_source == F.col("user_name"), "inner")
    at_first, at_last = F.col("created_dttm") == F.col("_first"), F.col("created_dttm") == F.col("_last")
    rows = known.filter(at_first | at_last)
    return rows.groupBy("shipment_id").agg(
        F.min(F.when(at_first, F.col("created_dttm"))).alias("min_created_dttm"),
        F.min(F.when(at_first, F.col("user_first_name"))).alias("min_first_name"),
        F.min(F.when(at_last, F.col("created_dttm"))).alias("max_created_dttm"),
        F.min(F.when(at_last, F.col("user_first_name"))).alias("max_first_name")
    ).select(*LOCK_COLUMNS)
