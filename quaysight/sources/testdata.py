"""Warehouse tables derived from the shipped TPC-H-style test data.

The reports need 27 warehouse tables; the test data holds TPC-H-style tables
and an event log.  Each warehouse table here is a deterministic projection of
one or two test tables (the derivation is documented in FIXTURES.md §6 and the
DuckDB oracle uses the same rules written as SQL), so its size grows with the
scale factor.  All rules below are fixture rules, not report logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.sources.schemas import SCHEMAS


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, mapping: dict, otherwise=None) -> Column:
    """CASE key WHEN k THEN v ... ELSE otherwise END."""
    out = None
    for k, v in mapping.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(otherwise))


def _tc_code(key: Column) -> Column:
    """External shipment code: bare key every 97th key, else 'CH' + 8 digits."""
    return F.when(key % 97 == 0, _s(key)).otherwise(F.concat(F.lit("CH"), F.lpad(_s(key), 8, "0")))


def _plus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


# Fixed values of the fixture: slot descriptions by slot id (FIXTURES.md §6).
SLOT_DESCRIPTIONS = {
    0: "BATIMENT A", 1: "BATIMENT A (EXTERIEUR)", 2: "BATIMENT A (INTERIEUR)",
    3: "BATIMENT A (CONTAINER)", 4: "BATIMENT B", 5: "BATIMENT B (CAMION)",
    6: "BATIMENT B (CONTAINER)", 7: "BATIMENT C", 8: "BATIMENT C (CAMION)",
    9: "BATIMENT C (CONTAINER)", 10: "BATIMENT C1", 11: "RDV DECOCLICO", 12: "RDV LOL",
    13: "RDV RETOURS CONTENANT/MAGS", 14: "AUTRE",
}


class TestDataDerivation:
    """Builds each warehouse table lazily from ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}

    def base(self, name: str) -> DataFrame:
        """The shipped table (read once; several warehouse tables derive from it)."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._base[name]

    def _rows(self, name: str) -> int:
        """Rows of a shipped table (read from its file's metadata)."""
        if name not in self._counts:
            self._counts[name] = self.base(name).count()
        return self._counts[name]

    def _location(self, key: Column) -> Column:
        """A location id: a row of ``locn_hdr``, or one of 50 unknown ids."""
        return key % F.lit(self._rows("part") + 50)

    def _user(self, key: Column) -> Column:
        """A user name: a row of ``ucl_user``, or one of 25 unknown names."""
        return F.concat(F.lit("U"), _s(key % F.lit(self._rows("customer") + 25)))

    def build(self, name: str) -> DataFrame:
        df = getattr(self, f"_{name}")()
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])

    # -- outbound -------------------------------------------------------
    def _shipment(self) -> DataFrame:
        o = self.base("orders")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        return o.select(
            k.alias("shipment_id"),
            _tc_code(k).alias("tc_shipment_id"),
            F.when(k % 101 == 0, F.lit(None)).otherwise(20 + (k % 8) * 10).alias("shipment_status"),
            _plus_minutes(F.col("o_orderdate"), k % 1440).alias("pickup_start_dttm"),
            F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("DSG"), _s(cust % 5))).alias("dsg_carrier_code"),
            F.concat(F.lit("CARR"), _s(cust % 7)).alias("assigned_carrier_code"),
            F.concat(F.lit("ST"), _s(cust)).alias("broker_ref"),
            F.when(k % 11 == 0, F.lit(None)).otherwise(self._location(k)).alias("staging_locn_id"),
            (cust % 33).alias("size1_value"))

    def _do_orders(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.base("orders").select(
            k.alias("order_id"), F.when(k % 4 == 0, F.lit("20")).otherwise(F.lit("10")).alias("do_type"))

    def _lpn(self) -> DataFrame:
        li = self.base("lineitem")
        ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        no_ship = pk % 13 == 0
        return li.select(
            (ok * 10000000 + pk * 10 + ln).alias("lpn_id"),
            ok.alias("order_id"),
            F.when(no_ship, F.lit(None)).when(ln == 7, ok + 1).otherwise(ok).alias("shipment_id"),
            F.when(no_ship, F.lit(None)).otherwise(_tc_code(ok)).alias("tc_shipment_id"),
            _case(pk % 8, {0: 10, 1: 20, 2: 30, 3: 35, 4: 50, 5: 50, 6: 90}).alias("lpn_facility_status"),
            _case(sk % 6, {0: "03", 1: "05", 2: "06", 3: "PTS", 4: "10"}).alias("container_type"),
            F.when(sk % 9 == 0, F.lit(None)).otherwise(self._location(ok + pk)).alias("curr_sub_locn_id"),
            F.concat(F.lit("F"), _s(sk % 5)).alias("d_facility_alias_id"),
            F.col("l_quantity").alias("estimated_weight"))

    def _locn_hdr(self) -> DataFrame:
        p = self.base("part")
        pk = F.col("p_partkey")
        return p.select(
            pk.alias("locn_id"),
            _case(pk % 5, {0: "R", 1: "P", 2: "S", 3: "X"}).alias("locn_class"),
            F.concat(F.lit("A"), _s(F.col("p_size"))).alias("aisle"),
            F.when(pk % 7 == 0, F.lit(None)).otherwise(F.lpad(_s(pk), 2, "0")).alias("lvl"),
            F.col("p_name").alias("dsp_locn"))

    def _dock_door(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.base("nation").select(
            n.alias("dock_door_id"), F.concat(F.lit("Q"), F.lpad(_s(n), 3, "0")).alias("dock_door_name"))

    def _dock_door_ref(self) -> DataFrame:
        o = self.base("orders")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        first = o.filter(k % 2 == 0).select(k.alias("shipment_id"), (cust % 25).alias("dock_door_id"))
        second = o.filter(k % 10 == 0).select(k.alias("shipment_id"), ((cust + 1) % 25).alias("dock_door_id"))
        return first.unionByName(second)

    def _stop(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("shipment_id"), ln.alias("stop_seq"),
            F.concat(F.lit("F"), _s(ln % 5)).alias("facility_alias_id")).distinct()

    def _facility_alias(self) -> DataFrame:
        return self.base("region").select(
            F.concat(F.lit("F"), _s(F.col("r_regionkey"))).alias("facility_alias_id"),
            F.col("r_name").alias("city"))

    def _line_with_order_date(self) -> DataFrame:
        li = self.base("lineitem")
        o = self.base("orders").select("o_orderkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey, "inner")

    def _prod_trkg_tran(self) -> DataFrame:
        j = self._line_with_order_date()
        return j.select(
            _tc_code(F.col("l_orderkey")).alias("ref_field_1"),
            F.when(F.col("l_returnflag") == "R", F.lit("RF AUTRE"))
            .otherwise(F.lit("RF CHARGER OLPN")).alias("menu_optn_name"),
            F.timestamp_add("HOUR", F.col("l_linenumber") % 3, F.col("o_orderdate")).alias("create_date_time"),
            self._user(F.col("l_suppkey") + F.col("l_partkey")).alias("user_id"),
            F.col("l_partkey").alias("seq_nbr"))

    def _ucl_user(self) -> DataFrame:
        c = self.base("customer")
        return c.select(
            F.concat(F.lit("U"), _s(F.col("c_custkey"))).alias("user_name"),
            F.when(F.col("c_custkey") == 2, F.lit(None))
            .otherwise(F.lower(F.col("c_mktsegment"))).alias("user_first_name"))

    def _lpn_lock(self) -> DataFrame:
        j = self._line_with_order_date()
        ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        return j.select(
            (ok * 10000000 + pk * 10 + ln).alias("lpn_id"),
            F.when(F.col("l_linestatus") == "O", F.lit("OP")).otherwise(F.lit("QH")).alias("inventory_lock_code"),
            F.timestamp_add("HOUR", ln % 3, F.col("o_orderdate")).alias("created_dttm"),
            self._user(pk).alias("created_source"))

    def _shipment_note(self) -> DataFrame:
        o = self.base("orders")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        tag = _case(cust % 5, {0: "#", 1: "$", 2: "@", 3: "+"}, "x")
        main = o.select(k.alias("shipment_id"),
                        F.when(k % 17 == 0, F.lit("#"))
                        .otherwise(F.concat(tag, F.col("o_orderpriority"))).alias("note"))
        status = o.filter(k % 6 == 0).select(k.alias("shipment_id"),
                                             F.concat(F.lit("@"), F.col("o_orderstatus")).alias("note"))
        second = o.filter(k % 30 == 0).select(k.alias("shipment_id"), F.lit("#second").alias("note"))
        return main.unionByName(status).unionByName(second)

    # -- inbound --------------------------------------------------------
    def _ilm_appointments(self) -> DataFrame:
        e = F.col("event_id")
        return self.base("events").select(
            e.alias("appointment_id"),
            F.concat(F.lit("11"), F.lpad(_s(e), 6, "0")).alias("tc_appointment_id"),
            F.col("ts").alias("scheduled_dttm"), (e % 6).alias("appt_status"),
            F.col("props").alias("comments"))

    def _ilm_appointment_status(self) -> DataFrame:
        return self.base("region").select(F.col("r_regionkey").alias("appt_status_code"),
                                          F.col("r_name").alias("description"))

    def _ilm_appointment_objects(self) -> DataFrame:
        ev = self.base("events")
        e = F.col("event_id")
        first = ev.filter(e % 5 != 4).select(
            e.alias("appointment_id"), e.alias("appt_obj_id"),
            F.when(e % 11 == 0, F.lit(30)).otherwise(F.lit(40)).alias("appt_obj_type"))
        second = ev.filter((e % 3 == 0) & (e % 5 != 4)).select(
            e.alias("appointment_id"), (e + 1).alias("appt_obj_id"), F.lit(40).alias("appt_obj_type"))
        return first.unionByName(second)

    def _purchase_orders(self) -> DataFrame:
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        prefix = _case(cust % 4, {0: "G", 1: "C"}, "3")
        return self.base("orders").select(
            k.alias("purchase_orders_id"),
            F.concat(prefix, F.lpad(_s(k), 7, "0")).alias("tc_purchase_orders_id"),
            F.when(k % 29 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", F.lit(950))
            .otherwise(F.lit(400)).alias("purchase_orders_status"),
            (cust % 12).alias("business_partner_id"))

    def _purchase_orders_line_item(self) -> DataFrame:
        return self.base("lineitem").select(F.col("l_orderkey").alias("purchase_orders_id"),
                                            F.col("l_linenumber").alias("line_nbr"))

    def _business_partner(self) -> DataFrame:
        return self.base("supplier").select(F.col("s_suppkey").alias("business_partner_id"),
                                            F.col("s_name").alias("description"))

    def _purchase_orders_status(self) -> DataFrame:
        r = self.base("region").filter(F.col("r_regionkey") < 2)
        return r.select(F.when(F.col("r_regionkey") == 0, F.lit(400)).otherwise(F.lit(950))
                        .alias("purchase_orders_status"))

    def _purchase_orders_note(self) -> DataFrame:
        o = self.base("orders")
        k = F.col("o_orderkey")
        code = _case(k % 9, {0: "PU", 1: "CU", 2: "WU", 3: "P0", 4: "C0", 5: "W0", 6: "UR"}, "ZZ")
        main = o.filter(k % 9 != 8).select(k.alias("purchase_orders_id"),
                                           F.concat(code, F.col("o_orderpriority")).alias("note"))
        second = o.filter(k % 7 == 0).select(k.alias("purchase_orders_id"), F.lit("URsecond").alias("note"))
        return main.unionByName(second)

    def _ilm_appt_custom_attribute(self) -> DataFrame:
        ev = self.base("events")
        e = F.col("event_id")

        def part(cond, name, value):
            return ev.filter(cond).select(e.alias("appointment_id"), F.lit(name).alias("attribute_name"),
                                          value.alias("attribute_value"))

        parts = [
            part(e % 2 == 0, "NUM_CNT", F.concat(F.lit("CNT"), _s(e))),
            part(e % 3 != 0, "NB_PALETTE", F.when(e % 10 == 0, F.lit("12.6")).otherwise(_s(e % 34))),
            part(e % 4 != 0, "NBR_COLIS", _s(e % 500)),
            part(e % 5 == 0, "ARRIVAL_DTTM", F.concat(_s(e % 24), F.lit("h"))),
            part(e % 6 == 0, "SEND_TO_DOCK", F.lit("Y")),
            part(e % 7 == 0, "CUST_COMMENTS", F.col("props")),
            part(e % 70 == 0, "CUST_COMMENTS", F.lit("second")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _ilm_appt_slots(self) -> DataFrame:
        e = F.col("event_id")
        return self.base("events").filter(e % 20 != 19).select(e.alias("appointment_id"),
                                                               (e % 16).alias("slot_id"))

    def _slots(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.base("nation").filter(n < 15).select(
            n.alias("slot_id"), _case(n, SLOT_DESCRIPTIONS).alias("description"))

    def _trailer_visit_detail(self) -> DataFrame:
        e = F.col("event_id")
        return self.base("events").filter(e % 4 != 3).select(
            e.alias("appointment_id"), e.alias("visit_id"), F.col("event_type").alias("type"),
            F.concat(F.lit("SEAL"), _s(e)).alias("seal_number"))

    def _trailer_visit(self) -> DataFrame:
        e, ts = F.col("event_id"), F.col("ts")
        return self.base("events").select(
            e.alias("visit_id"), F.col("user_id").alias("trailer_id"),
            F.when(e % 13 == 0, F.lit(None)).otherwise(_plus_minutes(ts, F.lit(30))).alias("checkin_dttm"),
            F.when(e % 3 == 0, F.lit(None)).otherwise(_plus_minutes(ts, F.lit(150))).alias("checkout_dttm"))

    def _trailer_ref(self) -> DataFrame:
        e = F.col("event_id")
        return self.base("events").filter(e % 2 == 0).select(e.alias("active_visit_id"),
                                                             self._location(e).alias("current_location_id"))

    def _ilm_tasks(self) -> DataFrame:
        e, ts = F.col("event_id"), F.col("ts")
        return self.base("events").filter(F.col("event_type") == "click").select(
            F.col("user_id").alias("trailer_id"), ts.alias("created_dttm"),
            _plus_minutes(ts, (e % 5) * 10).alias("last_updated_dttm"))
