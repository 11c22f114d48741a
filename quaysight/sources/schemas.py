"""Explicit schemas of the 27 warehouse tables the reports read.

Only the columns the reports use are declared; a wider source table is
projected to these columns on read, so parquet scans prune everything else.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "shipment": _schema(
        ("shipment_id", _L), ("tc_shipment_id", _S), ("shipment_status", _I),
        ("pickup_start_dttm", _TS), ("dsg_carrier_code", _S), ("assigned_carrier_code", _S),
        ("broker_ref", _S), ("staging_locn_id", _L), ("size1_value", _I)),
    "do_orders": _schema(("order_id", _L), ("do_type", _S)),
    "lpn": _schema(
        ("lpn_id", _L), ("order_id", _L), ("shipment_id", _L), ("tc_shipment_id", _S),
        ("lpn_facility_status", _I), ("container_type", _S), ("curr_sub_locn_id", _L),
        ("d_facility_alias_id", _S), ("estimated_weight", _D)),
    "locn_hdr": _schema(("locn_id", _L), ("locn_class", _S), ("aisle", _S), ("lvl", _S), ("dsp_locn", _S)),
    "dock_door": _schema(("dock_door_id", _I), ("dock_door_name", _S)),
    "dock_door_ref": _schema(("shipment_id", _L), ("dock_door_id", _I)),
    "stop": _schema(("shipment_id", _L), ("stop_seq", _I), ("facility_alias_id", _S)),
    "facility_alias": _schema(("facility_alias_id", _S), ("city", _S)),
    "prod_trkg_tran": _schema(
        ("ref_field_1", _S), ("menu_optn_name", _S), ("create_date_time", _TS),
        ("user_id", _S), ("seq_nbr", _L)),
    "ucl_user": _schema(("user_name", _S), ("user_first_name", _S)),
    "lpn_lock": _schema(
        ("lpn_id", _L), ("inventory_lock_code", _S), ("created_dttm", _TS), ("created_source", _S)),
    "shipment_note": _schema(("shipment_id", _L), ("note", _S)),
    "ilm_appointments": _schema(
        ("appointment_id", _L), ("tc_appointment_id", _S), ("scheduled_dttm", _TS),
        ("appt_status", _I), ("comments", _S)),
    "ilm_appointment_status": _schema(("appt_status_code", _I), ("description", _S)),
    "ilm_appointment_objects": _schema(("appointment_id", _L), ("appt_obj_id", _L), ("appt_obj_type", _I)),
    "purchase_orders": _schema(
        ("purchase_orders_id", _L), ("tc_purchase_orders_id", _S),
        ("purchase_orders_status", _I), ("business_partner_id", _L)),
    "purchase_orders_line_item": _schema(("purchase_orders_id", _L), ("line_nbr", _I)),
    "business_partner": _schema(("business_partner_id", _L), ("description", _S)),
    "purchase_orders_status": _schema(("purchase_orders_status", _I),),
    "purchase_orders_note": _schema(("purchase_orders_id", _L), ("note", _S)),
    "ilm_appt_custom_attribute": _schema(
        ("appointment_id", _L), ("attribute_name", _S), ("attribute_value", _S)),
    "ilm_appt_slots": _schema(("appointment_id", _L), ("slot_id", _I)),
    "slots": _schema(("slot_id", _I), ("description", _S)),
    "trailer_visit_detail": _schema(
        ("appointment_id", _L), ("visit_id", _L), ("type", _S), ("seal_number", _S)),
    "trailer_visit": _schema(
        ("visit_id", _L), ("trailer_id", _L), ("checkin_dttm", _TS), ("checkout_dttm", _TS)),
    "trailer_ref": _schema(("active_visit_id", _L), ("current_location_id", _L)),
    "ilm_tasks": _schema(("trailer_id", _L), ("created_dttm", _TS), ("last_updated_dttm", _TS)),
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)

# Columns declared to be a table's key.  A declaration is not trusted: ``Wms.has_key``
# verifies it once before a plan relies on it.
KEYS: dict[str, tuple[str, ...]] = {
    "business_partner": ("business_partner_id",),
    "purchase_orders_status": ("purchase_orders_status",),
}

# Tables that ``Wms.stage(by_day=True)`` stores by day, and the time whose day is
# their partition column.
DAY_PARTITION = "day_of_window"
DAY_COLUMNS: dict[str, str] = {
    "shipment": "pickup_start_dttm",
    "ilm_appointments": "scheduled_dttm",
}
