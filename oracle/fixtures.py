"""Fixture views for the DuckDB oracle: the warehouse tables written as SQL
over the shipped test tables (FIXTURES.md §6).  The Spark side builds the
same tables with the DataFrame API in ``quaysight.sources.testdata``."""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {
    "w_shipment": """
select o_orderkey as shipment_id, case when o_orderkey % 97 = 0 then cast(o_orderkey as string) else 'CH' || lpad(cast(o_orderkey as string), 8, '0') end as tc_shipment_id,
 cast(case when o_orderkey % 101 = 0 then null else 20 + (o_orderkey % 8) * 10 end as int) as shipment_status,
 o_orderdate + (o_orderkey % 1440) * interval '1' minute as pickup_start_dttm,
 case when o_orderkey % 3 = 0 then null else 'DSG' || cast(o_custkey % 5 as string) end as dsg_carrier_code,
 'CARR' || cast(o_custkey % 7 as string) as assigned_carrier_code,
 'ST' || cast(o_custkey as string) as broker_ref,
 case when o_orderkey % 11 = 0 then null else o_orderkey % (select count(*) + 50 from part) end as staging_locn_id,
 cast(o_custkey % 33 as int) as size1_value from orders
""",
    "w_do_orders": """
select o_orderkey as order_id, case when o_orderkey % 4 = 0 then '20' else '10' end as do_type from orders
""",
    "w_lpn": """
select l_orderkey * 10000000 + l_partkey * 10 + l_linenumber as lpn_id, l_orderkey as order_id,
 case when l_partkey % 13 = 0 then null when l_linenumber = 7 then l_orderkey + 1 else l_orderkey end as shipment_id,
 case when l_partkey % 13 = 0 then null else case when l_orderkey % 97 = 0 then cast(l_orderkey as string) else 'CH' || lpad(cast(l_orderkey as string), 8, '0') end end as tc_shipment_id,
 cast(case l_partkey % 8 when 0 then 10 when 1 then 20 when 2 then 30 when 3 then 35 when 4 then 50 when 5 then 50 when 6 then 90 else null end as int) as lpn_facility_status,
 case l_suppkey % 6 when 0 then '03' when 1 then '05' when 2 then '06' when 3 then 'PTS' when 4 then '10' else null end as container_type,
 case when l_suppkey % 9 = 0 then null else (l_orderkey + l_partkey) % (select count(*) + 50 from part) end as curr_sub_locn_id,
 'F' || cast(l_suppkey % 5 as string) as d_facility_alias_id, l_quantity as estimated_weight from lineitem
""",
    "w_locn_hdr": """
select p_partkey as locn_id, case p_partkey % 5 when 0 then 'R' when 1 then 'P' when 2 then 'S' when 3 then 'X' else null end as locn_class,
 'A' || cast(p_size as string) as aisle, case when p_partkey % 7 = 0 then null else lpad(cast(p_partkey as string), 2, '0') end as lvl, p_name as dsp_locn from part
""",
    "w_dock_door": """
select n_nationkey as dock_door_id, 'Q' || lpad(cast(n_nationkey as string), 3, '0') as dock_door_name from nation
""",
    "w_dock_door_ref": """
select o_orderkey as shipment_id, cast(o_custkey % 25 as int) as dock_door_id from orders where o_orderkey % 2 = 0
 union all select o_orderkey, cast((o_custkey + 1) % 25 as int) from orders where o_orderkey % 10 = 0
""",
    "w_stop": """
select distinct l_orderkey as shipment_id, l_linenumber as stop_seq, 'F' || cast(l_linenumber % 5 as string) as facility_alias_id from lineitem
""",
    "w_facility_alias": """
select 'F' || cast(r_regionkey as string) as facility_alias_id, r_name as city from region
""",
    "w_prod_trkg_tran": """
select case when l_orderkey % 97 = 0 then cast(l_orderkey as string) else 'CH' || lpad(cast(l_orderkey as string), 8, '0') end as ref_field_1, case when l_returnflag = 'R' then 'RF AUTRE' else 'RF CHARGER OLPN' end as menu_optn_name,
 o_orderdate + (l_linenumber % 3) * interval '1' hour as create_date_time, 'U' || cast((l_suppkey + l_partkey) % (select count(*) + 25 from customer) as string) as user_id, l_partkey as seq_nbr
 from lineitem join orders on l_orderkey = o_orderkey
""",
    "w_ucl_user": """
select 'U' || cast(c_custkey as string) as user_name, case when c_custkey = 2 then null else lower(c_mktsegment) end as user_first_name from customer
""",
    "w_lpn_lock": """
select l_orderkey * 10000000 + l_partkey * 10 + l_linenumber as lpn_id, case when l_linestatus = 'O' then 'OP' else 'QH' end as inventory_lock_code,
 o_orderdate + (l_linenumber % 3) * interval '1' hour as created_dttm, 'U' || cast(l_partkey % (select count(*) + 25 from customer) as string) as created_source
 from lineitem join orders on l_orderkey = o_orderkey
""",
    "w_shipment_note": """
select o_orderkey as shipment_id, case when o_orderkey % 17 = 0 then '#' else case o_custkey % 5 when 0 then '#' when 1 then '$' when 2 then '@' when 3 then '+' else 'x' end || o_orderpriority end as note from orders
 union all select o_orderkey, '@' || o_orderstatus from orders where o_orderkey % 6 = 0
 union all select o_orderkey, '#second' from orders where o_orderkey % 30 = 0
""",
    "w_ilm_appointments": """
select event_id as appointment_id, '11' || lpad(cast(event_id as string), 6, '0') as tc_appointment_id, ts as scheduled_dttm, cast(event_id % 6 as int) as appt_status, props as comments from events
""",
    "w_ilm_appointment_status": """
select r_regionkey as appt_status_code, r_name as description from region
""",
    "w_ilm_appointment_objects": """
select event_id as appointment_id, event_id as appt_obj_id, cast(case when event_id % 11 = 0 then 30 else 40 end as int) as appt_obj_type from events where event_id % 5 <> 4
 union all select event_id, event_id + 1, cast(40 as int) from events where event_id % 3 = 0 and event_id % 5 <> 4
""",
    "w_purchase_orders": """
select o_orderkey as purchase_orders_id, case o_custkey % 4 when 0 then 'G' when 1 then 'C' else '3' end || lpad(cast(o_orderkey as string), 7, '0') as tc_purchase_orders_id,
 cast(case when o_orderkey % 29 = 0 then null when o_orderstatus = 'F' then 950 else 400 end as int) as purchase_orders_status, cast(o_custkey % 12 as bigint) as business_partner_id from orders
""",
    "w_purchase_orders_line_item": """
select l_orderkey as purchase_orders_id, l_linenumber as line_nbr from lineitem
""",
    "w_business_partner": """
select s_suppkey as business_partner_id, s_name as description from supplier
""",
    "w_purchase_orders_status": """
select cast(case r_regionkey when 0 then 400 else 950 end as int) as purchase_orders_status from region where r_regionkey < 2
""",
    "w_purchase_orders_note": """
select o_orderkey as purchase_orders_id, case o_orderkey % 9 when 0 then 'PU' when 1 then 'CU' when 2 then 'WU' when 3 then 'P0' when 4 then 'C0' when 5 then 'W0' when 6 then 'UR' else 'ZZ' end || o_orderpriority as note from orders where o_orderkey % 9 <> 8
 union all select o_orderkey, 'URsecond' from orders where o_orderkey % 7 = 0
""",
    "w_ilm_appt_custom_attribute": """
select event_id as appointment_id, 'NUM_CNT' as attribute_name, 'CNT' || cast(event_id as string) as attribute_value from events where event_id % 2 = 0
 union all select event_id, 'NB_PALETTE', case when event_id % 10 = 0 then '12.6' else cast(event_id % 34 as string) end from events where event_id % 3 <> 0
 union all select event_id, 'NBR_COLIS', cast(event_id % 500 as string) from events where event_id % 4 <> 0
 union all select event_id, 'ARRIVAL_DTTM', cast(event_id % 24 as string) || 'h' from events where event_id % 5 = 0
 union all select event_id, 'SEND_TO_DOCK', 'Y' from events where event_id % 6 = 0
 union all select event_id, 'CUST_COMMENTS', props from events where event_id % 7 = 0
 union all select event_id, 'CUST_COMMENTS', 'second' from events where event_id % 70 = 0
""",
    "w_ilm_appt_slots": """
select event_id as appointment_id, cast(event_id % 16 as int) as slot_id from events where event_id % 20 <> 19
""",
    "w_slots": """
select n_nationkey as slot_id, case n_nationkey when 0 then 'BATIMENT A' when 1 then 'BATIMENT A (EXTERIEUR)' when 2 then 'BATIMENT A (INTERIEUR)' when 3 then 'BATIMENT A (CONTAINER)' when 4 then 'BATIMENT B' when 5 then 'BATIMENT B (CAMION)' when 6 then 'BATIMENT B (CONTAINER)' when 7 then 'BATIMENT C' when 8 then 'BATIMENT C (CAMION)' when 9 then 'BATIMENT C (CONTAINER)' when 10 then 'BATIMENT C1' when 11 then 'RDV DECOCLICO' when 12 then 'RDV LOL' when 13 then 'RDV RETOURS CONTENANT/MAGS' when 14 then 'AUTRE' end as description from nation where n_nationkey < 15
""",
    "w_trailer_visit_detail": """
select event_id as appointment_id, event_id as visit_id, event_type as type, 'SEAL' || cast(event_id as string) as seal_number from events where event_id % 4 <> 3
""",
    "w_trailer_visit": """
select event_id as visit_id, user_id as trailer_id, case when event_id % 13 = 0 then null else ts + interval '30' minute end as checkin_dttm,
 case when event_id % 3 = 0 then null else ts + interval '150' minute end as checkout_dttm from events
""",
    "w_trailer_ref": """
select event_id as active_visit_id, event_id % (select count(*) + 50 from part) as current_location_id from events where event_id % 2 = 0
""",
    "w_ilm_tasks": """
select user_id as trailer_id, ts as created_dttm, ts + cast(event_id % 5 as int) * interval '10' minute as last_updated_dttm from events where event_type = 'click'
""",
}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with a WITH clause holding the fixture views it uses
    (views referencing views are not needed: every fixture reads base tables)."""
    used = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS (\n{FIXTURE_SQL[n].strip()}\n)" for n in used)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
