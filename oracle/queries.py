"""DuckDB statements of every named query, written from the reports' rules
(not from the Spark code): literal fan-out joins where the Spark plan
pre-aggregates, window functions where the Spark plan joins on extremes,
three aggregations where the Spark plan makes one pass.

Source-dialect rules are spelled out in SQL: SUBSTR out of range -> NULL
(CASE on length), '' -> NULL, '||' ignoring NULL (``nullif(concat(..),'')``),
ROUND half away from zero, CAST(text AS INTEGER) rounding.
DuckDB SUM over integers is HUGEINT; it is cast to BIGINT to match Spark.
"""

from __future__ import annotations

import datetime as dt

from oracle.fixtures import with_fixtures

ACTIVITY_AS_OF = dt.datetime(2001, 7, 20, 12, 0, 0)
APPOINTMENT_AS_OF = dt.datetime(2024, 1, 10, 12, 0, 0)
APPOINTMENT_AS_OF_FRIDAY = dt.datetime(2024, 1, 12, 12, 0, 0)


def ts(t: dt.datetime) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


def d(t: dt.datetime) -> str:
    return f"DATE '{t:%Y-%m-%d}'"


# ---------------------------------------------------------------- snippets --
def proper(x: str) -> str:
    return f"nullif(concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2, 50))), '')"


def code_left(x: str) -> str:
    return f"CASE WHEN length({x}) > 5 THEN substr({x}, 1, length({x}) - 5) END"


def code_right(x: str) -> str:
    return f"CASE WHEN length({x}) >= 5 THEN right({x}, 5) END"


def note_body(x: str) -> str:
    return f"CASE WHEN length({x}) >= 2 THEN substr({x}, 2, 499) END"


def location(aisle: str, lvl: str) -> str:
    return f"nullif(concat(CASE WHEN length({aisle}) >= 1 THEN right({aisle}, 1) END, {lvl}), '')"


def door(name: str) -> str:
    return (f"nullif(concat(CASE WHEN length({name}) >= 1 THEN left({name}, 1) END, "
            f"CASE WHEN length({name}) >= 2 THEN right({name}, 2) END), '')")


def fmt(x: str, mask: str) -> str:
    return f"strftime({x}, '{mask}')"


DMY_HM, DM, HM, DM_HM = "%d/%m/%y %H:%M", "%d/%m", "%H:%M", "%d/%m %H:%M"

MECA = "('03', '05', '06', 'PTS')"


def pieces_sql(prep_classes: str, loaded: str, extra_cols: str = "") -> str:
    return f"""
    SELECT l.shipment_id, l.container_type{extra_cols},
      CASE WHEN l.lpn_facility_status < 20
             OR (l.lpn_facility_status BETWEEN 20 AND 30 AND (h.locn_class IN {prep_classes} OR h.locn_class IS NULL))
           THEN 1 ELSE 0 END AS prep,
      CASE WHEN (l.lpn_facility_status BETWEEN 20 AND 30 AND h.locn_class = 'S')
             OR l.lpn_facility_status BETWEEN 31 AND 49
           THEN 1 ELSE 0 END AS ancr,
      CASE WHEN l.lpn_facility_status {loaded} THEN 1 ELSE 0 END AS chgt
    FROM w_lpn l LEFT JOIN w_locn_hdr h ON l.curr_sub_locn_id = h.locn_id
    WHERE l.shipment_id IS NOT NULL"""


ACT_PIECES = pieces_sql("('R', 'P')", ">= 50")
DOCK_PIECES = pieces_sql("('R')", "= 50", ", l.d_facility_alias_id")

SEGMENT_WHERE = {
    "global": "TRUE",
    "meca": f"container_type IN {MECA}",
    "tradi": f"(NOT container_type IN {MECA} OR container_type IS NULL)",
}


def share(flag: str) -> str:
    return f"CAST(round(sum({flag}) * 100.0 / count(*)) AS INTEGER)"


def share_cols(prefix: str = "") -> str:
    pad = " || ' / ' || ".join(f"lpad(CAST({share(f)} AS VARCHAR), 3, '0')" for f in ("prep", "ancr", "chgt"))
    return ",\n      ".join([
        f"{share('prep')} AS {prefix}prep", f"{share('ancr')} AS {prefix}ancr", f"{share('chgt')} AS {prefix}chgt",
        f"{pad} AS {prefix}advancement",
        f"CAST(sum(prep) AS BIGINT) AS {prefix}nb_prep", f"CAST(sum(ancr) AS BIGINT) AS {prefix}nb_ancr",
        f"CAST(sum(chgt) AS BIGINT) AS {prefix}nb_chgt"])


def segment_agg(seg: str, prefix: str = "") -> str:
    return f"""SELECT shipment_id,
      {share_cols(prefix)}
    FROM pieces WHERE {SEGMENT_WHERE[seg]} GROUP BY shipment_id"""


def counts_agg(seg: str) -> str:
    return f"""SELECT shipment_id,
      CAST(sum(prep) AS BIGINT) AS nb_prep, CAST(sum(ancr) AS BIGINT) AS nb_ancr,
      CAST(sum(chgt) AS BIGINT) AS nb_chgt, count(*) AS nb_pieces
    FROM pieces WHERE {SEGMENT_WHERE[seg]} GROUP BY shipment_id"""


def segments_sql() -> str:
    cols = ", ".join(f"{s}.{s}_{c}" for s in ("global", "meca", "tradi")
                     for c in ("nb_prep", "nb_ancr", "nb_chgt", "prep", "ancr", "chgt", "advancement"))
    return f"""WITH pieces AS ({ACT_PIECES}),
  global AS ({segment_agg('global', 'global_')}),
  meca AS ({segment_agg('meca', 'meca_')}),
  tradi AS ({segment_agg('tradi', 'tradi_')})
SELECT global.shipment_id, {cols}
FROM global LEFT JOIN meca ON global.shipment_id = meca.shipment_id
LEFT JOIN tradi ON global.shipment_id = tradi.shipment_id"""


def load_first_last_sql() -> str:
    return f"""WITH ev AS (
    SELECT ref_field_1 AS tc_shipment_id, create_date_time AS t, user_id,
      min(create_date_time) OVER (PARTITION BY ref_field_1) AS t_first,
      max(create_date_time) OVER (PARTITION BY ref_field_1) AS t_last
    FROM w_prod_trkg_tran WHERE menu_optn_name = 'RF CHARGER OLPN'),
  named AS (SELECT ev.*, u.user_first_name FROM ev JOIN w_ucl_user u ON u.user_name = ev.user_id),
  firsts AS (SELECT DISTINCT tc_shipment_id, t_first FROM named WHERE t = t_first),
  lasts AS (SELECT DISTINCT tc_shipment_id, {proper('user_first_name')} AS last_loader FROM named WHERE t = t_last)
SELECT f.tc_shipment_id, f.t_first AS start_of_loading, l.last_loader
FROM firsts f LEFT JOIN lasts l ON f.tc_shipment_id = l.tc_shipment_id"""


def lock_first_last_sql() -> str:
    return """WITH ev AS (
    SELECT l.shipment_id, k.created_dttm AS t, k.created_source,
      min(k.created_dttm) OVER (PARTITION BY l.shipment_id) AS t_first,
      max(k.created_dttm) OVER (PARTITION BY l.shipment_id) AS t_last
    FROM w_lpn l JOIN w_lpn_lock k ON k.lpn_id = l.lpn_id
    WHERE k.inventory_lock_code = 'OP' AND l.shipment_id IS NOT NULL)
SELECT ev.shipment_id,
  min(CASE WHEN t = t_first THEN t END) AS min_created_dttm,
  min(CASE WHEN t = t_first THEN u.user_first_name END) AS min_first_name,
  min(CASE WHEN t = t_last THEN t END) AS max_created_dttm,
  min(CASE WHEN t = t_last THEN u.user_first_name END) AS max_first_name
FROM ev JOIN w_ucl_user u ON u.user_name = ev.created_source
WHERE t = t_first OR t = t_last
GROUP BY ev.shipment_id"""


def active_where(alias: str, as_of: dt.datetime) -> str:
    return (f"{alias}.shipment_status BETWEEN 40 AND 79 "
            f"AND CAST({alias}.pickup_start_dttm AS DATE) > CAST({ts(as_of)} AS DATE) - 4")


def not_closed_sql(as_of: dt.datetime) -> str:
    lo = f"CAST(CAST({ts(as_of)} AS DATE) - 10 AS TIMESTAMP)"
    hi = f"CAST(CAST({ts(as_of)} AS DATE) - 5 AS TIMESTAMP)"
    return f"""SELECT string_agg(s.tc_shipment_id, ' ' ORDER BY s.tc_shipment_id) AS not_closed
FROM w_shipment s
WHERE s.shipment_status BETWEEN 40 AND 79
  AND s.pickup_start_dttm BETWEEN {lo} AND {hi}
  AND EXISTS (SELECT 1 FROM w_lpn l WHERE l.shipment_id = s.shipment_id)"""


def tagged(tag: str, alias: str) -> str:
    return f"(SELECT shipment_id, {note_body('note')} AS {alias} FROM w_shipment_note WHERE left(note, 1) = '{tag}')"


def shipment_activity_sql(as_of: dt.datetime) -> str:
    seg_cols = ",\n  ".join(
        [f"{s}.advancement AS {s}_advancement, {s}.prep AS {s}_prep, {s}.ancr AS {s}_ancr, {s}.chgt AS {s}_chgt"
         for s in ("global", "meca", "tradi")]
        + [f"{s}.nb_prep AS {s}_nb_prep, {s}.nb_ancr AS {s}_nb_ancr, {s}.nb_chgt AS {s}_nb_chgt"
           for s in ("global", "meca", "tradi")])
    return f"""WITH pieces AS ({ACT_PIECES}),
  global AS ({segment_agg('global')}),
  meca AS ({segment_agg('meca')}),
  tradi AS ({segment_agg('tradi')}),
  loads AS ({load_first_last_sql()}),
  locks AS ({lock_first_last_sql()}),
  typed AS (SELECT DISTINCT l.shipment_id FROM w_do_orders o JOIN w_lpn l ON l.order_id = o.order_id
            WHERE o.do_type = '10' AND l.shipment_id IS NOT NULL),
  doors AS (SELECT r.shipment_id, {door('dd.dock_door_name')} AS dock_door
            FROM w_dock_door_ref r JOIN w_dock_door dd ON r.dock_door_id = dd.dock_door_id)
SELECT s.tc_shipment_id, {code_left('s.tc_shipment_id')} AS tc_shipment_id_left,
  {code_right('s.tc_shipment_id')} AS tc_shipment_id_right,
  coalesce(s.dsg_carrier_code, s.assigned_carrier_code) AS carrier_code, s.broker_ref AS store_code,
  n1.debord, {fmt('s.pickup_start_dttm', DMY_HM)} AS pickup_start, {fmt('s.pickup_start_dttm', DM)} AS pickup_start_date,
  {fmt('s.pickup_start_dttm', HM)} AS pickup_start_hour, {location('h.aisle', 'h.lvl')} AS location,
  n2.users, doors.dock_door,
  {fmt('ld.start_of_loading', DM_HM)} AS start_of_loading, {fmt('ld.start_of_loading', DM)} AS start_of_loading_date,
  {fmt('ld.start_of_loading', HM)} AS start_of_loading_hour, n3.coch,
  {seg_cols},
  nc.not_closed,
  {proper('lk.min_first_name')} AS opti_nom_debut, {fmt('lk.min_created_dttm', DM_HM)} AS opti_date_debut,
  {proper('lk.max_first_name')} AS opti_nom_fin, {fmt('lk.max_created_dttm', DM_HM)} AS opti_date_fin,
  ld.last_loader AS ref_field1, 0 AS ref_field2, 0 AS ref_field3
FROM w_shipment s
JOIN typed ON typed.shipment_id = s.shipment_id
LEFT JOIN w_locn_hdr h ON s.staging_locn_id = h.locn_id
LEFT JOIN doors ON doors.shipment_id = s.shipment_id
LEFT JOIN loads ld ON ld.tc_shipment_id = s.tc_shipment_id
JOIN global ON global.shipment_id = s.shipment_id
LEFT JOIN meca ON meca.shipment_id = s.shipment_id
LEFT JOIN tradi ON tradi.shipment_id = s.shipment_id
LEFT JOIN {tagged('#', 'debord')} n1 ON n1.shipment_id = s.shipment_id
LEFT JOIN {tagged('$', 'users')} n2 ON n2.shipment_id = s.shipment_id
LEFT JOIN {tagged('@', 'coch')} n3 ON n3.shipment_id = s.shipment_id
CROSS JOIN ({not_closed_sql(as_of)}) nc
LEFT JOIN locks lk ON lk.shipment_id = s.shipment_id
WHERE {active_where('s', as_of)}"""


# ------------------------------------------------------------------ dock ---
def dock_doors_sql() -> str:
    return f"""WITH pieces AS ({DOCK_PIECES}),
  meca AS (SELECT shipment_id, d_facility_alias_id, CAST(sum(prep) AS BIGINT) AS nb_prep,
             CAST(sum(ancr) AS BIGINT) AS nb_ancr, CAST(sum(chgt) AS BIGINT) AS nb_chgt
           FROM pieces WHERE {SEGMENT_WHERE['meca']} GROUP BY shipment_id, d_facility_alias_id),
  tradi AS (SELECT shipment_id, d_facility_alias_id, CAST(sum(prep) AS BIGINT) AS nb_prep,
             CAST(sum(ancr) AS BIGINT) AS nb_ancr, CAST(sum(chgt) AS BIGINT) AS nb_chgt
           FROM pieces WHERE {SEGMENT_WHERE['tradi']} GROUP BY shipment_id, d_facility_alias_id),
  all_pieces AS (SELECT shipment_id, CASE WHEN lpn_facility_status = 50 THEN 1 ELSE 0 END AS chgt,
                   CASE WHEN lpn_facility_status <= 99 THEN 1 ELSE 0 END AS total
                 FROM w_lpn WHERE shipment_id IS NOT NULL),
  weights AS (SELECT tc_shipment_id, sum(estimated_weight) AS weight FROM w_lpn
              WHERE lpn_facility_status = 50 AND tc_shipment_id IS NOT NULL GROUP BY tc_shipment_id)
SELECT dd.dock_door_name AS porte_de_quai, s.tc_shipment_id AS chargement,
  {code_left('s.tc_shipment_id')} AS chgt_left, {code_right('s.tc_shipment_id')} AS chgt_right,
  {fmt('s.pickup_start_dttm', DMY_HM)} AS pickup, {fmt('s.pickup_start_dttm', DM)} AS pickup_date,
  {fmt('s.pickup_start_dttm', HM)} AS pickup_hour,
  st.stop_seq AS arret, st.facility_alias_id AS ctmq, fa.city AS ville, s.size1_value AS metrage,
  s.assigned_carrier_code AS transporteur,
  m.nb_prep AS nb_prep_meca, m.nb_ancr AS nb_ancr_meca, m.nb_chgt AS nb_chgt_meca,
  t.nb_prep AS nb_prep_tradi, t.nb_ancr AS nb_ancr_tradi, t.nb_chgt AS nb_chgt_tradi,
  CAST(trunc(100.0 * sum(g.chgt) / nullif(sum(g.total), 0)) AS BIGINT) AS percentage,
  w.weight AS poids_charge, o.body AS note_ordre, a.body AS note_rajout
FROM w_shipment s
JOIN w_dock_door_ref r ON r.shipment_id = s.shipment_id
JOIN w_dock_door dd ON dd.dock_door_id = r.dock_door_id
JOIN w_stop st ON st.shipment_id = s.shipment_id
JOIN w_facility_alias fa ON fa.facility_alias_id = st.facility_alias_id
LEFT JOIN meca m ON m.shipment_id = s.shipment_id AND m.d_facility_alias_id = st.facility_alias_id
LEFT JOIN tradi t ON t.shipment_id = s.shipment_id AND t.d_facility_alias_id = st.facility_alias_id
LEFT JOIN all_pieces g ON g.shipment_id = s.shipment_id
LEFT JOIN weights w ON w.tc_shipment_id = s.tc_shipment_id
LEFT JOIN {tagged('@', 'body')} o ON o.shipment_id = s.shipment_id
LEFT JOIN {tagged('+', 'body')} a ON a.shipment_id = s.shipment_id
WHERE s.shipment_status < 80 AND st.stop_seq > 1
GROUP BY ALL
ORDER BY porte_de_quai ASC NULLS LAST, arret DESC NULLS FIRST"""


def shipment_stops_rows() -> str:
    return """FROM w_shipment s
JOIN w_dock_door_ref r ON r.shipment_id = s.shipment_id
JOIN w_dock_door dd ON dd.dock_door_id = r.dock_door_id
JOIN w_stop st ON st.shipment_id = s.shipment_id
JOIN w_facility_alias fa ON fa.facility_alias_id = st.facility_alias_id
WHERE s.shipment_status < 80 AND st.stop_seq > 1"""


def load_percentage_sql() -> str:
    return f"""SELECT s.shipment_id, dd.dock_door_name, st.stop_seq,
  CAST(trunc(100.0 * sum(CASE WHEN l.lpn_facility_status = 50 THEN 1 ELSE 0 END)
       / nullif(sum(CASE WHEN l.lpn_facility_status <= 99 THEN 1 ELSE 0 END), 0)) AS BIGINT) AS percentage
{shipment_stops_rows().replace('WHERE', 'LEFT JOIN w_lpn l ON l.shipment_id = s.shipment_id' + chr(10) + 'WHERE')}
GROUP BY s.shipment_id, dd.dock_door_name, st.stop_seq"""


def stop_stage_counts_sql() -> str:
    def seg(name: str) -> str:
        return (f"SELECT shipment_id, d_facility_alias_id, CAST(sum(prep) AS BIGINT) AS nb_prep, "
                f"CAST(sum(ancr) AS BIGINT) AS nb_ancr, CAST(sum(chgt) AS BIGINT) AS nb_chgt "
                f"FROM pieces WHERE {SEGMENT_WHERE[name]} GROUP BY shipment_id, d_facility_alias_id")
    cols = ", ".join(f"{a}.nb_{c} AS nb_{c}_{s}" for a, s in (("m", "meca"), ("t", "tradi"))
                     for c in ("prep", "ancr", "chgt"))
    return f"""WITH pieces AS ({DOCK_PIECES}),
  meca AS ({seg('meca')}),
  tradi AS ({seg('tradi')})
SELECT coalesce(m.shipment_id, t.shipment_id) AS shipment_id,
  coalesce(m.d_facility_alias_id, t.d_facility_alias_id) AS d_facility_alias_id, {cols}
FROM meca m FULL JOIN tradi t
  ON m.shipment_id = t.shipment_id AND m.d_facility_alias_id IS NOT DISTINCT FROM t.d_facility_alias_id"""


# ---------------------------------------------------------- appointments ---
def po_rows_sql() -> str:
    prio = ("CASE left(n.note, 2) WHEN 'PU' THEN 1 WHEN 'CU' THEN 2 WHEN 'WU' THEN 3 WHEN 'P0' THEN 4 "
            "WHEN 'C0' THEN 5 WHEN 'W0' THEN 6 WHEN 'UR' THEN 7 ELSE 8 END")
    return f"""po_rows AS (
    SELECT o.appointment_id, o.appt_obj_type,
      CASE WHEN p.purchase_orders_status <> 950 THEN p.tc_purchase_orders_id END AS purchase_orders_running,
      CASE WHEN p.purchase_orders_status = 950 THEN p.tc_purchase_orders_id END AS purchase_orders_closed,
      p.business_partner_id, {prio} AS purchase_orders_priority
    FROM w_ilm_appointment_objects o
    LEFT JOIN w_purchase_orders p ON o.appt_obj_id = p.purchase_orders_id
    LEFT JOIN w_purchase_orders_line_item li ON p.purchase_orders_id = li.purchase_orders_id
    LEFT JOIN w_business_partner bp ON p.business_partner_id = bp.business_partner_id
    LEFT JOIN w_purchase_orders_status ps ON p.purchase_orders_status = ps.purchase_orders_status
    LEFT JOIN w_purchase_orders_note n ON p.purchase_orders_id = n.purchase_orders_id),
  po_split AS (
    SELECT appointment_id, appt_obj_type, purchase_orders_running, purchase_orders_closed,
      business_partner_id, purchase_orders_priority, count(*) AS nb_lines
    FROM po_rows GROUP BY ALL),
  rollup AS (
    SELECT appointment_id, appt_obj_type,
      string_agg(purchase_orders_running, ' ' ORDER BY purchase_orders_running) AS purchase_orders_running,
      string_agg(purchase_orders_closed, ' ' ORDER BY purchase_orders_closed) AS purchase_orders_closed,
      max(business_partner_id) AS business_partner_id, min(purchase_orders_priority) AS purchase_orders_priority,
      CAST(sum(nb_lines) AS BIGINT) AS nb_lines
    FROM po_split GROUP BY appointment_id, appt_obj_type)"""


def trailer_sql() -> str:
    """Trailer timeline stated per visit row: the first task created at or
    after check-in and the last update among those tasks, as correlated
    scalar subqueries over the task log (no join-then-group)."""
    first = ("(SELECT min(t.created_dttm) FROM w_ilm_tasks t "
             "WHERE t.trailer_id = vr.trailer_id AND t.created_dttm >= vr.checkin_dttm)")
    last = ("(SELECT max(t.last_updated_dttm) FROM w_ilm_tasks t "
            "WHERE t.trailer_id = vr.trailer_id AND t.created_dttm >= vr.checkin_dttm)")
    return f"""visit_rows AS (
    SELECT DISTINCT d.appointment_id, d.type, d.seal_number, v.checkin_dttm, v.checkout_dttm, h.dsp_locn,
      v.trailer_id
    FROM w_trailer_visit_detail d
    LEFT JOIN w_trailer_visit v ON d.visit_id = v.visit_id
    LEFT JOIN w_trailer_ref r ON v.visit_id = r.active_visit_id
    LEFT JOIN w_locn_hdr h ON r.current_location_id = h.locn_id),
  trailerhd AS (
    SELECT vr.*, {first} AS min_task,
      nullif({last}, {first}) AS max_task
    FROM visit_rows vr)"""


ATTRS = (("tc_container_id", "NUM_CNT"), ("nb_pal", "NB_PALETTE"), ("nb_package", "NBR_COLIS"),
         ("date_arrival", "ARRIVAL_DTTM"), ("send_to_dock", "SEND_TO_DOCK"), ("cust_comments", "CUST_COMMENTS"))


def attr_joins(names=ATTRS, on: str = "a.appointment_id") -> str:
    return "\n".join(
        f"LEFT JOIN (SELECT appointment_id, attribute_value AS {alias} FROM w_ilm_appt_custom_attribute "
        f"WHERE attribute_name = '{name}') at_{alias} ON at_{alias}.appointment_id = {on}"
        for alias, name in names)


POLE_CASE = """CASE sl.description
    WHEN 'BATIMENT A' THEN 'POLE_AB' WHEN 'BATIMENT A (EXTERIEUR)' THEN 'POLE_AB'
    WHEN 'BATIMENT A (INTERIEUR)' THEN 'POLE_AB' WHEN 'BATIMENT A (CONTAINER)' THEN 'POLE_AB'
    WHEN 'BATIMENT B' THEN 'POLE_AB' WHEN 'BATIMENT B (CAMION)' THEN 'POLE_AB'
    WHEN 'BATIMENT B (CONTAINER)' THEN 'POLE_AB' WHEN 'BATIMENT C' THEN 'POLE_C'
    WHEN 'BATIMENT C (CAMION)' THEN 'POLE_C' WHEN 'BATIMENT C (CONTAINER)' THEN 'POLE_C'
    WHEN 'BATIMENT C1' THEN 'POLE_C' WHEN 'RDV DECOCLICO' THEN 'POLE_C'
    WHEN 'RDV LOL' THEN 'POLE_AB' WHEN 'RDV RETOURS CONTENANT/MAGS' THEN 'POLE_AB'
    ELSE 'TO_DEFINE' END"""


def eligible_case(running: str, closed: str, desc: str, pal: str, pack: str, lines: str) -> str:
    first = f"left(nullif(concat({running}, {closed}), ''), 1)"
    return f"""CASE
    WHEN {first} IN ('G', 'C') OR {desc} IN ('RDV LOL', 'RDV DECOCLICO', 'RDV RETOURS CONTENANT/MAGS') THEN 0
    WHEN ({first} = '3'
          OR (coalesce(CAST({pal} AS INTEGER), 0) + coalesce(CAST({pack} AS INTEGER), 0)
              + coalesce(CAST({lines} AS INTEGER), 0)) > 0)
         AND {desc} IN ('BATIMENT A', 'BATIMENT A (EXTERIEUR)', 'BATIMENT A (INTERIEUR)', 'BATIMENT B',
                        'BATIMENT B (CAMION)', 'BATIMENT C', 'BATIMENT C (CAMION)', 'BATIMENT C (CONTAINER)',
                        'BATIMENT C1')
    THEN 1 ELSE 0 END"""


def window_where(col: str, as_of: dt.datetime) -> str:
    today = f"CAST({ts(as_of)} AS DATE)"
    return (f"CAST({col} AS DATE) BETWEEN {today} AND "
            f"(CASE WHEN isodow({today}) = 5 THEN {today} + 3 ELSE {today} + 1 END)")


def checkin_gap(as_of: dt.datetime, col: str) -> str:
    gap = f"({ts(as_of)} - {col})"
    return f"CAST(extract(hour FROM {gap}) * 60 + extract(minute FROM {gap}) AS BIGINT)"


def start_gap(as_of: dt.datetime, col: str) -> str:
    return f"CAST(round(date_diff('second', date_trunc('second', {col}), {ts(as_of)}) / 60.0) AS BIGINT)"


def appointments_sql(as_of: dt.datetime) -> str:
    return f"""WITH {po_rows_sql()},
  {trailer_sql()}
SELECT {fmt('a.scheduled_dttm', DM)} AS scheduled_date, {fmt('a.scheduled_dttm', HM)} AS scheduled_time,
  a.tc_appointment_id, a.comments AS appointment_comments, st.description AS appointment_status,
  at_tc_container_id.tc_container_id,
  CAST(coalesce(CAST(at_nb_pal.nb_pal AS DECIMAL(10,3)), 0) AS DECIMAL(10,3)) AS nb_palette,
  CAST(coalesce(CAST(at_nb_package.nb_package AS DECIMAL(10,3)), 0) AS DECIMAL(10,3)) AS nb_package,
  at_date_arrival.date_arrival, at_send_to_dock.send_to_dock, sl.description AS dock_group,
  {POLE_CASE} AS dock_pole,
  bp.description AS business_partner, po.purchase_orders_running, po.purchase_orders_closed,
  po.purchase_orders_priority, po.nb_lines AS purchase_order_nb_lines,
  th.checkin_dttm, {checkin_gap(as_of, 'th.checkin_dttm')} AS checkin_dttm_gap, th.checkout_dttm,
  th.type AS trailer_type, th.trailer_id AS seal_number, th.min_task AS start_dttm,
  {start_gap(as_of, 'th.min_task')} AS start_dttm_gap, th.max_task AS end_dttm, th.dsp_locn,
  at_cust_comments.cust_comments AS ref_field1, 0 AS ref_field2, 0 AS ref_field3
FROM w_ilm_appointments a
LEFT JOIN w_ilm_appointment_status st ON a.appt_status = st.appt_status_code
LEFT JOIN rollup po ON po.appointment_id = a.appointment_id
LEFT JOIN w_business_partner bp ON po.business_partner_id = bp.business_partner_id
{attr_joins()}
LEFT JOIN w_ilm_appt_slots isl ON isl.appointment_id = a.appointment_id
LEFT JOIN w_slots sl ON isl.slot_id = sl.slot_id
LEFT JOIN trailerhd th ON th.appointment_id = a.appointment_id
WHERE (po.appt_obj_type = 40 OR po.appt_obj_type IS NULL)
  AND {eligible_case('po.purchase_orders_running', 'po.purchase_orders_closed', 'sl.description',
                     'at_nb_pal.nb_pal', 'at_nb_package.nb_package', 'po.nb_lines')} = 1
  AND {window_where('a.scheduled_dttm', as_of)}"""


# -------------------------------------------------------------- registry ---
def _queries() -> dict[str, str]:
    act = ACTIVITY_AS_OF
    q: dict[str, str] = {}
    q["shipment_activity"] = shipment_activity_sql(act)
    q["dock_doors"] = dock_doors_sql()
    q["appointments"] = appointments_sql(APPOINTMENT_AS_OF)
    q["appointments_friday"] = appointments_sql(APPOINTMENT_AS_OF_FRIDAY)

    def each_clock(sql, clocks) -> str:
        """The statement of every clock, one after the other."""
        return "\nUNION ALL\n".join(f"SELECT {ts(c)} AS as_of, * FROM (\n{sql(c)}\n)" for c in clocks)

    q["appointments_week"] = each_clock(appointments_sql, [dt.datetime(2024, 1, d, 12) for d in range(8, 15)])
    activity_week = [dt.datetime(2001, 7, d, 12) for d in range(16, 23)]
    q["active_shipments_week"] = each_clock(
        lambda c: f"SELECT s.shipment_id, s.tc_shipment_id, s.shipment_status, s.pickup_start_dttm "
                  f"FROM w_shipment s WHERE {active_where('s', c)}", activity_week)
    q["not_closed_week"] = each_clock(not_closed_sql, activity_week)

    q["carrier_fallback"] = ("SELECT shipment_id, coalesce(dsg_carrier_code, assigned_carrier_code) AS carrier_code "
                             "FROM w_shipment")
    q["id_split"] = (f"SELECT tc_shipment_id, {code_left('tc_shipment_id')} AS tc_shipment_id_left, "
                     f"{code_right('tc_shipment_id')} AS tc_shipment_id_right FROM w_shipment")
    q["time_labels"] = (f"SELECT shipment_id, {fmt('pickup_start_dttm', DMY_HM)} AS pickup_start, "
                        f"{fmt('pickup_start_dttm', DM)} AS pickup_start_date, "
                        f"{fmt('pickup_start_dttm', HM)} AS pickup_start_hour FROM w_shipment")
    q["active_shipments"] = (f"SELECT s.shipment_id, s.tc_shipment_id, s.shipment_status, s.pickup_start_dttm "
                             f"FROM w_shipment s WHERE {active_where('s', act)}")
    typed = ("SELECT s.shipment_id, s.tc_shipment_id FROM w_shipment s WHERE s.shipment_id IN ("
             "SELECT l.shipment_id FROM w_do_orders o JOIN w_lpn l ON l.order_id = o.order_id "
             "WHERE o.do_type = '10' AND l.shipment_id IS NOT NULL)")
    q["shipments_with_do_type"] = typed
    q["shipments_with_do_type_distinct"] = typed
    q["staging_location"] = (f"SELECT s.shipment_id, {location('h.aisle', 'h.lvl')} AS location "
                             f"FROM w_shipment s LEFT JOIN w_locn_hdr h ON s.staging_locn_id = h.locn_id")
    q["door_assignments"] = (f"SELECT r.shipment_id, dd.dock_door_name, {door('dd.dock_door_name')} AS dock_door "
                             f"FROM w_dock_door_ref r JOIN w_dock_door dd ON r.dock_door_id = dd.dock_door_id")
    q["note_tags"] = (f"SELECT s.shipment_id, n1.debord, n2.users, n3.coch, n4.addition FROM w_shipment s "
                      f"LEFT JOIN {tagged('#', 'debord')} n1 ON n1.shipment_id = s.shipment_id "
                      f"LEFT JOIN {tagged('$', 'users')} n2 ON n2.shipment_id = s.shipment_id "
                      f"LEFT JOIN {tagged('@', 'coch')} n3 ON n3.shipment_id = s.shipment_id "
                      f"LEFT JOIN {tagged('+', 'addition')} n4 ON n4.shipment_id = s.shipment_id")
    q["not_closed_list"] = not_closed_sql(act)

    for seg, key in (("global", "piece_stage_counts"), ("meca", "piece_stage_counts_meca"),
                     ("tradi", "piece_stage_counts_tradi")):
        q[key] = f"WITH pieces AS ({ACT_PIECES})\n{counts_agg(seg)}"
    q["piece_stage_segments"] = segments_sql()
    q["piece_stage_segments_three_scans"] = q["piece_stage_segments"]
    q["piece_stage_share"] = (f"WITH pieces AS ({ACT_PIECES})\n"
                              f"SELECT shipment_id, {share_cols().replace(' AS advancement', ' AS loading_advancement')}"
                              f"\nFROM pieces GROUP BY shipment_id")

    q["load_first_last"] = load_first_last_sql()
    q["load_first_last_selfjoin"] = q["load_first_last"]
    q["load_first_last_window"] = q["load_first_last"]
    q["lock_first_last"] = lock_first_last_sql()
    q["lock_first_last_selfjoin"] = q["lock_first_last"]
    q["lock_first_last_window"] = q["lock_first_last"]

    q["shipment_stops"] = ("SELECT s.shipment_id, dd.dock_door_name, st.stop_seq, st.facility_alias_id, fa.city\n"
                           + shipment_stops_rows())
    q["stop_stage_counts"] = stop_stage_counts_sql()
    q["load_percentage"] = load_percentage_sql()
    q["load_percentage_fanout"] = q["load_percentage"]
    q["loaded_weight"] = ("SELECT tc_shipment_id, sum(estimated_weight) AS weight FROM w_lpn "
                          "WHERE lpn_facility_status = 50 AND tc_shipment_id IS NOT NULL GROUP BY tc_shipment_id")

    for key, as_of in (("appointment_window", APPOINTMENT_AS_OF), ("appointment_window_friday", APPOINTMENT_AS_OF_FRIDAY)):
        q[key] = (f"SELECT appointment_id, scheduled_dttm FROM w_ilm_appointments "
                  f"WHERE {window_where('scheduled_dttm', as_of)}")
    q["po_priority"] = ("SELECT p.purchase_orders_id, n.note, CASE left(n.note, 2) WHEN 'PU' THEN 1 WHEN 'CU' THEN 2 "
                        "WHEN 'WU' THEN 3 WHEN 'P0' THEN 4 WHEN 'C0' THEN 5 WHEN 'W0' THEN 6 WHEN 'UR' THEN 7 "
                        "ELSE 8 END AS purchase_orders_priority FROM w_purchase_orders p "
                        "LEFT JOIN w_purchase_orders_note n ON p.purchase_orders_id = n.purchase_orders_id")
    q["po_split"] = f"WITH {po_rows_sql()}\nSELECT * FROM po_split"
    q["po_lists"] = (f"WITH {po_rows_sql()}\nSELECT appointment_id, appt_obj_type, purchase_orders_running, "
                     f"purchase_orders_closed FROM rollup")
    q["appointment_po_rollup"] = f"WITH {po_rows_sql()}\nSELECT * FROM rollup"
    # the tall table once, one cut of it per attribute
    cuts = ",\n  ".join(f"cut_{alias} AS MATERIALIZED (SELECT appointment_id, attribute_value AS {alias} FROM tall "
                        f"WHERE attribute_name = '{name}')" for alias, name in ATTRS)
    joins = "\n".join(f"LEFT JOIN cut_{alias} ON cut_{alias}.appointment_id = a.appointment_id" for alias, _ in ATTRS)
    q["eav_attributes"] = (f"WITH tall AS MATERIALIZED (SELECT * FROM w_ilm_appt_custom_attribute),\n  {cuts}\n"
                           f"SELECT a.appointment_id, {', '.join(a for a, _ in ATTRS)} "
                           f"FROM w_ilm_appointments a\n{joins}")
    q["eav_attributes_pivot"] = q["eav_attributes"]
    q["eav_quantities"] = ("SELECT a.appointment_id, "
                           "CAST(coalesce(CAST(nb_pal AS DECIMAL(10,3)), 0) AS DECIMAL(10,3)) AS nb_palette, "
                           "CAST(coalesce(CAST(nb_package AS DECIMAL(10,3)), 0) AS DECIMAL(10,3)) AS nb_package "
                           f"FROM w_ilm_appointments a\n{attr_joins(ATTRS[1:3])}")
    chosen = ("FROM w_ilm_appt_custom_attribute WHERE attribute_name IN ('NB_PALETTE', 'NBR_COLIS', 'ARRIVAL_DTTM') "
              "AND {} (attribute_value IS NULL OR try_cast(attribute_value AS DECIMAL(10,3)) IS NOT NULL)")
    q["rejected_quantities"] = ("SELECT appointment_id, attribute_name, attribute_value, 'attribute_value: ' || "
                                "CASE WHEN try_cast(attribute_value AS DECIMAL(38,10)) IS NULL THEN 'not a number' "
                                f"ELSE 'out of range of decimal(10,3)' END AS reject_reason {chosen.format('NOT')}")
    q["accepted_quantities"] = ("SELECT appointment_id, attribute_name, CAST(attribute_value AS DECIMAL(10,3)) AS quantity "
                                f"{chosen.format('')}")
    q["dock_pole"] = (f"SELECT isl.appointment_id, isl.slot_id, sl.description AS dock_group, {POLE_CASE} AS dock_pole "
                      f"FROM w_ilm_appt_slots isl LEFT JOIN w_slots sl ON isl.slot_id = sl.slot_id")
    q["appointment_eligibility"] = f"""WITH {po_rows_sql()}
SELECT a.appointment_id, po.appt_obj_type, sl.description AS dock_group, po.purchase_orders_running,
  po.purchase_orders_closed, at_nb_pal.nb_pal, at_nb_package.nb_package, po.nb_lines,
  {eligible_case('po.purchase_orders_running', 'po.purchase_orders_closed', 'sl.description',
                 'at_nb_pal.nb_pal', 'at_nb_package.nb_package', 'po.nb_lines')} AS eligible
FROM w_ilm_appointments a
LEFT JOIN rollup po ON po.appointment_id = a.appointment_id
{attr_joins(ATTRS[1:3])}
LEFT JOIN w_ilm_appt_slots isl ON isl.appointment_id = a.appointment_id
LEFT JOIN w_slots sl ON isl.slot_id = sl.slot_id"""
    q["trailer_tasks"] = f"WITH {trailer_sql()}\nSELECT * FROM trailerhd"
    q["elapsed_minutes"] = (f"WITH {trailer_sql()}\nSELECT appointment_id, trailer_id, checkin_dttm, min_task, "
                            f"{checkin_gap(APPOINTMENT_AS_OF, 'checkin_dttm')} AS checkin_dttm_gap, "
                            f"{start_gap(APPOINTMENT_AS_OF, 'min_task')} AS start_dttm_gap FROM trailerhd")
    return q


def oracle_queries() -> dict[str, str]:
    return {k: with_fixtures(v) for k, v in _queries().items()}
