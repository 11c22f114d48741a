"""Appointment-level expressions: dock pole, eligibility, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaysight.functions.semantics import ora_concat, ora_substr, to_integer

# Slot description -> dock pole; anything else is TO_DEFINE.
DOCK_POLES = (
    ("BATIMENT A", "POLE_AB"),
    ("BATIMENT A (EXTERIEUR)", "POLE_AB"),
    ("BATIMENT A (INTERIEUR)", "POLE_AB"),
    ("BATIMENT A (CONTAINER)", "POLE_AB"),
    ("BATIMENT B", "POLE_AB"),
    ("BATIMENT B (CAMION)", "POLE_AB"),
    ("BATIMENT B (CONTAINER)", "POLE_AB"),
    ("BATIMENT C", "POLE_C"),
    ("BATIMENT C (CAMION)", "POLE_C"),
    ("BATIMENT C (CONTAINER)", "POLE_C"),
    ("BATIMENT C1", "POLE_C"),
    ("RDV DECOCLICO", "POLE_C"),
    ("RDV LOL", "POLE_AB"),
    ("RDV RETOURS CONTENANT/MAGS", "POLE_AB"),
)
POLE_UNKNOWN = "TO_DEFINE"

# Eligibility rules.  PO lists starting with one of these
# letters, or these slots, are never shown; otherwise a PO list starting with
# '3' or any quantity makes the appointment shown when its slot is listed.
EXCLUDED_PO_PREFIXES = ("G", "C")
EXCLUDED_SLOTS = ("RDV LOL", "RDV DECOCLICO", "RDV RETOURS CONTENANT/MAGS")
INCLUDED_PO_PREFIX = "3"
INCLUDED_SLOTS = (
    "BATIMENT A",
    "BATIMENT A (EXTERIEUR)",
    "BATIMENT A (INTERIEUR)",
    "BATIMENT B",
    "BATIMENT B (CAMION)",
    "BATIMENT C",
    "BATIMENT C (CAMION)",
    "BATIMENT C (CONTAINER)",
    "BATIMENT C1",
)


def dock_pole(description: Column) -> Column:
    out = None
    for desc, pole in DOCK_POLES:
        out = F.when(description == desc, F.lit(pole)) if out is None else out.when(description == desc, F.lit(pole))
    return out.otherwise(F.lit(POLE_UNKNOWN))


def po_prefix(running: Column, closed: Column) -> Column:
    """SUBSTR(running || closed, 1, 1) with NULL-tolerant concatenation."""
    return ora_substr(ora_concat(running, closed), 1, 1)


def quantity_sum(nb_pal: Column, nb_package: Column, nb_lines: Column) -> Column:
    """COALESCE(CAST(x AS INTEGER), 0) summed over the three quantities."""
    zero = F.lit(0).cast("decimal(38,0)")
    return (F.coalesce(to_integer(nb_pal), zero) + F.coalesce(to_integer(nb_package), zero)
            + F.coalesce(to_integer(nb_lines), zero))


def eligibility(running: Column, closed: Column, slot_description: Column,
                nb_pal: Column, nb_package: Column, nb_lines: Column) -> Column:
    """The report's CASE: exclusions first (-> 0), then inclusion (-> 1),
    else 0.  Kept as an ordered CASE: flattening it to AND/OR would treat
    unknown (NULL) comparisons differently."""
    prefix = po_prefix(running, closed)
    excluded = prefix.isin(*EXCLUDED_PO_PREFIXES) | slot_description.isin(*EXCLUDED_SLOTS)
    included = ((prefix == INCLUDED_PO_PREFIX) | (quantity_sum(nb_pal, nb_package, nb_lines) > 0)) \
        & slot_description.isin(*INCLUDED_SLOTS)
    return F.when(excluded, F.lit(0)).when(included, F.lit(1)).otherwise(F.lit(0))
