"""The three reports and the registry of named queries."""

from quaysight.plans.appointments import appointments, appointments_by_clock
from quaysight.plans.dock_doors import dock_doors
from quaysight.plans.shipment_activity import shipment_activity

__all__ = ["appointments", "appointments_by_clock", "dock_doors", "shipment_activity"]
