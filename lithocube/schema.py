"""Schemas and point states of the porosity cube."""

from __future__ import annotations

from enum import IntEnum

CUBE = "x int, y int, z int, phi double, real int, ring int, well_id int"
TRACES = "feature string, x int, y int, amp array<double>"
WELLS = "well_id int, x int, y int, role string"
LOG = "depth double, neutron_por double, density_por double, sonic_por double, time double, global_x double, global_y double, area_x double, area_y double"


class State(IntEnum):
    """What is known of a point."""

    REAL = 0
    PROPAGATED = 1
    CANAL = 2
    CANAL_EXPANDED = 3
    EXPANDED = 4
    EMPTY = 5
    NONE = 6
