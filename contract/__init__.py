"""Registered queries over the given tables, each with the SQL another engine runs."""

from __future__ import annotations

import importlib

FAMILIES = ["quality", "grids", "places", "nearest", "figures", "variation", "redraw", "states", "jobs"]


def load():
    from contract import base

    for family in FAMILIES:
        importlib.import_module(f"contract.{family}")
    return base.QUERIES, base.ORACLE
