"""Registered queries, grouped by area; each sits next to the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

from intelspark.plans.registry import ORACLES, QUERIES

AREAS = ("serving", "scorecard", "scalars", "resolution", "parsing", "retrieval", "landing")


def load() -> None:
    for area in AREAS:
        import_module(f"intelspark.plans.{area}")


__all__ = ["AREAS", "ORACLES", "QUERIES", "load"]
