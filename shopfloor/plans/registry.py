"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import registered
from . import q_analytics, q_carts, q_catalog, q_changes, q_extensions, q_quality, q_sources, q_streams  # noqa: F401


def queries():
    return dict(registered.QUERIES)


def oracle_sql():
    return dict(registered.ORACLE)
