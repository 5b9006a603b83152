"""Ship Python functions used inside tasks by value."""

from __future__ import annotations

import sys


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of ``module_name`` by value for executors."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import
        pass
