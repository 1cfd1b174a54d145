"""Python workers without the package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    """Send a module's functions to the workers as code, not by import name."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
