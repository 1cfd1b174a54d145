"""All registered queries."""

from drillmark.plans import (  # noqa: F401
    slate_catalog,
    slate_ingest,
    slate_practice,
    slate_progress,
    slate_retrieval,
    slate_validation,
)
from drillmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
