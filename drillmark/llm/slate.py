"""The registered queries of this subpackage."""

from drillmark.llm import slate_chat, slate_documents, slate_other  # noqa: F401
from drillmark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
