"""The query catalogue: the operators over the driver's tables."""

from . import board, conversation, evidence, ledger, pages, previews, products, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
