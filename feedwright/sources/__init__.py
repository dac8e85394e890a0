"""Inputs and outputs."""

from .entities import CODE_COLUMNS, ENTITIES, FOLDED_COLUMNS, SKU_COLUMNS, ddl
from .readers import Sources
from .sinks import write_report
from .splits import even_splits

__all__ = ["CODE_COLUMNS", "ENTITIES", "FOLDED_COLUMNS", "SKU_COLUMNS", "Sources", "ddl", "even_splits", "write_report"]
