"""Every query of the analyses, once the modules that register them are imported."""

from . import derived, program, deeper, phased, fielded  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
