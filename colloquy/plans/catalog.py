"""All registered queries of the library's own operators."""

from . import benchmarks, connectors, corpora, evaluation, lookups, traces  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
