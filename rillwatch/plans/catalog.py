"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import queries_data, queries_features, queries_metrics, queries_rules, queries_streams  # noqa: F401
from .queries_models import flagship
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
