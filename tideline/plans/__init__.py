"""The catalogue of queries."""

from . import graph, intelligence, io, ml, records, risk, scenario, streams, supply, text  # noqa: F401
from .registry import QUERIES, SQL
from .risk import risk_scores_current as flagship

__all__ = ["QUERIES", "SQL", "flagship"]
