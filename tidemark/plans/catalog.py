"""All registered queries."""

from . import q_events, q_intake, q_market, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
