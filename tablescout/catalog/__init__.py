"""The registered queries."""

from . import analysis, exploring, preparing, profiling
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "exploring", "preparing", "profiling"]
