"""The engine's own queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import joins_shape, rows, scalars_misc, sources_models, timeseries, tpch, tpch_more
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "joins_shape", "rows", "scalars_misc", "sources_models", "timeseries", "tpch", "tpch_more"]
