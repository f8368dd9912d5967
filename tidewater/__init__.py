"""A PySpark-native analytics engine for columnar and time-series work."""

from .frame import Frame, as_timeframe, in_timezone, rbind
from .session import get_spark

__all__ = ["Frame", "as_timeframe", "get_spark", "in_timezone", "rbind"]
