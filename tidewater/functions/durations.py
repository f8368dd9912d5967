"""Durations such as 90s, 1h30m, 6h, 1d, 2w; mo is 30 days and y is 365 days."""

from __future__ import annotations

import re

#: Nanoseconds of each unit (fixed values).
NANOS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "mo": 30 * 86400 * 10**9, "y": 365 * 86400 * 10**9}


def nanos(d: str) -> int:
    parts = re.findall(r"(\d+)\s*(ns|us|ms|mo|s|m|h|d|w|y)", d)
    if not parts or re.sub(r"(\d+)\s*(ns|us|ms|mo|s|m|h|d|w|y)", "", d).strip():
        raise ValueError(f"not a duration: {d!r}")
    return sum(int(n) * NANOS[u] for n, u in parts)


def ticks(d: str, kind: str) -> int:
    """A duration in microseconds for timestamps, days for dates, nanoseconds for whole numbers."""
    unit = {"timestamp": 1000, "date": NANOS["d"], "long": 1}[kind]
    n, rest = divmod(nanos(d), unit)
    if rest or n < 1:
        raise ValueError(f"{d!r} is no whole number of the time index's ticks")
    return n
