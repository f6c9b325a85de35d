"""The bar periods and the values attached to them."""

from __future__ import annotations

from math import gcd


MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
WEEK_MS = 604_800_000

# Periods kept by the service, shortest first.
PERIOD_MS = {
    "1m": 60_000,
    "5m": 300_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "1d": 86_400_000,
    "1w": 604_800_000,
}
PERIODS = tuple(PERIOD_MS)

# Intervals known to the continuity check.
CONTINUITY_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
    "3d": 259_200_000,
    "1w": 604_800_000,
    "1M": 2_592_000_000,
}

# Accepted lag in minutes of a local series behind its source.
FRESHNESS_MINUTES = {"1m": 2, "5m": 10, "30m": 60}
FRESHNESS_DEFAULT_MINUTES = 5

# How far back a first download reaches.
HISTORY_GENESIS_MS = 1_567_900_800_000  # 2019-09-08, used by 1d and 1w
HISTORY_DEPTH_MS = {
    "1m": 1_000 * MINUTE_MS,
    "5m": 5_000 * MINUTE_MS,
    "30m": 30_000 * MINUTE_MS,
    "1h": 1_000 * HOUR_MS,
    "4h": 4_000 * HOUR_MS,
    "1d": 1_000 * DAY_MS,
    "1w": 200 * WEEK_MS,
}
HISTORY_DEFAULT_DEPTH_MS = 1_000 * MINUTE_MS

# A week starts on Monday; the epoch was a Thursday.
MONDAY_SHIFT_MS = 3 * DAY_MS


def period_ms(period: str) -> int:
    """Length of a supported period; anything else is refused."""
    if period not in PERIOD_MS:
        raise ValueError(f"unsupported period {period!r}, expected one of {PERIODS}")
    return PERIOD_MS[period]


def base_ms(periods: tuple[str, ...]) -> int:
    """Largest time step of which every given period start is a multiple."""
    step = gcd(*(period_ms(p) for p in periods))
    return gcd(step, DAY_MS)
