"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per timeframe token.
TIMEFRAME_MS = {
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "1d": 86_400_000,
}

# Bars per day used for coverage targets (6h has none there).
BARS_PER_DAY = {"1m": 1440, "5m": 288, "15m": 96, "1h": 24, "4h": 6, "1d": 1}

OHLCV = ("open", "high", "low", "close", "volume")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tf_seconds(timeframe: str) -> int:
    return TIMEFRAME_MS[timeframe] // 1000


def finite(c: str | Column) -> Column:
    """NaN and the infinities become NULL, so comparisons behave."""
    v = col(c)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def numeric(c: str | Column) -> Column:
    """Cast to double, unparsable or non-finite values to NULL."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(col(a), col(b))


def clip(c: str | Column, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Decimal rounding without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def canonical(base: str | Column, quote: str | Column, kind: str | Column = "SPOT") -> Column:
    """BASE_QUOTE_KIND, upper case; a plain string for ``kind`` is a literal."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws("_", F.upper(col(base)), F.upper(col(quote)), F.upper(k))


def md5_u32(key: Column, part: int | Column = 0) -> Column:
    """Reproducible draw in [0, 2^32): the ``part``-th (0..3) 32-bit word of md5(key)."""
    start = F.lit(1 + 8 * part) if isinstance(part, int) else part * 8 + 1
    return F.conv(F.substr(F.md5(key), start, F.lit(8)), 16, 10).cast("long")


def floor_to(ts: str | Column, seconds: int) -> Column:
    """Start of the epoch-aligned bin that holds ``ts`` (timestamp without time zone)."""
    us = F.unix_micros(col(ts).cast("timestamp"))
    width = int(seconds) * 1_000_000
    return F.timestamp_micros(us - F.pmod(us, F.lit(width))).cast("timestamp_ntz")


def ceil_to(ts: str | Column, seconds: int) -> Column:
    """Right edge of the bin (t-w, t] that holds ``ts``."""
    us = F.unix_micros(col(ts).cast("timestamp"))
    width = int(seconds) * 1_000_000
    return F.timestamp_micros(us + F.pmod(-us, F.lit(width))).cast("timestamp_ntz")
