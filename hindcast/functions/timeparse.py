"""Time arguments: RFC3339 instants and durations before ``now``."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

# The duration units, in microseconds. There is no day unit.
UNIT_MICROS = {
    "ns": Decimal("0.001"),
    "us": Decimal(1),
    "µs": Decimal(1),
    "μs": Decimal(1),
    "ms": Decimal(1_000),
    "s": Decimal(1_000_000),
    "m": Decimal(60_000_000),
    "h": Decimal(3_600_000_000),
}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """``720h``, ``1h30m``, ``1.5s``. An unknown unit such as ``d`` is refused."""
    parts = _PART.findall(text)
    if not parts or "".join(number + unit for number, unit in parts) != text:
        raise ValueError(f"not a duration: {text!r} (units: ns, us, ms, s, m, h)")
    return timedelta(microseconds=int(sum(Decimal(n) * UNIT_MICROS[u] for n, u in parts)))


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def parse_instant(value: str | datetime | timedelta | None, now: datetime | None = None) -> datetime | None:
    """A naive UTC instant from an RFC3339 string, a duration before ``now``, or a datetime."""
    if value is None:
        return None
    now = parse_instant(now) if now is not None else utc_now()
    if isinstance(value, timedelta):
        return now - value
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            return now - parse_duration(value)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def instant(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own type, so the comparison reaches the Parquet scan."""
    text = value.isoformat(sep=" ")
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def day_literal(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch; the session time zone is UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column, like: str) -> Column:
    """Inverse of :func:`micros`, as type ``like``."""
    return F.timestamp_micros(column).cast(like)
