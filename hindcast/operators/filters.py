"""Row filters and projections of event search. Every filter is per row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from hindcast.functions.text import first_hit
from hindcast.functions.timeparse import day_literal, instant, parse_instant

DEFAULT_TEXT_CHARS = 600


def by_kind(kind: str) -> Column:
    return F.col("kind") == kind


def by_app(app: str) -> Column:
    """Case-insensitive equality."""
    return F.lower("app") == app.lower()


def by_window(part: str) -> Column:
    """Case-insensitive substring; no wildcard has a special meaning."""
    return F.contains(F.lower("window"), F.lit(part.lower()))


def has_text() -> Column:
    return F.length(F.trim("text")) > 0


def in_time_range(df: DataFrame, since=None, until=None, now: datetime | None = None,
                  column: str = "ts") -> DataFrame:
    """``since <= column < until``, with the ``day`` bounds partition pruning needs."""
    since, until = parse_instant(since, now), parse_instant(until, now)
    paged_by_day = "day" in df.columns
    if since is not None:
        df = df.filter(F.col(column) >= instant(df, column, since))
        if paged_by_day:
            df = df.filter(F.col("day") >= day_literal(since.date()))
    if until is not None:
        df = df.filter(F.col(column) < instant(df, column, until))
        if paged_by_day:
            df = df.filter(F.col("day") <= day_literal(until.date()))
    return df


def filter_events(activity: DataFrame, *, kind: str | None = None, app: str | None = None,
                  window: str | None = None, since=None, until=None,
                  require_text: bool = False, now: datetime | None = None) -> DataFrame:
    df = in_time_range(activity, since, until, now)
    if kind is not None:
        df = df.filter(by_kind(kind))
    if app is not None:
        df = df.filter(by_app(app))
    if window is not None:
        df = df.filter(by_window(window))
    if require_text:
        df = df.filter(has_text())
    return df


def get_event(activity: DataFrame, event_id: int, device: str | None = None) -> DataFrame:
    """One event, text whole. Without ``device``, every device's event of that id."""
    found = activity.filter(F.col("event_id") == event_id)
    return found if device is None else found.filter(F.col("device") == device)


def get_events(activity: DataFrame, ids: DataFrame) -> DataFrame:
    """The events named in ``ids``, by (device, event_id) if it has both, else by
    ``event_id``. The join strategy follows the ids' measured size."""
    key = [c for c in ("device", "event_id") if c in ids.columns]
    return activity.join(ids.select(*key).distinct(), key, "left_semi")


def cap_text(df: DataFrame, max_text_chars: int = DEFAULT_TEXT_CHARS) -> DataFrame:
    """Cut ``text``, say so, and report the true length."""
    length = F.length("text")
    return df.withColumns({
        "text_len": length,
        "truncated": F.coalesce(length > max_text_chars, F.lit(False)),
        "text": F.substring("text", 1, max_text_chars),
    })


def excerpt(df: DataFrame, terms: list[str], cap: int = DEFAULT_TEXT_CHARS) -> DataFrame:
    """Like :func:`cap_text`, the cut centred on the earliest hit of any term."""
    if not terms:
        return cap_text(df, cap)
    length = F.length("text")
    start = F.greatest(F.lit(1), F.least(first_hit("text", terms) - cap // 2, length - cap + 1))
    return df.withColumns({
        "text_len": length,
        "truncated": F.coalesce(length > cap, F.lit(False)),
        "text": F.substring(F.col("text"), start, F.lit(cap)),
    })
