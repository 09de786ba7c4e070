"""Bounded pages: limits, cursors, offsets, boundary and notice."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from hindcast.functions.timeparse import instant, micros
from hindcast.schema import SCHEMA_VERSION

EVENTS_DEFAULT, EVENTS_MAX = 20, 500
TURNS_DEFAULT, TURNS_MAX = 100, 1000
INFO_COLUMNS = ["returned", "has_more", "next_cursor", "oldest_ts", "resume_from", "notice"]


def clamp(limit: int | None, default: int, maximum: int) -> int:
    return default if limit is None or limit <= 0 else min(limit, maximum)


def query_hash(**arguments) -> str:
    """Names the query a cursor belongs to."""
    text = json.dumps(arguments, sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()[:12]


def encode_cursor(query: str, **position) -> str:
    return base64.b64encode(json.dumps({"q": query, **position}).encode()).decode()


def decode_cursor(cursor: str, query: str) -> dict:
    try:
        position = json.loads(base64.b64decode("".join(cursor.split()), validate=True))
    except ValueError as error:
        raise ValueError("cursor is not readable") from error
    if not isinstance(position, dict) or position.get("q") != query:
        raise ValueError("cursor belongs to another query")
    return position


def cursor_column(position: Column) -> Column:
    """A struct as an opaque cursor, on one line."""
    return F.regexp_replace(F.base64(F.to_json(position).cast("binary")), r"\s", "")


def moment(ts_micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=ts_micros)


def after_cursor(df: DataFrame, ts_micros: int, event_id: int, device: str) -> DataFrame:
    """Rows older than the cursor in (ts, event_id, device) order.

    The plain ``ts <=`` conjunct lets Parquet skip row groups; the rest is exact.
    """
    at = instant(df, "ts", moment(ts_micros))
    ts, own = F.col("ts"), F.col("event_id")
    return df.filter(ts <= at).filter((ts < at) | (own < event_id) | ((own == event_id) & (F.col("device") < device)))


@dataclass
class Page:
    """``keys`` are the page's rows without text, and one more to learn whether
    more results exist. ``rows`` and ``info`` are lazy; :meth:`pin` finds the
    keys once for both."""

    keys: DataFrame
    source: DataFrame
    fetch: Callable[[DataFrame, DataFrame], DataFrame]
    limit: int
    query: str
    ranked: bool = False
    offset: int = 0
    keyset: bool = False  # a ranked cursor is a position too
    stored_version: int | None = None

    @property
    def rows(self) -> DataFrame:
        """The page, text included."""
        return self.fetch(self.source, self.keys.limit(self.limit))

    def pin(self) -> Page:
        """The same page with its keys found: at most ``limit + 1`` rows come to
        the driver, and text is then read by event id."""
        found = self.keys.collect()
        keys = self.keys.sparkSession.createDataFrame(found, self.keys.schema)
        ids = F.col("event_id").isin([r["event_id"] for r in found])
        return replace(self, keys=keys, fetch=lambda source, page: self.fetch(source.filter(ids), page))

    def info(self) -> DataFrame:
        """One row: returned, has_more, next_cursor, oldest_ts, resume_from, notice."""
        ordered = ["score", "ts", "event_id", "device"] if self.ranked else ["ts", "event_id", "device"]
        any_source = self.source.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
        found = self.keys.agg(
            F.sort_array(F.collect_list(F.struct(*ordered)), asc=False).alias("k")).withColumn("in_source", any_source)
        shown = F.slice("k", 1, self.limit)
        last = F.try_element_at("shown", F.col("returned"))
        place = [F.lit(self.query).alias("q"), micros(last["ts"]).alias("ts"), last["event_id"].alias("id"),
                 last["device"].alias("d")]
        if not self.ranked:
            cursor = F.struct(*place)
        elif self.keyset:
            cursor = F.struct(*place, last["score"].alias("s"))
        else:
            cursor = F.struct(F.lit(self.query).alias("q"), F.lit(self.offset + self.limit).alias("o"))
        return (found.withColumn("shown", shown)
                .withColumn("returned", F.size("shown"))
                .withColumn("has_more", F.size("k") > self.limit)
                .withColumn("oldest_ts", F.array_min(F.transform("shown", lambda s: s["ts"])))
                .withColumn("next_cursor", F.when(F.col("has_more"), cursor_column(cursor)))
                .withColumn("resume_from", F.lit(None).cast("string"))
                .withColumn("notice", notice(F.col("returned") == 0, F.col("in_source") == 0,
                                             F.col("has_more"), self.stored_version))
                .select(*INFO_COLUMNS))


def notice(empty_page, empty_source, has_more, stored_version: int | None = None):
    """Says what an ambiguous outcome means; null when nothing is ambiguous."""
    newer = stored_version is not None and stored_version > SCHEMA_VERSION
    parts = F.concat_ws(
        "; ",
        F.when(empty_page & empty_source, F.lit("the table is empty"))
        .when(empty_page, F.lit("no row matches the filters"))
        .when(has_more, F.lit("page is full, more results exist")),
        F.lit(f"the table was written with schema version {stored_version}, newer than "
              f"{SCHEMA_VERSION}") if newer else F.lit(None).cast("string"))
    return F.when(parts != "", parts)
