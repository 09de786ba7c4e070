"""Listings and time breakdowns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from hindcast.functions.timeparse import from_micros, micros
from hindcast.operators.filters import by_app, in_time_range
from hindcast.operators.paging import EVENTS_MAX, clamp

SECOND = 1_000_000
DWELL_CAP_S = 300
SESSION_GAP_S = 30 * 60


def _activity_by(df: DataFrame, column: str, limit: int | None) -> DataFrame:
    listed = (df.groupBy(column)
              .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"),
                   F.max("ts").alias("last_ts"))
              .orderBy(F.desc("events"), F.asc(column)))
    return listed if limit is None else listed.limit(clamp(limit, EVENTS_MAX, EVENTS_MAX))


def list_apps(activity: DataFrame, app: str | None = None, since=None, until=None,
              limit: int | None = None, now: datetime | None = None) -> DataFrame:
    """Applications, most active first; for one ``app``, its window titles."""
    df = in_time_range(activity, since, until, now)
    if app is not None:
        return list_windows(activity, app, since, until, limit, now)
    return _activity_by(df, "app", limit)


def list_windows(activity: DataFrame, app: str, since=None, until=None,
                 limit: int | None = None, now: datetime | None = None) -> DataFrame:
    df = in_time_range(activity, since, until, now)
    return _activity_by(df.filter(by_app(app)), "window", limit)


def dwell(activity: DataFrame, keys: list[str], cap_s: int = DWELL_CAP_S) -> DataFrame:
    """``keys``, events and dwell_us: time to the device's next event, capped.

    A gap longer than the cap counts as the cap, so an event's successor
    matters only within the cap. Devices are therefore cut into slots no
    shorter than the cap: gaps inside a slot come from a window over that slot,
    and the slot's last event looks only at the next slot's first, by an
    equi-join of slots. No task holds a device's whole history, or all its slots.
    """
    cap = cap_s * SECOND
    width = max(cap, DWELL_CAP_S * SECOND)
    slot = Window.partitionBy("device", "slot")
    in_slot = slot.orderBy("at", "event_id")
    rows = (activity.select("device", "event_id", micros("ts").alias("at"), *keys)
            .withColumn("slot", F.floor(F.col("at") / width)))
    cells = (rows.withColumn("gap", F.lead("at").over(in_slot) - F.col("at"))
             .groupBy("device", "slot", *keys)
             .agg(F.count(F.lit(1)).alias("events"),
                  F.coalesce(F.sum(F.when(F.col("gap") > cap, cap).otherwise(F.col("gap"))), F.lit(0)).alias("inner_us"),
                  F.max(F.when(F.col("gap").isNull(), F.col("at"))).alias("open_at")))
    firsts = rows.groupBy("device", "slot").agg(F.min("at").alias("next_at"))
    lasts = firsts.groupBy(F.col("device").alias("_d")).agg(F.max("slot").alias("last_slot"))
    nexts = firsts.select(F.col("device").alias("_device"), (F.col("slot") - 1).alias("_slot"), "next_at")
    closed = (cells.join(nexts, F.col("device").eqNullSafe(F.col("_device")) & (F.col("slot") == F.col("_slot")), "left")
              .join(lasts, F.col("device").eqNullSafe(F.col("_d")), "left"))
    outer = (F.when(F.col("open_at").isNull(), F.lit(0))
             .when(F.col("next_at").isNotNull(), F.least(F.col("next_at") - F.col("open_at"), F.lit(cap)))
             .when(F.col("slot") < F.col("last_slot"), F.lit(cap))
             .otherwise(F.lit(0)))
    return (closed.withColumn("us", F.col("inner_us") + outer)
            .groupBy(*keys)
            .agg(F.sum("events").alias("events"), F.sum("us").alias("dwell_us")))


def app_time(activity: DataFrame, since=None, until=None, cap_s: int = DWELL_CAP_S,
             now: datetime | None = None) -> DataFrame:
    """Where the time went, per application."""
    return dwell(in_time_range(activity, since, until, now), ["app"], cap_s)


def timeline(activity: DataFrame, bucket: str = "1 hour", since=None, until=None,
             now: datetime | None = None) -> DataFrame:
    """Events per fixed time bucket and application."""
    df = in_time_range(activity, since, until, now)
    return (df.groupBy(F.window("ts", bucket).alias("w"), "app")
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("bucket_start"), "app", "events"))


def sessions(activity: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Work sessions per device: runs of events no more than ``gap_s`` apart.

    Two events within one slot as long as the gap always belong together, so
    events collapse map-side to one row per (device, slot) before anything is
    ordered; what is ordered per device is bounded by elapsed time, not rows.
    """
    kind = dict(activity.dtypes)["ts"]
    gap = gap_s * SECOND
    device = Window.partitionBy("device").orderBy("slot")
    slots = (activity.select("device", micros("ts").alias("at"))
             .groupBy("device", F.floor(F.col("at") / gap).alias("slot"))
             .agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")))
    starts = F.coalesce(F.col("a") - F.lag("b").over(device) > gap, F.lit(True)).cast("int")
    return (slots.withColumn("fresh", starts)
            .withColumn("session_no", F.sum("fresh").over(device))
            .groupBy("device", "session_no")
            .agg(from_micros(F.min("a"), kind).alias("session_start"),
                 from_micros(F.max("b"), kind).alias("session_end"),
                 F.sum("n").alias("events")))


def digest(activity: DataFrame, since=None, until=None, k: int = 3, cap_s: int = DWELL_CAP_S,
           now: datetime | None = None) -> DataFrame:
    """Per day and application: total time and the top-``k`` windows by time.

    Ranking runs over aggregated rows, and the rank filter is pushed below its
    shuffle, so each task forwards at most ``k`` windows per group.
    """
    spent = dwell(in_time_range(activity, since, until, now), ["day", "app", "window"], cap_s)
    totals = (spent.groupBy("day", "app")
              .agg(F.sum("dwell_us").alias("app_us"), F.sum("events").alias("app_events")))
    best = Window.partitionBy("day", "app").orderBy(F.desc("dwell_us"), F.asc("window"))
    top = spent.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return (top.join(totals, ["day", "app"])
            .select("day", "app", "app_us", "app_events", "place", "window", "dwell_us", "events"))


def active_displays(activity: DataFrame, since=None, until=None, now: datetime | None = None) -> DataFrame:
    """Per device, the displays that delivered frames in the range."""
    df = in_time_range(activity, since, until, now).filter(F.col("display_id").isNotNull())
    return df.groupBy("device").agg(F.count_distinct("display_id").alias("displays"))


def storage_stats(activity: DataFrame) -> DataFrame:
    """Events, media bytes and time span per kind, and in total (kind null)."""
    return (activity.rollup("kind")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.coalesce(F.sum("media_bytes"), F.lit(0)).alias("media_bytes"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def media_store_stats(media: DataFrame) -> DataFrame:
    """Files and bytes per media directory, and in total (store null)."""
    store = F.element_at(F.split("path", "/"), -2)
    return (media.select(store.alias("store"), "length").rollup("store")
            .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
