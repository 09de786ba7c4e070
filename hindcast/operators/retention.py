"""Retention plans: which events an age or size policy removes.

A plan is a DataFrame (event_id, device, day, ts, media_path, media_bytes,
reason); dry run and apply use the same one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from hindcast.functions.timeparse import day_literal, instant, micros, parse_instant

PLAN_COLUMNS = ["event_id", "device", "day", "ts", "media_path", "media_bytes", "reason"]
EVENT = ["device", "event_id"]
LEVELS = ["day", "hour", "minute", "second", "millisecond", "microsecond"]
ID_BITS = (32, 16, 0)


def _plan(df: DataFrame, reason: str) -> DataFrame:
    return df.withColumn("reason", F.lit(reason)).select(*PLAN_COLUMNS)


def older_than(df: DataFrame, cutoff: datetime) -> DataFrame:
    return (df.filter(F.col("ts") < instant(df, "ts", cutoff))
            .filter(F.col("day") <= day_literal(cutoff.date())))


def by_age(activity: DataFrame, older: str | datetime, now: datetime | None = None) -> DataFrame:
    return _plan(older_than(activity, parse_instant(older, now)), "age")


def by_size(activity: DataFrame, max_bytes: int) -> DataFrame:
    """Everything but the longest newest run of events whose media fits.

    The cut is found by refining: bytes per day, then per hour of the day the
    cap falls in, and so on to the microsecond, and there by ranges of event
    ids. Each step is one small job that sums map-side, orders its cells and
    returns one; no task orders events. What is pruned then is a plain range of
    ``ts`` and, at its end, of ids, so whole days are partition drops.
    """
    if max_bytes < 0:
        raise ValueError("max_bytes is at least 0")
    inside, start, newer = activity, None, 0
    for level in LEVELS:
        newest = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
        cut = (inside.groupBy(F.date_trunc(level, "ts").alias("cell"))
               .agg(F.coalesce(F.sum("media_bytes"), F.lit(0)).alias("bytes"))
               .withColumn("upto", F.sum("bytes").over(newest) + newer)
               .filter(F.col("upto") > max_bytes)
               .agg(F.max(F.struct(micros("cell").alias("us"), (F.col("upto") - F.col("bytes")).alias("newer"))).alias("c"))
               .first()["c"])
        if cut is None:
            return _plan(activity.filter(F.lit(False)), "size")
        start, newer = datetime(1970, 1, 1) + timedelta(microseconds=cut["us"]), cut["newer"]
        inside = _between(activity, start, start + timedelta(**{level + "s": 1}))
    last = None
    for bits in ID_BITS:  # events of one instant, such as an import's, by ranges of ids
        newest = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
        cut = (inside.groupBy(F.shiftright("event_id", bits).alias("cell"))
               .agg(F.coalesce(F.sum("media_bytes"), F.lit(0)).alias("bytes"))
               .withColumn("upto", F.sum("bytes").over(newest) + newer).filter(F.col("upto") > max_bytes)
               .agg(F.max(F.struct("cell", (F.col("upto") - F.col("bytes")).alias("newer"))).alias("c")).first()["c"])
        last, newer = cut["cell"], cut["newer"]
        inside = inside.filter(F.shiftright("event_id", bits) == last)
    boundary = _between(activity, start, start + timedelta(microseconds=1)).filter(F.col("event_id") <= last)
    return _plan(older_than(activity, start), "size").unionByName(_plan(boundary, "size"))


def _between(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return (df.filter((F.col("ts") >= instant(df, "ts", start)) & (F.col("ts") < instant(df, "ts", end)))
            .filter(F.col("day").between(day_literal(start.date()), day_literal(end.date()))))


def plan_prune(activity: DataFrame, *, older=None, max_bytes: int | None = None, all: bool = False,
               confirm: bool = False, dry_run: bool = True, now: datetime | None = None) -> DataFrame:
    """Age first, then size over what age leaves. ``all`` takes every event and,
    unless it is a dry run, needs ``confirm``."""
    if all:
        if not (confirm or dry_run):
            raise PermissionError("removing everything cannot be undone: pass confirm=True")
        return _plan(activity, "all")
    if older is None and max_bytes is None:
        raise ValueError("name an age, a size or all")
    if older is None:
        return by_size(activity, max_bytes)
    aged = by_age(activity, older, now)
    if max_bytes is None:
        return aged
    cutoff = parse_instant(older, now)
    rest = activity.filter((F.col("ts") >= instant(activity, "ts", cutoff)) | F.col("ts").isNull())
    rest = rest.filter(F.col("day") >= day_literal(cutoff.date()))
    return aged.unionByName(by_size(rest, max_bytes))


def prune_report(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    return (plan.groupBy("reason")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.coalesce(F.sum("media_bytes"), F.lit(0)).alias("media_bytes"))
            .withColumn("dry_run", F.lit(dry_run)))


def orphans(media: DataFrame, activity: DataFrame) -> DataFrame:
    """Files no event names. Names are made distinct first, so a file many
    events name does not fill one task."""
    named = activity.select(F.col("media_path").alias("path")).distinct()
    return media.join(named, "path", "left_anti")


def dangling(activity: DataFrame, media: DataFrame) -> DataFrame:
    """Events naming a file that is not there."""
    named = activity.filter(F.col("media_path").isNotNull())
    return named.join(media.select(F.col("path").alias("media_path")), "media_path", "left_anti")


def survivors(activity: DataFrame, plan: DataFrame) -> DataFrame:
    return activity.join(plan.select(*EVENT), EVENT, "left_anti").select(*activity.columns)
