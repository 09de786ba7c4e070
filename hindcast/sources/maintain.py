"""Commands that change stored tables and media."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.operators.density import adopt, flushed, guard_root, leftovers, reconcile, repoint
from hindcast.operators.index import update_postings
from hindcast.operators.ingest import new_events
from hindcast.operators.retention import EVENT, orphans, survivors
from hindcast.operators.transcript import CHUNK_LENGTH, TURN_GAP_MS, reach, turns_of, widen
from hindcast.session import MIB, shared_dir
from hindcast.sources.commit import publish, recover, stage
from hindcast.sources.kept import prune_kept
from hindcast.sources.tables import (day_range, media_inventory, read_activity, read_postings,
                                     write_activity)

ORDER = ["ts", "event_id"]
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps see one
    fixed version of it, even when an executor is lost."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _days(df: DataFrame) -> list[date]:
    """Distinct days; as many as the calendar has, not as many as there are rows."""
    return sorted(r["day"] for r in df.select("day").distinct().collect() if r["day"] is not None)


def delete_files(paths: DataFrame) -> None:
    """Delete the files in ``path``, in the tasks that hold them. Absent ones are fine."""
    def drop(rows):
        from pyarrow import fs
        for row in rows:
            system, name = fs.FileSystem.from_uri(row["path"] if "://" in row["path"] else "file://" + row["path"])
            if system.get_file_info(name).type == fs.FileType.File:
                system.delete_file(name)

    paths.select("path").distinct().foreachPartition(drop)


def upsert_events(spark: SparkSession, table: str, batch: DataFrame) -> None:
    """Append what the table lacks. A retried batch adds nothing."""
    target = read_activity(spark, table)
    write_activity(new_events(target, batch), table)


def compact(spark: SparkSession, table: str, start: date, end: date, codec: str = "zstd",
            target_mb: int = 256) -> None:
    """Rewrite a range of days in files of about ``target_mb``, sorted by time."""
    recover(spark, table)
    rows = read_activity(spark, table).filter(day_range(start, end))
    with _setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_mb * MIB)):
        publish(spark, table, stage(rows, table, "day", ORDER, {"compression": codec}))


def _rewrite_days(spark: SparkSession, table: str, changed: DataFrame, days: list[date],
                  emptied: list[date]) -> None:
    staged = stage(changed.filter(F.col("day").isin(days)), table, "day", ORDER)
    publish(spark, table, staged, [f"day={d.isoformat()}" for d in emptied])


def apply_prune(spark: SparkSession, table: str, plan: DataFrame, *, postings_path: str | None = None,
                kept_path: str | None = None, sweep: DataFrame | None = None, fail_after: str | None = None) -> DataFrame:
    """Remove the plan's events, then their files. Returns the stored plan.

    Rows go first: a crash leaves files no row names, never a row without its
    file. A day is dropped only if none of its stored events survives the
    plan; events that arrived after the plan was made stay. A file a surviving
    event also names is kept. ``sweep`` is the media inventory to clear of
    unreferenced files; only a plan that removes everything may pass one, as
    files exist before their rows. Of the tables kept for search at ``kept_path``
    only the plan's days are written. ``fail_after`` stops after a phase, for
    crash tests.
    """
    recover(spark, table)
    plan = _stored(spark, plan, "prune")
    if sweep is not None and not plan.filter(F.coalesce(F.col("reason") != "all", F.lit(True))).isEmpty():
        raise PermissionError("unreferenced files are swept only when everything is removed")
    activity = read_activity(spark, table)
    gone = plan.select(*EVENT, F.lit(1).alias("_gone")).distinct()
    per_day = (activity.select("day", *EVENT).join(gone, EVENT, "left").groupBy("day")
               .agg(F.count("_gone").alias("lost"), F.count_if(F.col("_gone").isNull()).alias("kept"))
               .filter("lost > 0").collect())
    partly, emptied = ([r["day"] for r in per_day if (r["kept"] > 0) == some] for some in (True, False))
    there = F.col("day").isin([d for d in partly if d]) | (F.col("day").isNull() & F.lit(None in partly))
    staged = stage(survivors(activity.filter(there), plan), table, "day", ORDER)
    publish(spark, table, staged, [f"day={d.isoformat() if d else NO_DAY}" for d in emptied])
    if fail_after == "rows":
        return plan
    if postings_path:
        recover(spark, postings_path)
        postings = spark.read.parquet(postings_path)
        kept = update_postings(postings, removed=plan)
        publish(spark, postings_path, stage(kept, postings_path, "bucket", ["term", "event_id"]), whole=True)
    if kept_path:
        prune_kept(spark, kept_path, plan)
    doomed = plan.filter(F.col("media_path").isNotNull()).select(F.col("media_path").alias("path"))
    if sweep is not None:
        doomed = doomed.unionByName(sweep.select("path"))
    delete_files(orphans(doomed, read_activity(spark, table)))
    return plan


def apply_replacements(spark: SparkSession, table: str, settled: DataFrame, root: str,
                       fail_after: str | None = None) -> DataFrame:
    """Repoint verified replacements, then delete their originals.

    The opposite order of a prune: the replacement exists and is verified
    before its row changes, and the original goes last. A replacement that is
    not in the media folders when this runs is ``flush_failed``: its row and its
    original stay. Returns the stored statuses.
    """
    recover(spark, table)
    activity = read_activity(spark, table)
    guard_root(activity, root)
    settled = _stored(spark, flushed(settled, media_inventory(spark, root)), "compress")
    done = settled.filter(F.col("status") == "replaced")
    days = _days(done)
    if days:
        changed = repoint(activity.filter(F.col("day").isin(days)), settled)
        _rewrite_days(spark, table, changed, days, [])
    if fail_after == "rows":
        return settled
    delete_files(orphans(done.select(F.col("media_path").alias("path")), read_activity(spark, table)))
    return settled


def apply_reconcile(spark: SparkSession, table: str, root: str) -> DataFrame:
    """Adopt surviving files, then remove leftovers. Returns the stored repairs."""
    recover(spark, table)
    activity = read_activity(spark, table)
    guard_root(activity, root)
    repairs = _stored(spark, reconcile(activity, media_inventory(spark, root)), "reconcile")
    adopted = repairs.filter(F.col("action") == "adopt").select(*EVENT)
    days = _days(activity.join(adopted, EVENT, "left_semi"))
    if days:
        _rewrite_days(spark, table, adopt(activity.filter(F.col("day").isin(days)), repairs), days, [])
    delete_files(leftovers(repairs))
    return repairs


def backfill_turns(spark: SparkSession, segments: DataFrame, envelopes: DataFrame | None, table: str,
                   start: date, end: date, gap_ms: int = TURN_GAP_MS, chunk: timedelta = CHUNK_LENGTH,
                   **labels) -> None:
    """Rebuild stored turns of a range of days from the segments; a turn that goes on behind the last day is whole."""
    recover(spark, table)
    since = datetime(start.year, start.month, start.day)
    until = datetime(end.year, end.month, end.day) + timedelta(days=1)
    behind = reach(segments, envelopes, until, gap_ms, chunk)
    near = widen(segments, since, until, None, chunk, behind)
    loud = None if envelopes is None else widen(envelopes, since, until, None, chunk, behind)
    turns = turns_of(near, loud, gap_ms, **labels).drop("segments").filter(day_range(start, end))
    publish(spark, table, stage(turns, table, "day", ["ts", "device", "turn_no"]))
