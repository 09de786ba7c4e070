"""Live meters, displays, sessions and track health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery


def levels(envelopes: DataFrame, window: str = "10 seconds", delay: str | None = None) -> DataFrame:
    """Peak and mean loudness per track and window; the same for batch and stream."""
    if delay is not None:
        envelopes = envelopes.withWatermark("chunk_ts", delay)
    peak = F.array_max("rms").cast("double")
    total = F.aggregate("rms", F.lit(0.0), lambda acc, x: acc + x)
    return (envelopes.select("chunk_ts", "device", "track", peak.alias("peak"),
                             total.alias("total"), F.size("rms").alias("steps"))
            .groupBy(F.window("chunk_ts", window).alias("w"), "device", "track")
            .agg(F.max("peak").alias("peak"), F.sum("total").alias("total"), F.sum("steps").alias("steps"))
            .select(F.col("w.start").alias("window_start"), "device", "track",
                    F.round("peak", 6).alias("peak"),
                    F.round(F.when(F.col("steps") > 0, F.col("total") / F.col("steps")), 6).alias("mean")))


def live_displays(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Displays delivering per device and window, exactly: the set that is kept
    holds a device's displays, of which there are few."""
    return (stream.filter(F.col("display_id").isNotNull()).withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "device")
            .agg(F.size(F.collect_set("display_id")).cast("long").alias("displays"))
            .select(F.col("w.start").alias("window_start"), "device", "displays"))


def live_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Closed work sessions per device, in append mode."""
    return (stream.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("w"), "device")
            .agg(F.count(F.lit(1)).alias("events"))
            .select("device", F.col("w.start").alias("session_start"),
                    F.col("w.end").alias("session_until"), "events"))


def track_health(stream: DataFrame, gap_s: int = 60, delay: str = "1 minute",
                 expected: DataFrame | None = None) -> DataFrame:
    """One ``no_signal`` row per silence of a track longer than ``gap_s``.

    ``stream`` has (device, track, ts). A run of signals no further apart than
    the gap is a session; each session that ends is one silence, whichever
    batches its rows came in. In append mode a session ends as other tracks
    move the watermark on. ``expected`` (device, track, ts) adds first rows for
    tracks that may never deliver.
    """
    rows = stream.select("device", "track", "ts")
    if expected is not None:
        rows = rows.unionByName(expected.select("device", "track", "ts"))
    return (rows.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", f"{gap_s} seconds").alias("w"), "device", "track")
            .agg(F.max("ts").alias("last_ts"))
            .select("device", "track", "last_ts", F.col("w.end").alias("no_signal_at")))


def run_to_folder(df: DataFrame, folder: str, mode: str = "append", timeout_s: int = 600) -> StreamingQuery:
    """Run what is available into a Parquet folder, then stop. Complete-mode
    results replace the folder with each micro-batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", folder + "-checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", folder)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder))
    query = writer.trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"stream did not finish in {timeout_s} s")
    finally:
        query.stop()
    return query
