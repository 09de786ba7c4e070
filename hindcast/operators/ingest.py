"""Cleaning and selection of captured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hindcast.functions.text import same_words

KEY = ["device", "event_id"]


def clean_titles(df: DataFrame) -> DataFrame:
    """Drop a window title that only repeats the application name."""
    return df.withColumn("window", F.when(~same_words(F.col("window"), F.col("app")), F.col("window")))


def clean_text(df: DataFrame) -> DataFrame:
    """Drop text that only repeats the window title."""
    return df.withColumn("text", F.when(~same_words(F.col("text"), F.col("window")), F.col("text")))


def select_displays(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Frames of the wanted displays; every frame of a device's hour in which
    none of them delivered; rows without a display pass.

    Wanted frames pass without moving. Only the others meet the list of hours
    that had a wanted display.
    """
    hour = F.date_trunc("hour", "ts")
    is_wanted = F.col("display_id").isin(wanted)
    hits = df.filter(is_wanted).select("device", hour.alias("_hour")).distinct()
    others = df.filter(~is_wanted).withColumn("_hour", hour)
    return (df.filter(F.col("display_id").isNull() | is_wanted)
            .unionByName(others.join(hits, ["device", "_hour"], "left_anti").select(*df.columns)))


def select_sources(df: DataFrame, kinds: list[str] | None = None, tracks: list[str] | None = None) -> DataFrame:
    """Rows of the chosen kinds and, for audio, the chosen tracks."""
    if kinds is not None:
        df = df.filter(F.col("kind").isin(kinds))
    if tracks is not None:
        df = df.filter(F.col("track").isNull() | F.col("track").isin(tracks))
    return df


def new_events(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` the target lacks, each (device, event_id) once.

    Only the days the batch touches are read: the semi-join on ``day`` prunes
    target partitions at run time.
    """
    days = batch.select("day").distinct()
    present = target.select("day", *KEY).join(days, "day", "left_semi").drop("day")
    return batch.dropDuplicates(KEY).join(present, KEY, "left_anti").select(*batch.columns)
