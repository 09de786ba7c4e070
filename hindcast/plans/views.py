"""Engine tables derived from the star-schema test tables (FIXTURES.md, V1-V6).

The same derivations are written in SQL in ``oracles.py``. Whole tables are
used; residues of ids only decide a row's properties.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.functions.text import search_terms
from hindcast.operators.density import target_path

CHUNK_MINUTES = 10
STEP_MS = 1250
SEG_MS, SEG_LEN_MS, BLEED_SHIFT_MS = 10_000, 5_000, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, dealt out by id: what is done with a text is then spread evenly, however few files hold them."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "documents").select("doc_id", *columns).repartition(parts, "doc_id")


def _rem(column: str, n: int):
    return F.col(column) % n


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 without the columns that come from documents."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    screen = _rem("event_id", 4) != 0
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("device"), "ts", F.to_date("ts").alias("day"),
        F.when(screen, "screen").otherwise("audio").alias("kind"),
        F.when(~screen, F.when(_rem("event_id", 8) == 0, "system").otherwise("mic")).alias("track"),
        F.when(screen, F.concat(F.lit("d"), _rem("event_id", 3).cast("string"))).alias("display_id"),
        F.col("event_type").alias("app"),
        F.concat(F.when(screen, "/data/screenshots/").otherwise("/data/audio/"),
                 F.col("event_id").cast("string"), F.when(screen, ".jpg").otherwise(".wav")).alias("media_path"),
        (F.get_json_object("props", "$.k").cast("long") * 1000).alias("media_bytes"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: events with the window and text of one document each."""
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return (events(spark, sf_dir).withColumn("doc_id", F.col("event_id") % n_docs)
            .join(corpus(spark, sf_dir, "source", "text"), "doc_id")
            .withColumn("window", F.when(_rem("event_id", 10) == 0, F.upper("app")).otherwise(F.col("source")))
            .withColumn("text", F.when(_rem("event_id", 17) != 0, F.col("text")))
            .drop("doc_id", "source"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: documents as a search corpus."""
    return corpus(spark, sf_dir, "source", "lang", "text").select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("app"), F.col("lang").alias("window"), "text")


def _chunk_of(ident: str):
    minutes = F.make_dt_interval(mins=F.col(ident) * CHUNK_MINUTES)
    return {"device": F.concat(F.lit("m"), _rem(ident, 4).cast("string")),
            "chunk_ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: conversation turns as audio segments, with bleed copies on the
    microphone track, untimed chunks and chunks without a machine transcript,
    where what the machine said is heard by the microphone only."""
    machine, copied = F.col("role") != "user", (F.col("role") == "assistant") & (_rem("conv_id", 3) == 0)
    told = _rem("conv_id", 7) != 3
    variants = F.array_compact(F.array(
        F.when(machine & told, F.struct(F.lit("system").alias("track"), F.lit(0).alias("shift"))),
        F.when(~machine | (~told & ~copied), F.struct(F.lit("mic").alias("track"), F.lit(0).alias("shift"))),
        F.when(copied, F.struct(F.lit("mic").alias("track"), F.lit(BLEED_SHIFT_MS).alias("shift")))))
    both = (table(spark, sf_dir, "conversations").withColumns(_chunk_of("conv_id"))
            .select("*", F.explode(variants).alias("v"))
            .select("conv_id", "device", "chunk_ts", "text", "v.track", F.col("turn").cast("int").alias("seg_no"),
                    (F.col("turn") * SEG_MS + F.col("v.shift")).alias("start_ms")))
    timed = ~_rem("conv_id", 5).isin(1, 2)
    start = F.when(timed, F.col("start_ms"))
    # Terms and their step are columns of their own: inside the lambda they would be made anew for every word.
    worded = (both.select("device", "chunk_ts", "track", F.when(_rem("conv_id", 5) != 2, F.col("seg_no")).alias("seg_no"),
                          start.alias("start_ms"), "text", search_terms("text").alias("terms"))
              .withColumn("step", F.floor(F.lit(SEG_LEN_MS) / F.greatest(F.size("terms"), F.lit(1)))))
    at, step = F.col("start_ms"), F.col("step")
    return worded.select(
        "device", "chunk_ts", "track", "seg_no", "start_ms", (at + SEG_LEN_MS).alias("end_ms"), "text",
        F.transform("terms", lambda w, i: F.struct(
            w.alias("w"), (at + i * step).alias("start_ms"), (at + (i + 1) * step).alias("end_ms"),
            F.lit(1.0).alias("conf"))).alias("words"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: files on disk for the V4 form of the events."""
    e = events(spark, sf_dir)
    swapped = target_path(F.col("media_path"))
    r, size, present = _rem("event_id", 20), F.col("media_bytes"), _rem("event_id", 50) != 0

    def file(when, path, length):
        return F.when(when, F.struct(path.alias("path"), length.alias("length")))

    files = F.array_compact(F.array(
        file(present & ~r.isin(7, 16), F.when(r.isin(3, 8), swapped).otherwise(F.col("media_path")), size),
        file(present & r.isin(5, 12, 7, 16), swapped, F.floor(size / 2)),
        file(_rem("event_id", 100) == 1, F.concat(F.lit("/data/screenshots/x"), F.col("event_id").cast("string"),
                                                  F.lit(".jpg")), F.lit(500).cast("long"))))
    return e.select(F.explode(files).alias("f")).select("f.*")


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 rows as compress finds them: some already done, some sharing a file."""
    e = events(spark, sf_dir)
    shared = F.concat(F.lit("/data/screenshots/"), (F.col("event_id") - 1).cast("string"), F.lit(".jpg"))
    path = (F.when(_rem("event_id", 20).isin(3, 8), target_path(F.col("media_path")))
            .when(_rem("event_id", 200) == 14, shared).otherwise(F.col("media_path")))
    return e.withColumn("media_path", path)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: one machine-track loudness trace per chunk."""
    return as_envelopes(table(spark, sf_dir, "embeddings"))


def as_envelopes(e: DataFrame) -> DataFrame:
    e = e.withColumns(_chunk_of("vec_id"))
    silent = _rem("vec_id", 10) == 0
    return e.select("device", "chunk_ts", F.lit("system").alias("track"), F.lit(STEP_MS).alias("step_ms"),
                    F.transform("embedding", lambda x: F.when(silent, F.lit(0.0)).otherwise(
                        F.abs(x.cast("double")))).alias("rms"))


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: a re-encode manifest whose damage depends on the label."""
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(
        F.lit(255.0), 128 + 300 * x.cast("double")))).cast("int"))
    src = F.col("src_sample")
    one_off = F.transform(src, lambda x, i: x + F.when(i % 2 == 0, 1).otherwise(-1))
    coarse = F.transform(src, lambda x: (F.floor(x / 64) * 64).cast("int"))
    dst = (F.when(F.col("label") < 5, src).when(F.col("label") < 8, one_off)
           .when(F.col("label") == 8, coarse).otherwise(F.reverse(src)))
    audio = _rem("vec_id", 4) == 0
    old = F.concat(F.when(audio, "/data/audio/").otherwise("/data/screenshots/"),
                   F.col("vec_id").cast("string"), F.when(audio, ".wav").otherwise(".jpg"))
    return (e.withColumn("src_sample", scaled).select(
        "vec_id", "label", F.when(audio, "audio").otherwise("screens").alias("medium"),
        old.alias("old_path"), target_path(old).alias("new_path"),
        F.lit(300).cast("long").alias("new_bytes"), "src_sample", dst.alias("dst_sample"),
        F.lit(8).alias("src_width"), F.lit(8).alias("src_height"),
        F.when(_rem("vec_id", 25) == 1, 4).otherwise(8).alias("dst_width"), F.lit(8).alias("dst_height"),
        F.lit(1).alias("channels")))
