"""One ordered conversation from paired audio tracks.

``system`` is what the machine played, ``mic`` what the microphone picked up.
Chunks are read whole: filters on the result come after the labels are decided.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from hindcast.functions.signal import share_above, span
from hindcast.functions.text import search_terms
from hindcast.functions.timeparse import from_micros, instant, micros, parse_instant
from hindcast.operators.filters import DEFAULT_TEXT_CHARS, cap_text, in_time_range
from hindcast.operators.paging import (INFO_COLUMNS, TURNS_DEFAULT, TURNS_MAX, clamp, cursor_column,
                                       decode_cursor, notice, query_hash)
from hindcast.plans.slices import SEED, running_max

CHUNK = ["device", "chunk_ts"]
BLEED_SHARE = 0.8
BLEED_TOLERANCE_MS = 250
LOUD = 0.05
LOUD_SHARE = 0.5
TURN_GAP_MS = 2_000
TURN_SLOT_S = 300
FIRST_REACH = timedelta(hours=1)
CHUNK_LENGTH = timedelta(minutes=10)
FAR = 1 << 52
LAST_SEG = (1 << 31) - 1
LEAN = ["device", "ts", "turn_no", "origin", "text", "confidence", "order_confidence"]


def mark_silent(envelopes: DataFrame, eps: float = 0.0) -> DataFrame:
    """``silent``: no step of the track is louder than ``eps``."""
    return envelopes.withColumn("silent", F.coalesce(F.array_max("rms") <= eps, F.lit(True)))


def drop_silent(segments: DataFrame, envelopes: DataFrame, eps: float = 0.0) -> DataFrame:
    """Segments whose track was not digitally silent."""
    silent = mark_silent(envelopes, eps).filter("silent").select(*CHUNK, "track").distinct()
    return segments.join(silent, [*CHUNK, "track"], "left_anti")


def pair_tracks(segments: DataFrame) -> DataFrame:
    """One row per chunk saying what each track holds; a partial aggregate, no join."""
    def of(track: str) -> Column:
        return F.sum((F.col("track") == track).cast("long"))
    return (segments.groupBy(*CHUNK)
            .agg(of("system").alias("system_segments"), of("mic").alias("mic_segments"),
                 F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
            .withColumn("paired", (F.col("system_segments") > 0) & (F.col("mic_segments") > 0)))


def words(segments: DataFrame) -> DataFrame:
    """One row per timed word.

    An outer explode with a filter behind it: for a plain one Spark infers that the array is not empty, pushes that below
    the columns the array is made of and puts them into its lambda, so that a text is split anew for each of its words.
    """
    return (segments.select(*CHUNK, "track", "seg_no", F.posexplode_outer("words").alias("word_no", "word"))
            .filter(F.col("word_no").isNotNull()).select(*CHUNK, "track", "seg_no", "word_no", "word.*"))


def _seg_key() -> Column:
    return F.xxhash64("track", "seg_no", "start_ms", "end_ms", "text")


def _spoken(segments: DataFrame) -> Column:
    """Terms with the time in which they were said."""
    whole = F.transform(F.array_distinct(search_terms("text")), lambda w: F.struct(
        w.alias("w"), F.col("start_ms").alias("start_ms"), F.col("end_ms").alias("end_ms")))
    if "words" not in segments.columns:
        return whole
    timed = F.transform("words", lambda x: F.struct(
        F.lower(x["w"]).alias("w"), F.coalesce(x["start_ms"], F.col("start_ms")).alias("start_ms"),
        F.coalesce(x["end_ms"], F.col("end_ms")).alias("end_ms")))
    return F.when(F.size("words") > 0, timed).otherwise(whole)


def bleed_coverage(segments: DataFrame, tol_ms: int = BLEED_TOLERANCE_MS) -> DataFrame:
    """Per microphone segment: its distinct terms, and how many of them the
    machine's track says at the same time, within ``tol_ms``, by word timings.

    No pair of segments is formed. A word is covered when, among the machine's
    words of that term that start no later than it ends, the latest end reaches
    its start: one running maximum per (chunk, term). A term is
    covered if one of its words is. Segments without word timings count as said
    throughout; unknown times count as overlapping.
    """
    is_mic = F.col("track") == "mic"
    spread = (segments.filter(F.col("track").isin("mic", "system")).select(
        *CHUNK, is_mic.cast("int").alias("is_mic"), F.when(is_mic, _seg_key()).alias("seg_key"),
        F.explode(_spoken(segments)).alias("s"))
        .select(*CHUNK, "is_mic", "seg_key", F.col("s.w").alias("w"),
                F.coalesce("s.start_ms", F.lit(-FAR)).alias("a"), F.coalesce("s.end_ms", F.lit(FAR)).alias("b")))
    # The one shuffle: windows and groups below all lie within a chunk.
    placed = spread.repartition(*CHUNK).select(
        *CHUNK, "w", "is_mic", "seg_key", F.col("a"),
        F.when(F.col("is_mic") == 1, F.col("b")).otherwise(F.col("a") - tol_ms).alias("pos"),
        F.when(F.col("is_mic") == 0, F.col("b") + tol_ms).alias("reach"))
    upto = (Window.partitionBy(*CHUNK, "w").orderBy("pos", "is_mic")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.withColumn("latest", F.max("reach").over(upto)).filter(F.col("is_mic") == 1)
            .groupBy(*CHUNK, "seg_key", "w")
            .agg(F.max(F.coalesce(F.col("latest") >= F.col("a"), F.lit(False)).cast("long")).alias("found"))
            .groupBy(*CHUNK, "seg_key")
            .agg(F.count(F.lit(1)).alias("terms"), F.sum("found").alias("covered"))
            .withColumn("coverage", F.col("covered") / F.col("terms")))


def with_coverage(segments: DataFrame, tol_ms: int = BLEED_TOLERANCE_MS) -> DataFrame:
    """Segments with ``terms``, ``covered`` and ``coverage``, zero on the machine's track."""
    return (segments.withColumn("seg_key", _seg_key())
            .join(bleed_coverage(segments, tol_ms), [*CHUNK, "seg_key"], "left").drop("seg_key")
            .fillna(0, ["terms", "covered"]).fillna(0.0, ["coverage"]))


def mic_coverage(segments: DataFrame, tol_ms: int = BLEED_TOLERANCE_MS) -> DataFrame:
    return with_coverage(segments, tol_ms).filter(F.col("track") == "mic")


def drop_bleed(segments: DataFrame, tau: float = BLEED_SHARE, tol_ms: int = BLEED_TOLERANCE_MS) -> DataFrame:
    """Segments without the microphone's copies of the machine's own speech."""
    return with_coverage(segments, tol_ms).filter(F.col("coverage") < tau)


def energy_overlap(segments: DataFrame, envelopes: DataFrame, theta: float = LOUD) -> DataFrame:
    """``energy_ratio``: share of each segment's span in which the machine's own
    track was louder than ``theta``. Arrays are sliced, not exploded."""
    system = (envelopes.filter(F.col("track") == "system")
              .select(*CHUNK, F.col("step_ms").alias("_step"), F.col("rms").alias("_rms")))
    heard = span(F.col("_rms"), F.col("_step"), F.col("start_ms"), F.col("end_ms"))
    return (segments.join(system, CHUNK, "left")
            .withColumn("energy_ratio", F.coalesce(share_above(heard, theta), F.lit(0.0)))
            .drop("_step", "_rms"))


def untold(segments: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Machine-track envelopes of chunks without a machine transcript;
    ``spoken`` says whether the chunk has any segment at all."""
    chunks = segments.groupBy(*CHUNK).agg(F.max(F.col("track") == "system").alias("told"))
    return (envelopes.filter(F.col("track") == "system").join(chunks, CHUNK, "left")
            .filter(~F.coalesce("told", F.lit(False)))
            .withColumn("spoken", F.col("told").isNotNull()).drop("told"))


def label_origin(segments: DataFrame, envelopes: DataFrame | None = None, *, tau: float = BLEED_SHARE,
                 tol_ms: int = BLEED_TOLERANCE_MS, theta: float = LOUD,
                 loud_share: float = LOUD_SHARE) -> DataFrame:
    """Segments with ``origin``, ``confidence`` and ``order_confidence``; bleed is gone.

    ``unknown`` needs a chunk whose machine track left no segment: then a
    microphone segment spoken over machine sound cannot be told apart, and a
    chunk with machine sound and no segment at all yields one row without text.
    """
    shape = [*CHUNK, "track", "seg_no", "start_ms", "end_ms", "text", "origin", "confidence"]
    kept = drop_bleed(segments, tau, tol_ms)
    if envelopes is None:
        heard, silent = kept.withColumn("energy_ratio", F.lit(0.0)), None
    else:
        quiet = untold(segments, envelopes)
        heard = energy_overlap(kept, quiet, theta)
        silent = (quiet.filter(~F.col("spoken"))
                  .withColumn("confidence", share_above(F.col("rms"), theta))
                  .filter(F.col("confidence") >= loud_share)
                  .select(*CHUNK, "track", "confidence", F.lit("unknown").alias("origin")))
    over = F.col("energy_ratio") >= loud_share
    labelled = heard.withColumns({
        "origin": F.when(F.col("track") == "system", "internal").when(over, "unknown").otherwise("external"),
        "confidence": F.when(F.col("track") == "system", 1.0).when(over, F.col("energy_ratio"))
        .otherwise(1 - F.col("coverage"))}).select(*shape)
    if silent is not None:
        labelled = labelled.unionByName(silent, allowMissingColumns=True)
    return labelled.withColumn(
        "order_confidence",
        F.when(F.col("start_ms").isNotNull(), "exact")
        .when(F.col("seg_no").isNotNull(), "sequence").otherwise("approximate"))


def build_turns(labelled: DataFrame, gap_ms: int = TURN_GAP_MS, slot_s: int = TURN_SLOT_S) -> DataFrame:
    """Adjacent segments of one origin joined into turns.

    A turn breaks where origin or order confidence changes, and at a gap longer
    than ``gap_ms``. The rows of a device are compared in clock slots of
    ``slot_s``; each slot begins with the last row before it, so the clock
    breaks no turn, and no task orders more than one slot of rows or one row
    per slot. ``turn_no`` tells turns apart that begin at the same time: rows
    that arrive late renumber nothing else.
    """
    time_type = dict(labelled.dtypes)["chunk_ts"]
    # Every use of the placed rows below needs these columns and no others: their
    # shuffle is then one and the same, and the labels are made once.
    order = ["at", "chunk_ts", "seg", "track", "said", "confidence"]
    compared = ["until", "origin", "order_confidence"]
    placed = labelled.withColumns({
        "at": micros("chunk_ts") + F.coalesce("start_ms", F.lit(0)) * 1000,
        "until": micros("chunk_ts") + F.coalesce("end_ms", "start_ms", F.lit(0)) * 1000,
        "seg": F.coalesce("seg_no", F.lit(LAST_SEG)),
        "said": F.coalesce("text", F.lit("")),
    }).withColumn("slot", F.floor(F.col("at") / (slot_s * 1_000_000)))
    placed = placed.select("device", "slot", *order, *compared).repartition("device", "slot")
    slots = Window.partitionBy("device").orderBy("slot")
    seeds = (placed.groupBy("device", "slot").agg(F.max(F.struct(*order, *compared)).alias("end"))
             .withColumn("end", F.lag("end").over(slots)).filter(F.col("end").isNotNull())
             .select("device", "slot", "end.*", F.lit(True).alias(SEED)))
    slot = Window.partitionBy("device", "slot").orderBy(F.desc(SEED), *order)
    same = ((F.lag("origin").over(slot) == F.col("origin"))
            & (F.lag("order_confidence").over(slot) == F.col("order_confidence"))
            & (F.col("at") - F.lag("until").over(slot) <= gap_ms * 1000))
    marked = (placed.withColumn(SEED, F.lit(False)).unionByName(seeds, allowMissingColumns=True)
              .withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).filter(~F.col(SEED))
              .withColumn("part", F.sum("fresh").over(Window.partitionBy("device", "slot").orderBy(*order))))
    before = slots.rowsBetween(Window.unboundedPreceding, -1)
    begun = (marked.groupBy("device", "slot").agg(F.sum("fresh").alias("n"))
             .select(F.col("device").alias("_device"), F.col("slot").alias("_slot"),
                     F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begun")))
    there = F.col("device").eqNullSafe(F.col("_device")) & (F.col("slot") == F.col("_slot"))
    spoken = F.array_sort(F.collect_list(F.struct(*order)))
    turns = (marked.join(begun, there).withColumn("turn", F.col("begun") + F.col("part"))
             .groupBy("device", "turn")
             .agg(F.min("at").alias("at"), F.first("origin").alias("origin"),
                  F.first("order_confidence").alias("order_confidence"),
                  F.min("confidence").alias("confidence"),
                  F.count(F.lit(1)).alias("segments"),
                  F.array_join(F.transform(spoken, lambda s: s["said"]), " ").alias("text"))
             .withColumn("ts", from_micros(F.col("at"), time_type))
             .withColumn("day", F.to_date("ts"))
             .withColumn("turn_no", F.row_number().over(Window.partitionBy("device", "at").orderBy("turn")).cast("long")))
    return (turns.select("device", "ts", "day", "turn_no", "origin", "text",
                    F.length("text").alias("text_len"), "segments",
                    F.round("confidence", 6).alias("confidence"), "order_confidence"))


def turns_of(segments: DataFrame, envelopes: DataFrame | None = None, gap_ms: int = TURN_GAP_MS,
             slot_s: int = TURN_SLOT_S, **labels) -> DataFrame:
    """Turns of whole tables; what :func:`get_transcript` and the backfill share."""
    return build_turns(label_origin(segments, envelopes, **labels), gap_ms, slot_s)


def reach(segments: DataFrame, envelopes: DataFrame | None, until: datetime, gap_ms: int,
          chunk: timedelta = CHUNK_LENGTH) -> timedelta:
    """How far behind ``until`` every device's turn that is open then has ended.

    A turn ends at the latest where nothing at all was said for ``gap_ms``,
    whatever the labels come to be. The time looked at grows four-fold until
    each device has such a pause in it or has fallen silent, so only what an
    unbroken turn covers is read.
    """
    gap, behind = gap_ms * 1000, FIRST_REACH
    at = micros("chunk_ts") + F.coalesce("start_ms", F.lit(0)) * 1000
    over = micros("chunk_ts") + F.coalesce("end_ms", "start_ms", F.lit(0)) * 1000
    end = int((until - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    while True:
        def within(df: DataFrame, limit: datetime) -> DataFrame:
            return df.filter((F.col("chunk_ts") >= instant(df, "chunk_ts", until - 2 * chunk))
                             & (F.col("chunk_ts") < instant(df, "chunk_ts", limit)))

        limit = end + behind // timedelta(microseconds=1)
        rows = within(segments, until + behind).select("device", at.alias("at"), over.alias("over"))
        if envelopes is not None:
            rows = rows.unionByName(within(envelopes, until + behind).select(
                "device", micros("chunk_ts").alias("at"), micros("chunk_ts").alias("over")))
        rows = rows.filter((F.col("over") >= end - gap) & (F.col("at") < limit))
        # Each row asks how far the rows before it reach, and then counts itself.
        asked = (rows.select("device", "at", "over", F.explode(F.array(F.lit(0), F.lit(1))).alias("counts"))
                 .withColumns({"over": F.when(F.col("counts") == 1, F.col("over")),
                               "slot": F.floor(F.col("at") / (TURN_SLOT_S * 1_000_000))}))
        paused = running_max(asked, ["device"], "slot", ["at", "counts"], "over", "latest").filter(
            (F.col("counts") == 0) & (F.col("at") >= end) & F.coalesce(F.col("at") > F.col("latest") + gap, F.lit(True)))
        still = (rows.groupBy("device").agg(F.max("over").alias("over")).filter(F.col("over") + gap >= limit)
                 .join(paused.select("device").distinct(), "device", "left_anti"))
        if still.isEmpty():
            return behind
        behind *= 4


def widen(df: DataFrame, since, until, now: datetime | None, chunk: timedelta, behind: timedelta) -> DataFrame:
    """Chunks a range of turns depends on: from one chunk before it, which shows
    whether its first segment goes on with an earlier turn, to ``behind`` it,
    where its last turn has ended (:func:`reach`)."""
    since, until = parse_instant(since, now), parse_instant(until, now)
    if since is not None:
        df = df.filter(F.col("chunk_ts") >= instant(df, "chunk_ts", since - 2 * chunk))
    if until is not None:
        df = df.filter(F.col("chunk_ts") < instant(df, "chunk_ts", until + behind))
    return df


@dataclass
class TurnPage:
    """``rows`` is the page, oldest first; ``keys`` one row more, without text."""

    rows: DataFrame
    keys: DataFrame
    source: DataFrame
    limit: int
    query: str
    latest: bool = False

    def info(self) -> DataFrame:
        any_source = self.source.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
        found = self.keys.agg(
            F.sort_array(F.collect_list(F.struct("ts", "device", "turn_no")), asc=not self.latest).alias("k")
        ).withColumn("in_source", any_source)
        rest = F.try_element_at("k", F.lit(self.limit + 1))
        cursor = F.struct(F.lit(self.query).alias("q"), micros(rest["ts"]).alias("ts"),
                          rest["device"].alias("device"), rest["turn_no"].alias("no"))
        return (found.withColumn("shown", F.slice("k", 1, self.limit))
                .withColumn("returned", F.size("shown"))
                .withColumn("has_more", F.size("k") > self.limit)
                .withColumn("oldest_ts", F.array_min(F.transform("shown", lambda s: s["ts"])))
                .withColumn("next_cursor", F.lit(None).cast("string"))
                .withColumn("resume_from", F.when(F.col("has_more"), cursor_column(cursor)))
                .withColumn("notice", notice(F.col("returned") == 0, F.col("in_source") == 0, F.col("has_more")))
                .select(*INFO_COLUMNS))


def page_turns(turns: DataFrame, *, since=None, until=None, origin: str | None = None,
               min_confidence: float | None = None, max_turns: int | None = None,
               max_text_chars: int = DEFAULT_TEXT_CHARS, latest: bool = False,
               resume: str | None = None, fields: list[str] | None = None,
               now: datetime | None = None) -> TurnPage:
    """A page of stored or freshly built turns."""
    limit = clamp(max_turns, TURNS_DEFAULT, TURNS_MAX)
    name = query_hash(since=since, until=until, origin=origin, min_confidence=min_confidence, latest=latest)
    df = in_time_range(turns, since, until, now)
    if origin is not None:
        df = df.filter(F.col("origin") == origin)
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= min_confidence)
    if resume is not None:
        p = decode_cursor(resume, name)
        at = instant(df, "ts", datetime(1970, 1, 1) + timedelta(microseconds=p["ts"]))
        place, mark = F.struct("ts", "device", "turn_no"), F.struct(at, F.lit(p["device"]), F.lit(p["no"]).cast("long"))
        df = df.filter(F.col("ts") <= at if latest else F.col("ts") >= at)
        df = df.filter(place <= mark if latest else place >= mark)
    key = ["ts", "device", "turn_no"]
    ordered = df.orderBy(*[F.desc(c) if latest else F.asc(c) for c in key])
    rows = ordered.limit(limit)
    rows = cap_text(rows, max_text_chars).select(*(fields or LEAN), "text_len", "truncated").orderBy(*key)
    return TurnPage(rows=rows, keys=ordered.select(*key).limit(limit + 1), source=turns, limit=limit,
                    query=name, latest=latest)


def get_transcript(segments: DataFrame, envelopes: DataFrame | None = None, *, since=None, until=None,
                   now: datetime | None = None, chunk: timedelta = CHUNK_LENGTH,
                   gap_ms: int = TURN_GAP_MS, **page) -> TurnPage:
    """Captured audio in range as one ordered conversation; its last turn is whole, however long it goes on."""
    end = parse_instant(until, now)
    behind = timedelta(0) if end is None else reach(segments, envelopes, end, gap_ms, chunk)
    near = widen(segments, since, until, now, chunk, behind)
    loud = None if envelopes is None else widen(envelopes, since, until, now, chunk, behind)
    return page_turns(turns_of(near, loud, gap_ms), since=since, until=until, now=now, **page)
