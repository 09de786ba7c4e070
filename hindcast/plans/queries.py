"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.functions.text import fingerprint, search_terms
from hindcast.functions.timeparse import parse_instant
from hindcast.operators import (density as C, filters as FL, fold, index, ingest, listing as A,
                                retention as R, search as Q, transcript as T)
from hindcast.operators.kept import Kept, all_groups
from hindcast.plans import views as V
from hindcast.session import configure, shared_dir
from hindcast import schema
from hindcast.sources import maintain, tables
from hindcast.sources.kept import build_kept
from hindcast.streaming import ingest as SI, live

NOW = "2024-01-31T00:00:00Z"
TERMS = ["chkeit", "besten", "chung"]
QUERY = "Chkeit, besten chung!"
SINCE, UNTIL = "2024-01-10T06:00:00Z", "2024-01-20T18:30:00+02:00"
SIZE_CAP = 100_000_000
TURN_GAP = 20_000
WIDE = 1 << 30

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return run


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return T.label_origin(V.segments(spark, d), V.envelopes(spark, d))


def _turns(spark: SparkSession, d: str, gap_ms: int = T.TURN_GAP_MS) -> DataFrame:
    return T.turns_of(V.segments(spark, d), V.envelopes(spark, d), gap_ms)


def _page_columns(page: DataFrame, *more: str) -> DataFrame:
    return page.select("event_id", "ts", "device", "kind", "app", "window", "similar_count",
                       "first_ts", "last_ts", "text", "text_len", "truncated", *more)


# Ingest and sources

@query
def event_scan(spark, d):
    return FL.in_time_range(V.events(spark, d), SINCE, UNTIL)


@query
def storage_stats(spark, d):
    return A.storage_stats(V.events(spark, d))


@query
def media_store_stats(spark, d):
    return A.media_store_stats(V.media(spark, d))


@query
def clean_titles(spark, d):
    return ingest.clean_titles(V.activity(spark, d)).select("event_id", "app", "window")


@query
def clean_text(spark, d):
    doubled = V.activity(spark, d).withColumn(
        "text", F.when(F.col("event_id") % 3 == 0, F.initcap("window")).otherwise(F.col("text")))
    return ingest.clean_text(doubled).select("event_id", "window", "text")


@query
def upsert_new_events(spark, d):
    """The table holds the first half of the record; the batch retries the whole, twice."""
    rows = V.events(spark, d)
    target = rows.filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return ingest.new_events(target, rows.unionByName(rows))


@query
def select_displays(spark, d):
    shown = V.events(spark, d).withColumn("display_id", F.when(F.col("kind") == "screen", F.col("app")))
    return ingest.select_displays(shown, ["view", "click"]).select("event_id", "device", "ts", "display_id")


@query
def select_sources(spark, d):
    return ingest.select_sources(V.events(spark, d), ["audio"], ["mic"]).select("event_id", "kind", "track")


@query
def mark_silent(spark, d):
    return T.mark_silent(V.envelopes(spark, d)).select("device", "chunk_ts", "track", "silent")


@query
def drop_silent(spark, d):
    return (T.drop_silent(V.segments(spark, d), V.envelopes(spark, d))
            .select("device", "chunk_ts", "track", "seg_no", "start_ms", "text"))


# Filters and projections

@query
def filter_kind(spark, d):
    return FL.filter_events(V.activity(spark, d), kind="audio").select("event_id", "kind", "app", "window")


@query
def filter_app(spark, d):
    return FL.filter_events(V.activity(spark, d), app="VIEW").select("event_id", "kind", "app", "window")


@query
def search_window_sub(spark, d):
    return FL.filter_events(V.activity(spark, d), window="RC1").select("event_id", "kind", "app", "window")


@query
def search_time_range(spark, d):
    return FL.filter_events(V.activity(spark, d), since=SINCE, until=UNTIL).select("event_id", "ts", "app", "window")


@query
def search_since_duration(spark, d):
    return FL.filter_events(V.activity(spark, d), since="36h30m", now=parse_instant(NOW)).select("event_id", "ts", "app")


@query
def search_require_text(spark, d):
    return FL.filter_events(V.activity(spark, d), require_text=True).select("event_id", "app", "window")


@query
def get_event(spark, d):
    return FL.get_event(V.activity(spark, d), 77).select("event_id", "ts", "app", "window", "media_path", "text")


@query
def get_events_bulk(spark, d):
    ids = V.table(spark, d, "labels").select(F.col("doc_id").alias("event_id"))
    return FL.get_events(V.activity(spark, d), ids).select("event_id", "ts", "app", "window", "text")


@query
def cap_text(spark, d):
    return FL.cap_text(V.activity(spark, d)).select("event_id", "text", "text_len", "truncated")


@query
def search_excerpt(spark, d):
    return FL.excerpt(V.docs(spark, d), TERMS).select("event_id", "text", "text_len", "truncated")


# Search

@query
def terms_df(spark, d):
    return (V.docs(spark, d).select(F.explode(search_terms("text")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("uses")))


@query
def postings_build(spark, d):
    return index.build_postings(V.docs(spark, d)).select("term", "event_id", "tf", "dl")


@query
def postings_update(spark, d):
    """Events of one source leave the index, those of another are indexed again."""
    docs = V.docs(spark, d)
    old = index.build_postings(docs.filter(F.col("app") != "src1"))
    return index.update_postings(old, added=docs.filter(F.col("app").isin("src1", "src2")),
                                 removed=docs.filter(F.col("app") == "src3")).select("term", "event_id", "tf", "dl")


@query
def corpus_stats(spark, d):
    return index.corpus_stats(V.docs(spark, d)).select(F.col("n_docs"), F.col("total_dl"))


def _stored_index(spark, d) -> DataFrame:
    """The documents' index, written and read back, so that a search reads only
    its terms' buckets."""
    folder = shared_dir(spark, "postings")
    tables.write_postings(index.build_postings(V.docs(spark, d), buckets=16), folder)
    return tables.read_postings(spark, folder)


@query
def search_all(spark, d):
    return index.matching_events(_stored_index(spark, d), TERMS[:2], "all", buckets=16).select("event_id", "matched")


@query
def search_any(spark, d):
    return index.matching_events(_stored_index(spark, d), TERMS, "any", buckets=16).select("event_id", "matched")


@query
def search_ranked(spark, d):
    """Scores of every matching document, from the stored index."""
    postings = _stored_index(spark, d)
    return (index.rank(postings, TERMS, index.corpus_stats(V.docs(spark, d)), "any", buckets=16)
            .select("event_id", "matched", "score"))


@query
def search_ranked_scan(spark, d):
    """The same scores without an index."""
    docs = V.docs(spark, d)
    return index.rank_by_scan(docs, docs, TERMS, "any").select("event_id", "score")


_kept_tables: dict[tuple[str, str], Kept] = {}


def _kept(spark: SparkSession, d: str) -> Kept:
    """The tables that search keeps of the events, written once in an application, as they are by ingest."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _kept_tables:
        _kept_tables[name] = build_kept(spark, V.activity(spark, d), shared_dir(spark, "kept"), buckets=64)
    return _kept_tables[name]


@query
def search_newest(spark, d):
    return _page_columns(Q.search_events(V.activity(spark, d), kept=_kept(spark, d)).rows)


@query
def search_newest_scan(spark, d):
    """The same page without kept tables."""
    return _page_columns(Q.search_events(V.activity(spark, d)).rows)


@query
def search_kind_app(spark, d):
    return _page_columns(Q.search_events(V.activity(spark, d), kind="screen", app="Error", limit=50,
                                         kept=_kept(spark, d)).rows)


@query
def search_relevance(spark, d):
    """A ranked, folded page of events matching any term, inside a time range."""
    page = Q.search_events(V.activity(spark, d), QUERY, match="any", since=SINCE, until=UNTIL, limit=40,
                           kept=_kept(spark, d))
    return _page_columns(page.rows, "score")


@query
def search_relevance_scan(spark, d):
    """The same page without kept tables: statistics and matches from the text."""
    page = Q.search_events(V.activity(spark, d), QUERY, match="any", since=SINCE, until=UNTIL, limit=40)
    return _page_columns(page.rows, "score")


@query
def search_offset(spark, d):
    page = Q.search_events(V.activity(spark, d), QUERY, match="any", since=SINCE, until=UNTIL, limit=40, offset=40)
    return _page_columns(page.rows, "score")


@query
def search_ranked_page2(spark, d):
    """The page behind a ranked cursor, which is a position and not an offset."""
    activity, kept = V.activity(spark, d), _kept(spark, d)
    first = Q.search_events(activity, QUERY, match="any", since=SINCE, until=UNTIL, limit=40, kept=kept)
    cursor = first.info().first()["next_cursor"]
    if cursor is None:  # no page is behind the last one
        return _page_columns(first.rows, "score").filter(F.lit(False))
    return _page_columns(Q.search_events(activity, QUERY, match="any", since=SINCE, until=UNTIL, limit=40, cursor=cursor,
                                         kept=kept).rows, "score")


@query
def search_page2_keyset(spark, d):
    activity, kept = V.activity(spark, d), _kept(spark, d)
    first = Q.search_events(activity, kind="screen", limit=30, kept=kept)
    cursor = first.info().first()["next_cursor"]
    if cursor is None:
        return _page_columns(first.rows).filter(F.lit(False))
    return _page_columns(Q.search_events(activity, kind="screen", limit=30, cursor=cursor, kept=kept).rows)


@query
def search_expanded(spark, d):
    return _page_columns(Q.search_events(V.activity(spark, d), expand_similar=True, limit=500).rows)


@query
def page_info(spark, d):
    """Full page, empty page and last page of one table."""
    activity = V.activity(spark, d)
    full = Q.search_events(activity, limit=25).info()
    none = Q.search_events(activity, app="no such app").info()
    few = Q.search_events(activity, since="20m", now=parse_instant("2024-01-02T00:00:00Z"),
                          until="2024-01-02T00:00:00Z", limit=500).info()
    cases = [i.select(F.lit(n).alias("case_name"), "returned", "has_more", "oldest_ts", "notice",
                      F.col("next_cursor").isNotNull().alias("has_cursor"))
             for n, i in (("full", full), ("none", none), ("few", few))]
    return cases[0].unionByName(cases[1]).unionByName(cases[2])


@query
def search_fold(spark, d):
    return all_groups(_kept(spark, d))


@query
def search_fold_scan(spark, d):
    """The same groups from the text."""
    return fold.fold_similar(V.activity(spark, d))


@query
def fold_across_apps(spark, d):
    """Folding with one app and window for all rows, so that copies across sources meet."""
    rows = V.docs(spark, d).withColumns({
        "device": F.lit("m"), "kind": F.lit("screen"), "app": F.lit("a"), "window": F.lit("w"),
        "ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id"))})
    return fold.fold_similar(rows).select("event_id", "similar_count", "first_ts", "last_ts")


@query
def fold_near(spark, d):
    """Documents as screens of one window, near copies merged."""
    rows = V.docs(spark, d).withColumns({
        "device": F.lit("m"), "kind": F.lit("screen"), "app": F.col("window"), "window": F.lit("w"),
        "ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id"))})
    return (fold.fold_similar(rows, mode="near", threshold=0.8)
            .select("app", "event_id", "similar_count", "first_ts", "last_ts"))


@query
def fingerprints(spark, d):
    return V.docs(spark, d).select("event_id", fingerprint("text").alias("print"))


# Listings

@query
def list_apps(spark, d):
    return A.list_apps(V.events(spark, d))


@query
def list_windows(spark, d):
    return A.list_apps(V.activity(spark, d), app="Click", since=SINCE)


@query
def app_time(spark, d):
    return A.app_time(V.events(spark, d))


@query
def app_time_range(spark, d):
    return A.app_time(V.events(spark, d), since=SINCE, until=UNTIL, cap_s=4 * 3600)


@query
def timeline(spark, d):
    return A.timeline(V.events(spark, d), "1 hour")


@query
def sessions(spark, d):
    return A.sessions(V.events(spark, d))


@query
def digest_topk(spark, d):
    return A.digest(V.activity(spark, d), since="2024-01-08T00:00:00Z", until="2024-01-15T00:00:00Z", k=3)


@query
def active_displays(spark, d):
    return A.active_displays(V.events(spark, d), since="240h", now=parse_instant(NOW))


# Transcript

@query
def pair_tracks(spark, d):
    return T.pair_tracks(V.segments(spark, d))


@query
def words(spark, d):
    return T.words(V.segments(spark, d)).select(
        "device", "chunk_ts", "track", "seg_no", "word_no", "w", "start_ms", "end_ms")


@query
def bleed_coverage(spark, d):
    return (T.mic_coverage(V.segments(spark, d))
            .select("device", "chunk_ts", "seg_no", "start_ms", F.md5("text").alias("text_md5"),
                    "terms", "covered", F.round("coverage", 6).alias("coverage")))


@query
def drop_bleed(spark, d):
    return (T.drop_bleed(V.segments(spark, d)).filter(F.col("track") == "mic")
            .select("device", "chunk_ts", "seg_no", "start_ms", "text"))


@query
def energy_overlap(spark, d):
    mic = V.segments(spark, d).filter(F.col("track") == "mic")
    return (T.energy_overlap(mic, V.envelopes(spark, d))
            .select("device", "chunk_ts", "seg_no", "start_ms", F.md5("text").alias("text_md5"),
                    F.round("energy_ratio", 6).alias("energy_ratio")))


@query
def label_origin(spark, d):
    return _labelled(spark, d).select(
        "device", "chunk_ts", "track", "seg_no", "start_ms", "text", "origin",
        F.round("confidence", 6).alias("confidence"), "order_confidence")


@query
def turns_all(spark, d):
    return _turns(spark, d)


@query
def turns_merged(spark, d):
    return _turns(spark, d, TURN_GAP)


@query
def transcript(spark, d):
    page = T.get_transcript(V.segments(spark, d), V.envelopes(spark, d), since="2024-01-01T02:00:00Z",
                            until="2024-01-01T09:00:00Z", max_turns=1000)
    return page.rows


@query
def transcript_origin(spark, d):
    return T.get_transcript(V.segments(spark, d), V.envelopes(spark, d), origin="unknown", max_turns=1000).rows


@query
def transcript_min_conf(spark, d):
    return T.get_transcript(V.segments(spark, d), V.envelopes(spark, d), min_confidence=0.9, max_turns=1000,
                            max_text_chars=WIDE).rows


@query
def transcript_latest(spark, d):
    return T.get_transcript(V.segments(spark, d), V.envelopes(spark, d), latest=True, max_turns=25).rows


@query
def transcript_resume(spark, d):
    """The second page, from where the first one says to resume."""
    turns = _turns(spark, d)
    resume = T.page_turns(turns, max_turns=40).info().first()["resume_from"]
    return T.page_turns(turns, max_turns=40, resume=resume).rows


@query
def transcript_info(spark, d):
    return T.page_turns(_turns(spark, d), max_turns=40).info().select(
        "returned", "has_more", "oldest_ts", "notice")


# Retention

@query
def prune_age(spark, d):
    return R.plan_prune(V.events(spark, d), older="360h", now=parse_instant(NOW))


@query
def prune_size(spark, d):
    return R.plan_prune(V.events(spark, d), max_bytes=SIZE_CAP)


@query
def prune_combined(spark, d):
    return R.plan_prune(V.events(spark, d), older="480h", max_bytes=SIZE_CAP, now=parse_instant(NOW))


@query
def prune_report(spark, d):
    return R.prune_report(R.plan_prune(V.events(spark, d), older="480h", max_bytes=SIZE_CAP, now=parse_instant(NOW)))


@query
def prune_all_dry_run(spark, d):
    return R.prune_report(R.plan_prune(V.events(spark, d), all=True))


@query
def prune_survivors(spark, d):
    rows = V.events(spark, d)
    return R.survivors(rows, R.plan_prune(rows, older="360h", now=parse_instant(NOW))).select("event_id", "ts")


@query
def orphans(spark, d):
    return R.orphans(V.media(spark, d), V.events(spark, d))


@query
def dangling(spark, d):
    return R.dangling(V.events(spark, d), V.media(spark, d)).select("event_id", "media_path")


# Storage density

def _plan(spark, d) -> DataFrame:
    return C.plan_compress(V.stored_events(spark, d), V.media(spark, d), now=parse_instant(NOW))


def _verified(spark, d) -> DataFrame:
    return C.verify(V.replacements(spark, d))


def _settled(spark, d) -> DataFrame:
    """Rows of every 41st event were moved by someone else since the plan."""
    current = V.stored_events(spark, d).withColumn("media_path", F.when(
        F.col("event_id") % 41 == 0, F.concat("media_path", F.lit(".moved"))).otherwise(F.col("media_path")))
    return C.settle(_plan(spark, d), current, _verified(spark, d))


@query
def compress_plan(spark, d):
    return _plan(spark, d)


@query
def compress_plan_audio_only(spark, d):
    return C.plan_compress(V.stored_events(spark, d), V.media(spark, d), older_than="240h", screens=False,
                           now=parse_instant(NOW)).select("event_id", "pass", "status")


@query
def compress_conflicts(spark, d):
    return C.conflicts(V.stored_events(spark, d)).select("event_id", "media_path", "target")


@query
def compress_guard(spark, d):
    moved = V.stored_events(spark, d).withColumn("media_path", F.when(
        F.col("event_id") % 1000 == 9, F.concat(F.lit("/data/screenshots/../../else/"), F.col("event_id").cast("string"), F.lit(".jpg")))
        .otherwise(F.col("media_path")))
    return C.outside_root(moved, "/data")


@query
def compress_dry_run(spark, d):
    return C.dry_run_report(_plan(spark, d))


@query
def verify_audio(spark, d):
    return C.verify_audio(V.replacements(spark, d)).select("vec_id", "label", "verified")


@query
def verify_psnr(spark, d):
    return C.verify_images(V.replacements(spark, d)).select(
        "vec_id", "label", F.when(F.col("psnr") < float("inf"), F.round("psnr", 6)).alias("psnr"), "same_size",
        F.round("hist_l1", 6).alias("hist_l1"), "verified")


@query
def verify_manifest(spark, d):
    return _verified(spark, d)


@query
def settle(spark, d):
    return _settled(spark, d).select("event_id", "pass", "media_path", "status", "new_path", "new_bytes")


@query
def settle_flushed(spark, d):
    """As settled, but only replacements that the media folders hold count."""
    return (C.flushed(_settled(spark, d), V.media(spark, d))
            .select("event_id", "pass", "media_path", "status", "new_path", "new_bytes"))


@query
def repoint(spark, d):
    return C.repoint(V.stored_events(spark, d), _settled(spark, d)).select("event_id", "media_path", "media_bytes")


@query
def reconcile(spark, d):
    return C.reconcile(V.stored_events(spark, d), V.media(spark, d)).drop("device")


@query
def adopt(spark, d):
    rows = V.stored_events(spark, d)
    return C.adopt(rows, C.reconcile(rows, V.media(spark, d))).select("event_id", "media_path", "media_bytes")


@query
def reconcile_report(spark, d):
    return C.reconcile_report(C.reconcile(V.stored_events(spark, d), V.media(spark, d)))


@query
def compress_report(spark, d):
    return C.compress_report(_settled(spark, d))


@query
def savings(spark, d):
    return C.savings(_settled(spark, d))


@query
def rebase_paths(spark, d):
    return C.rebase_paths(V.stored_events(spark, d), "/data", "/copy/of data").select("event_id", "media_path")


# Streaming. Each run reads the table as a file stream and ends by itself.

def _stream(spark, d, name: str) -> DataFrame:
    """The table's files, whether it is one file or a folder of them: a stream takes a file by a pattern only."""
    shape = V.table(spark, d, name).schema
    return spark.readStream.schema(shape).parquet(os.path.join(d, f"{{{name}.parquet}}"))


def _event_stream(spark, d) -> DataFrame:
    return V.as_events(_stream(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _result(spark, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    folder = shared_dir(spark, name)
    live.run_to_folder(stream, folder, mode)
    return spark.read.schema(stream.schema).parquet(folder)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def levels_batch(spark, d):
    return live.levels(V.envelopes(spark, d), "1 hour")


@query
def stream_levels(spark, d):
    rows = V.as_envelopes(_stream(spark, d, "embeddings")).withColumn("chunk_ts", F.col("chunk_ts").cast("timestamp"))
    return _ntz(_result(spark, live.levels(rows, "1 hour", "1 hour"), "levels", "complete"), "window_start")


@query
def stream_displays(spark, d):
    return _ntz(_result(spark, live.live_displays(_event_stream(spark, d), "1 day"), "displays", "complete"),
                "window_start")


@query
def stream_sessions(spark, d):
    return _ntz(_result(spark, live.live_sessions(_event_stream(spark, d)), "sessions"),
                "session_start", "session_until")


@query
def stream_activity_late(spark, d):
    """The event table a stream builds whose files come in reverse order."""
    rows = V.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else
                         F.lit(None).cast(f.dataType).alias(f.name) for f in schema.ACTIVITY.fields))
    folder = shared_dir(spark, "late")
    for part in range(3, -1, -1):  # the newest quarter lands first, and each lands in a batch of its own
        rows.filter(F.floor(F.col("event_id") * 4 / (rows.agg(F.max("event_id") + 1).scalar())) == part).write.mode(
            "append").parquet(folder + "/landing")
        running = SI.stream_activity(SI.landing_stream(spark, folder + "/landing"), folder + "/table", folder + "/ck")
        try:
            if not running.awaitTermination(600):
                raise TimeoutError("stream did not finish")
        finally:
            running.stop()
    return _ntz(tables.read_activity(spark, folder + "/table").select("event_id", "device", "ts", "app"), "ts")


@query
def prune_stale_plan(spark, d):
    """What stays when events arrive after a prune was planned: the planned
    ones go, and their days' newer events stay."""
    rows = V.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else
                         F.lit(None).cast(f.dataType).alias(f.name) for f in schema.ACTIVITY.fields))
    folder = shared_dir(spark, "stale")
    table = folder + "/activity"
    tables.write_activity(rows.filter("event_id % 2 = 0"), table)
    plan = R.plan_prune(tables.read_activity(spark, table), all=True, confirm=True, dry_run=False)
    plan.write.parquet(folder + "/plan")
    tables.write_activity(rows.filter("event_id % 2 = 1"), table)
    maintain.apply_prune(spark, table, spark.read.parquet(folder + "/plan").withColumn("media_path", F.lit(None).cast("string")))
    return _ntz(tables.read_activity(spark, table).select("event_id", "device", "ts", "app"), "ts")


@query
def stream_once_each(spark, d):
    """Every event arrives twice and leaves once."""
    rows = _event_stream(spark, d)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _ntz(_result(spark, SI.once_each(twice).select("event_id", "device", "ts", "app"), "once"), "ts")


@query
def stream_index(spark, d):
    """The index a document stream builds, read back."""
    rows = (_stream(spark, d, "documents")
            .select(F.col("doc_id").alias("event_id"), F.col("source").alias("device"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp")
                     + F.make_dt_interval(secs=F.col("doc_id"))).alias("ts"), "text"))
    folder = shared_dir(spark, "index")
    running = SI.stream_index(rows, folder, folder + "-checkpoint", buckets=16)
    try:
        running.awaitTermination()  # it ends by itself, later the more documents there are
    finally:
        running.stop()
    return SI.stream_postings(spark, folder).select("term", "event_id", "tf", "dl")


@query
def stream_track_health(spark, d):
    """Every silence of over a day of a device's audio track."""
    rows = _event_stream(spark, d).filter(F.col("kind") == "audio")
    return _ntz(_result(spark, live.track_health(rows, 24 * 3600, "1 hour"), "health"), "last_ts", "no_signal_at")
