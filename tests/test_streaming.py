"""Streams against batch, with file times set on purpose."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hindcast.operators.index import build_postings, corpus_stats
from hindcast.plans import queries as Q, views as V
from hindcast.sources.tables import read_activity, write_activity
from hindcast.streaming import ingest as SI, live


def landing(spark, folder, order):
    """Four files in event order, with modification times that follow ``order``."""
    rows = V.activity(spark, SMALL).withColumns({
        "ts": F.col("ts").cast("timestamp"), "text_len": F.length("text"),
        "meta": F.lit(None).cast("map<string,string>")})
    path = f"{folder}/landing"
    os.makedirs(path)
    for part in range(4):
        rows.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.parquet(f"{folder}/part-{part}")
        name = next(n for n in os.listdir(f"{folder}/part-{part}") if n.endswith(".parquet"))
        os.link(f"{folder}/part-{part}/{name}", f"{path}/{part}.parquet")
    for place, part in enumerate(order):
        os.utime(f"{path}/{part}.parquet", (1_700_000_000 + place * 60,) * 2)
    return path


def finish(query):
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return query


def test_ingest_in_order_and_replayed(spark, folder):
    path = landing(spark, folder, [0, 1, 2, 3])
    table = folder + "/activity"
    finish(SI.stream_activity(SI.landing_stream(spark, path, 1), table, folder + "/ck"))
    assert read_activity(spark, table).count() == 1000
    # a second run without the first one's checkpoint replays every file
    finish(SI.stream_activity(SI.landing_stream(spark, path, 1), table, folder + "/ck2"))
    assert read_activity(spark, table).count() == 1000


def test_late_files_lose_nothing(spark, folder):
    path = landing(spark, folder, [3, 2, 1, 0])
    query = finish(SI.stream_activity(SI.landing_stream(spark, path, 1), folder + "/activity", folder + "/ck"))
    assert SI.late_rows(query) == 0
    assert read_activity(spark, folder + "/activity").count() == 1000


def test_rows_a_table_lacks_are_put_back(spark, folder):
    path = landing(spark, folder, [0, 1, 2, 3])
    table = folder + "/activity"
    write_activity(SI.cleaned(spark.read.parquet(path)).filter("event_id % 3 <> 0"), table)
    for _ in range(2):
        SI.repair_late(spark, path, table)
        assert read_activity(spark, table).count() == 1000


def same(got, want):
    got = got.select(*want.columns)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_streamed_index_equals_a_rebuild(spark, folder):
    path = landing(spark, folder, [3, 0, 2, 1])
    finish(SI.stream_index(SI.landing_stream(spark, path, 2), folder + "/index", folder + "/ck", buckets=4))
    assert same(SI.stream_postings(spark, folder + "/index"), build_postings(V.activity(spark, SMALL), 4))
    assert SI.stream_stats(spark, folder + "/index").first() == corpus_stats(V.activity(spark, SMALL)).first()


def test_streamed_index_goes_on_after_a_prune(spark, folder):
    path = landing(spark, folder, [0, 1, 2, 3])
    index, rows = folder + "/index", V.activity(spark, SMALL)
    os.makedirs(folder + "/first")
    for part in (0, 1):
        os.link(f"{path}/{part}.parquet", f"{folder}/first/{part}.parquet")
    finish(SI.stream_index(SI.landing_stream(spark, folder + "/first"), index, folder + "/ck", buckets=4))
    SI.prune_index(spark, index, rows.filter("event_id < 300"))
    left = rows.filter("event_id >= 300 and event_id < 500")
    assert same(SI.stream_postings(spark, index), build_postings(left, 4))
    for part in (2, 3):
        os.link(f"{path}/{part}.parquet", f"{folder}/first/{part}.parquet")
    finish(SI.stream_index(SI.landing_stream(spark, folder + "/first"), index, folder + "/ck", buckets=4))
    left = rows.filter("event_id >= 300")
    assert same(SI.stream_postings(spark, index), build_postings(left, 4))
    assert SI.stream_stats(spark, index).first() == corpus_stats(left).first()


@pytest.mark.parametrize("files", [1, 4])
def test_a_silence_inside_a_batch_is_reported(spark, folder, files):
    start = datetime(2024, 1, 1)
    beats = [("a", "mic", start + timedelta(seconds=s)) for s in [*range(0, 300, 10), *range(2000, 4000, 10)]]
    shape = "device string, track string, ts timestamp"
    spark.createDataFrame(beats, shape).repartitionByRange(files, "ts").write.parquet(folder + "/in")
    for place, name in enumerate(sorted(n for n in os.listdir(folder + "/in") if n.startswith("part-"))):
        os.utime(f"{folder}/in/{name}", (1_700_000_000 + place * 60,) * 2)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    live.run_to_folder(live.track_health(stream, 60, "1 hour"), folder + "/out", timeout_s=120)
    assert [(r["last_ts"], r["no_signal_at"]) for r in spark.read.parquet(folder + "/out").collect()] == [
        (start + timedelta(seconds=290), start + timedelta(seconds=350))]


def test_only_the_silent_track_is_reported(spark, folder):
    start = datetime(2024, 1, 1)
    steady = [("a", "mic", start + timedelta(seconds=s)) for s in range(0, 600, 10)]
    broken = [("a", "system", start + timedelta(seconds=s)) for s in range(0, 120, 10)]
    shape = "device string, track string, ts timestamp"
    spark.createDataFrame(steady + broken, shape).coalesce(1).write.parquet(folder + "/in")
    expected = spark.createDataFrame([("b", "mic", start)], shape)
    expected.coalesce(1).write.parquet(folder + "/expected")
    stream = spark.readStream.schema(shape).parquet(folder + "/in")
    first = spark.readStream.schema(shape).parquet(folder + "/expected")
    health = live.track_health(stream, 60, "10 seconds", first)
    live.run_to_folder(health, folder + "/out", timeout_s=120)
    found = {(r["device"], r["track"]): r for r in spark.read.parquet(folder + "/out").collect()}
    assert set(found) == {("a", "system"), ("b", "mic")}
    assert found["a", "system"]["no_signal_at"] == start + timedelta(seconds=110 + 60)


def test_late_quarters_land_from_all_tasks(spark, folder, monkeypatch):
    """Each quarter is written by as many tasks as its rows have, and is one micro-batch of all its files."""
    import glob
    from collections import Counter

    from hindcast.plans import queries

    split, batches = V.events, []
    whole = sorted(tuple(r) for r in queries.QUERIES["stream_activity_late"](spark, SMALL).collect())
    monkeypatch.setattr(V, "events", lambda s, d: split(s, d).repartition(4))
    monkeypatch.setattr(queries, "shared_dir", lambda s, purpose: folder)
    stream = queries.SI.stream_activity
    monkeypatch.setattr(queries.SI, "stream_activity", lambda *a: batches.append(stream(*a)) or batches[-1])
    got = sorted(tuple(r) for r in queries.QUERIES["stream_activity_late"](spark, SMALL).collect())
    assert got == whole
    files = [f.rsplit("part-", 1)[1][6:42] for f in glob.glob(folder + "/landing/part-*.parquet")]
    assert len(files) > 4 and len(set(files)) == 4
    assert all(sum(p["numInputRows"] > 0 for p in q.recentProgress) == 1 for q in batches)
    assert max(Counter(files).values()) > 1


@pytest.mark.parametrize("name,batch,table", [
    ("stream_index", "postings_build", "documents"), ("stream_levels", "levels_batch", "embeddings"),
    ("stream_once_each", "event_scan", "events")])
def test_a_stream_reads_a_table_of_one_file_or_of_many(spark, folder, name, batch, table):
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").limit(40)
    rows.repartition(3).write.parquet(f"{folder}/many/{table}.parquet")
    rows.coalesce(1).write.parquet(f"{folder}/part")
    os.makedirs(f"{folder}/one")
    file = next(n for n in os.listdir(f"{folder}/part") if n.endswith(".parquet"))
    os.link(f"{folder}/part/{file}", f"{folder}/one/{table}.parquet")
    many, one = (Q.QUERIES[name](spark, f"{folder}/{x}") for x in ("many", "one"))
    assert many.count() > 0
    assert same(many, one)
    if table != "events":
        assert same(many, Q.QUERIES[batch](spark, f"{folder}/many"))
