"""Stored tables: append, compaction, prune, replacement, repair, backfill, crashes."""

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hindcast.operators import density as C, index, retention as R
from hindcast.plans import views as V
from hindcast.schema import SCHEMA_VERSION, TURNS
from hindcast.sources import commit, maintain as M
from hindcast.sources.tables import (media_inventory, read_activity, read_postings, read_turns,
                                     table_version, write_activity, write_postings, write_report)


@pytest.fixture
def store(spark, folder):
    """A small table and its media files: the first 200 events."""
    root, table = f"{folder}/data", f"{folder}/activity"
    rows = (V.activity(spark, SMALL).filter("event_id < 200").withColumns({
        "ts": F.col("ts").cast("timestamp"), "text_len": F.length("text"),
        "media_path": F.concat(F.lit(folder), "media_path"),
        "media_bytes": F.lit(10).cast("long"), "meta": F.lit(None).cast("map<string,string>")}))
    write_activity(rows, table)
    for r in read_activity(spark, table).select("media_path").collect():
        os.makedirs(os.path.dirname(r["media_path"]), exist_ok=True)
        with open(r["media_path"], "wb") as f:
            f.write(b"0123456789")
    return root, table


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def loose(spark, root, table):
    media, rows = media_inventory(spark, root), read_activity(spark, table)
    return R.orphans(media, rows).count(), R.dangling(rows, media).count()


def test_version_is_stamped(spark, store):
    assert table_version(spark, store[1]) == SCHEMA_VERSION


def test_append_twice_adds_nothing(spark, store):
    _, table = store
    before = ids(read_activity(spark, table))
    batch = read_activity(spark, table)
    M.upsert_events(spark, table, batch.unionByName(batch))
    assert ids(read_activity(spark, table)) == before


def test_compaction_keeps_rows_and_merges_files(spark, store):
    _, table = store
    extra = read_activity(spark, table).withColumn("event_id", F.col("event_id") + 1000)
    M.upsert_events(spark, table, extra)
    before, files = read_activity(spark, table).collect(), len(glob.glob(table + "/day=*/*.parquet"))
    M.compact(spark, table, date(2024, 1, 1), date(2024, 1, 31))
    after = read_activity(spark, table).collect()
    assert sorted(map(str, before)) == sorted(map(str, after))
    assert len(glob.glob(table + "/day=*/*.parquet")) < files


def test_prune_removes_rows_then_files(spark, store, folder):
    root, table = store
    postings = folder + "/postings"
    write_postings(index.build_postings(read_activity(spark, table), 16), postings)
    plan = R.plan_prune(read_activity(spark, table), max_bytes=1000)
    doomed = ids(plan)
    plan = M.apply_prune(spark, table, plan, postings_path=postings)
    assert len(doomed) == 100 and not set(doomed) & set(ids(read_activity(spark, table)))
    assert loose(spark, root, table) == (0, 0)
    rebuilt = index.build_postings(read_activity(spark, table), 16)
    kept = read_postings(spark, postings).select(*rebuilt.columns)
    assert kept.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(kept).isEmpty()


def test_a_prune_that_dies_leaves_orphans_not_dangling_rows(spark, store):
    root, table = store
    M.apply_prune(spark, table, R.plan_prune(read_activity(spark, table), max_bytes=1000), fail_after="rows")
    assert loose(spark, root, table) == (100, 0)
    everything = R.plan_prune(read_activity(spark, table), all=True, confirm=True, dry_run=False)
    M.apply_prune(spark, table, everything, sweep=media_inventory(spark, root))
    assert media_inventory(spark, root).count() == 0


def test_a_stale_plan_takes_only_what_it_names(spark, store):
    root, table = store
    rows = read_activity(spark, table)
    first = rows.filter("event_id < 10")
    plan = M._stored(spark, R.plan_prune(first, all=True, confirm=True, dry_run=False), "stale")
    M.apply_prune(spark, table, plan)
    assert ids(read_activity(spark, table)) == list(range(10, 200))


def test_a_sweep_needs_a_removal_of_everything(spark, store):
    root, table = store
    with pytest.raises(PermissionError):
        M.apply_prune(spark, table, R.plan_prune(read_activity(spark, table), max_bytes=1000),
                      sweep=media_inventory(spark, root))


def test_a_publish_that_dies_is_rolled_forward(spark, store):
    _, table = store
    rows = read_activity(spark, table)
    staged = commit.stage(rows.filter("event_id % 2 = 0"), table, "day", ["ts"])
    files = commit._Files(spark, table)
    days = [n for n in files.names(staged + "/new") if n.startswith("day=")]
    files.write(f"{staged}/{commit.MARK}", days)
    files.rename(f"{table}/{days[0]}", f"{staged}/old/{days[0]}")  # died between the two renames
    assert commit.recover(spark, table) == 1
    left = ids(read_activity(spark, table))
    assert left == [i for i in range(200) if i % 2 == 0]
    assert commit.recover(spark, table) == 0


def manifest(spark, rows, folder):
    """Every file replaced well, but for the ones of ids divisible by 9."""
    sample = F.array(*[F.lit(i) for i in range(48)])
    bad = F.array(*[F.lit(255 - 5 * i) for i in range(48)])
    return rows.filter("event_id % 5 <> 1").select(
        F.col("media_path").alias("old_path"), C.target_path(F.col("media_path")).alias("new_path"),
        F.lit(4).cast("long").alias("new_bytes"),
        F.when(F.col("kind") == "screen", "screens").otherwise("audio").alias("medium"),
        sample.alias("src_sample"), F.when(F.col("event_id") % 9 == 0, bad).otherwise(sample).alias("dst_sample"),
        *[F.lit(4).alias(c) for c in ("src_width", "src_height", "dst_width", "dst_height")],
        F.lit(3).alias("channels"))


def write_new(spark, m):
    for r in m.select("new_path").collect():
        with open(r["new_path"], "wb") as f:
            f.write(b"0123")


def settled(spark, root, table, m):
    rows = read_activity(spark, table)
    plan = C.plan_compress(rows, media_inventory(spark, root), older_than="2024-02-01T00:00:00Z")
    return C.settle(plan, rows, C.verify(m))


def test_replacements_repoint_before_originals_go(spark, store, folder):
    root, table = store
    rows = read_activity(spark, table)
    m = spark.createDataFrame(manifest(spark, rows, folder).collect(), manifest(spark, rows, folder).schema)
    good = m.filter("src_sample = dst_sample")
    write_new(spark, good)
    done = settled(spark, root, table, m)
    counts = {r["pass"]: r for r in C.compress_report(done).collect()}
    n_good = good.count()
    assert sum(r["files"] for r in counts.values()) == n_good
    assert sum(r["verify_failed"] for r in counts.values()) == m.count() - n_good
    M.apply_replacements(spark, table, done, root, fail_after="rows")
    # died before the originals went: two copies, no dangling row
    assert loose(spark, root, table) == (n_good, 0)
    repairs = M.apply_reconcile(spark, table, root)
    assert repairs.filter("action = 'remove'").count() == n_good
    assert loose(spark, root, table) == (0, 0)
    assert read_activity(spark, table).count() == 200


def test_a_surviving_file_is_adopted(spark, store):
    root, table = store
    gone = read_activity(spark, table).orderBy("event_id").filter("kind = 'screen'").first()["media_path"]
    os.rename(gone, gone.replace(".jpg", ".heic"))
    assert loose(spark, root, table) == (1, 1)
    M.apply_reconcile(spark, table, root)
    assert loose(spark, root, table) == (0, 0)


def test_media_outside_the_root_stops_the_run(spark, store):
    root, table = store
    with pytest.raises(C.OutsideRoot, match="200 events"):
        C.guard_root(read_activity(spark, table), root + "/elsewhere")
    C.guard_root(read_activity(spark, table), root)


def test_checks_reject_single_edits_and_channel_swaps(spark):
    base = list(range(0, 240, 5))
    edited = base[:-1] + [base[-1] ^ 1]
    swapped = [base[i - i % 3 + (2 - i % 3)] for i in range(48)]
    flat = [200, 10, 10] * 16
    rows = spark.createDataFrame(
        [("same", base, base), ("edit", base, edited), ("swap", flat, [10, 10, 200] * 16), ("short", base, swapped[:-3])],
        "name string, src_sample array<int>, dst_sample array<int>").withColumns(
        {c: F.lit(4) for c in ("src_width", "src_height", "dst_width", "dst_height")}).withColumn("channels", F.lit(3))
    audio = {r["name"]: r["verified"] for r in C.verify_audio(rows).collect()}
    images = {r["name"]: r["verified"] for r in C.verify_images(rows).collect()}
    assert audio == {"same": True, "edit": False, "swap": False, "short": False}
    assert images == {"same": True, "edit": True, "swap": False, "short": False}


def test_backfill_twice_is_the_same(spark, folder):
    segments, envelopes = V.segments(spark, SMALL), V.envelopes(spark, SMALL)
    table = folder + "/turns"
    M.backfill_turns(spark, segments, envelopes, table, date(2024, 1, 1), date(2024, 1, 3))
    once = sorted(map(str, read_turns(spark, table).collect()))
    M.backfill_turns(spark, segments, envelopes, table, date(2024, 1, 1), date(2024, 1, 2))
    assert sorted(map(str, read_turns(spark, table).collect())) == once and once
    assert read_turns(spark, table).schema.names == TURNS.names or set(read_turns(spark, table).columns) == set(TURNS.names)


def test_report_round_trip(spark, folder):
    report = R.prune_report(R.plan_prune(V.events(spark, SMALL), all=True))
    write_report(report, folder + "/report")
    back = spark.read.schema(report.schema).json(folder + "/report")
    assert back.collect() == report.collect()
