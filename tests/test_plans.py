"""The physical plans the operators are meant to have."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hindcast.operators import index, retention as R
from hindcast.operators.filters import filter_events
from hindcast.plans import views as V
from hindcast.plans.queries import QUERIES
from hindcast.sources.tables import (media_inventory, read_activity, read_postings, write_activity,
                                     write_postings)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "activity")
    rows = V.activity(spark, SMALL).withColumns({
        "ts": F.col("ts").cast("timestamp"), "text_len": F.length("text"),
        "meta": F.lit(None).cast("map<string,string>")})
    write_activity(rows, path)
    return path


@pytest.mark.parametrize("name", ["bleed_coverage", "turns_all", "search_fold", "app_time", "reconcile", "compress_plan"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_time_filters_reach_partitions_and_parquet(spark, stored):
    text = plan(filter_events(read_activity(spark, stored), since="2024-01-10T06:00:00Z", until="2024-01-12T00:00:00Z"))
    assert "GreaterThanOrEqual(ts" in text and "PartitionFilters: [isnotnull(day" in text


def test_listing_reads_no_text(spark, stored):
    text = plan(read_activity(spark, stored).groupBy("app").count())
    assert "ReadSchema: struct<app:string>" in text


def test_a_search_reads_only_its_buckets(spark, folder):
    write_postings(index.build_postings(V.docs(spark, SMALL), 16), folder + "/p")
    text = plan(index.hits(read_postings(spark, folder + "/p"), ["besten"], 16))
    assert "PartitionFilters: [bucket" in text.replace("isnotnull(bucket", "bucket") and "term" in text


def test_media_inventory_reads_no_content(spark, folder):
    for d in ("screenshots", "audio"):
        os.makedirs(f"{folder}/{d}")
        with open(f"{folder}/{d}/1.bin", "wb") as f:
            f.write(b"abc")
    found = media_inventory(spark, folder)
    text = plan(found)
    assert "content" not in text.split("ReadSchema")[-1]
    assert sorted((r["path"], r["length"]) for r in found.collect()) == [
        (f"{folder}/audio/1.bin", 3), (f"{folder}/screenshots/1.bin", 3)]


def test_the_size_cut_orders_no_whole_table(spark):
    text = plan(R.by_size(V.events(spark, SMALL), 10_000_000))
    assert "SinglePartition" not in text


@pytest.mark.parametrize("cap", [0, 999, 10_000_000, 1 << 60])
def test_size_cap_keeps_the_longest_newest_run(spark, cap):
    rows = sorted(V.events(spark, SMALL).select("ts", "event_id", "media_bytes").collect(), reverse=True)
    gone = {r["event_id"] for r in R.plan_prune(V.events(spark, SMALL), max_bytes=cap).collect()}
    total, kept = 0, []
    for r in rows:
        if total + r["media_bytes"] > cap:
            break
        total += r["media_bytes"]
        kept.append(r["event_id"])
    assert gone == {r["event_id"] for r in rows} - set(kept)


def test_combined_is_size_after_age(spark):
    from datetime import datetime
    rows, now = V.events(spark, SMALL), datetime(2024, 1, 31)
    both = {r["event_id"] for r in R.plan_prune(rows, older="480h", max_bytes=9_000_000, now=now).collect()}
    aged = R.plan_prune(rows, older="480h", now=now)
    rest = R.survivors(rows, aged)
    assert both == ({r["event_id"] for r in aged.collect()}
                    | {r["event_id"] for r in R.by_size(rest, 9_000_000).collect()})


def test_removing_everything_needs_consent(spark):
    with pytest.raises(PermissionError):
        R.plan_prune(V.events(spark, SMALL), all=True, dry_run=False)
