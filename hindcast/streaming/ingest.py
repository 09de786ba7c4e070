"""Continuous ingest, duplicate-free, with late rows accounted for."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from hindcast import schema
from hindcast.functions.text import term_count
from hindcast.operators.index import BUCKETS, build_postings
from hindcast.operators.ingest import KEY, clean_text, clean_titles
from hindcast.sources.commit import publish, recover, stage
from hindcast.sources.maintain import upsert_events
from hindcast.sources.tables import laid_out, write_activity

# How far rows may trail the newest event time where a stream keeps state.
DELAY = "2 days"


def landing_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Rows of a landing folder. The file source reads in order of modification time."""
    reader = spark.readStream.schema(schema.ACTIVITY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def cleaned(stream: DataFrame) -> DataFrame:
    return clean_text(clean_titles(stream))


def once_each(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each (device, event_id) once among rows no further apart than the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEY)


@contextmanager
def _kept(batch: DataFrame):
    """A micro-batch used more than once: without this its stateful plan would
    run, and count its late rows, once per use."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def stream_activity(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to the event table, every event once, however late.

    Each micro-batch is an anti-join append on (device, event_id), so a repeated
    one adds nothing and no watermark is needed: no row is too late.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            spark.read.schema(schema.ACTIVITY).parquet(table)
        except Exception as error:  # the very first batch: no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            write_activity(batch.dropDuplicates(KEY), table)
            return
        with _kept(batch):
            upsert_events(spark, table, batch)

    return (cleaned(stream).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def repair_late(spark: SparkSession, landing: str, table: str) -> None:
    """Put back what a table lacks of a landing folder, such as rows that an
    earlier stream took for too late. Running it again adds nothing."""
    rows = cleaned(spark.read.schema(schema.ACTIVITY).parquet(landing))
    upsert_events(spark, table, rows.dropDuplicates(KEY))


def stream_index(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Index the events that the index lacks, however late they come.

    A micro-batch writes the folders of its own name: first the postings, then
    the events it indexed with their lengths. A repeated one overwrites both; an
    event another batch has indexed is passed over.
    """
    def index(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        rows = batch.dropDuplicates(KEY)
        done = _events(spark, path)
        if done is not None:
            rows = rows.join(done.filter(F.col("batch") != name).select(*KEY), KEY, "left_anti")
        with _kept(rows):
            _write(laid_out(build_postings(rows, buckets), "bucket", "term", "event_id"), f"{path}/postings", name)
            _write(rows.select(*KEY, term_count("text").cast("long").alias("dl")), f"{path}/events", name)

    return (stream.writeStream.foreachBatch(index)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _write(df: DataFrame, folder: str, name: str) -> None:
    """One batch's share of a table; ``bucket`` stays a column, as files are sorted by it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/batch={name}")


def _events(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("event_id long, device string, dl long, batch string").parquet(f"{path}/events")
    except Exception as error:  # nothing indexed yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def prune_index(spark: SparkSession, path: str, plan: DataFrame) -> None:
    """Take a prune's events out of a streamed index; batches go on afterwards."""
    for table, order in (("events", list(KEY)), ("postings", ["bucket", "term", "event_id"])):
        folder = f"{path}/{table}"
        recover(spark, folder)
        rows = spark.read.parquet(folder)
        keys = [k for k in KEY if k in rows.columns]
        kept = rows.join(plan.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
        publish(spark, folder, stage(kept, folder, "batch", order), whole=True)


def stream_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings").drop("batch")


def stream_stats(spark: SparkSession, path: str) -> DataFrame:
    """Corpus statistics of the streamed index, from its narrow table of events."""
    return (_events(spark, path).filter("dl > 0")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl")))


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped, from the progress the query still remembers."""
    return sum(int(op["numRowsDroppedByWatermark"])
               for progress in query.recentProgress for op in progress["stateOperators"])


class LateRows(StreamingQueryListener):
    """Adds up dropped rows per query for as long as the session runs."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        lost = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + lost

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
