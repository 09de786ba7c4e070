"""Text index (``postings``) and relevance ranking.

The index is partitioned by ``bucket``, a hash of the term, so a query reads
only its own terms' buckets. A term held by a third of all events makes its
bucket large, not a task: the write is rebalanced and every later aggregation
is keyed by event.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hindcast.functions.text import search_terms, term_count, term_uses

BUCKETS = 256
SHARES = 16  # of a day's buckets, each one row of an event in a shuffle
K1, B = 1.2, 0.75
SCORE_DIGITS = 6


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def buckets_of(terms: list[str], buckets: int = BUCKETS) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % buckets for t in terms})


def event_key(df: DataFrame) -> list[str]:
    """What names an event: an id is a device's own, where rows say the device."""
    return [c for c in ("device", "event_id") if c in df.columns]


def build_postings(activity: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(term, event_id, tf, dl, bucket), and device and day where the events have
    them; one row per event and distinct term.

    The text is spread by event first: the count per (event, term) then needs
    no second shuffle, and a shuffle of text is smaller than one of terms.
    """
    own = event_key(activity) + [c for c in ("day",) if c in activity.columns]
    terms = (activity.filter(F.length("text") > 0).select(*own, "text").repartition(*event_key(activity))
             .select(*own, search_terms("text").alias("terms")))
    return (terms.select(*own, F.size("terms").cast("long").alias("dl"),
                         F.explode("terms").alias("term"))
            .groupBy(*own, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
            .select("term", *own, "tf", "dl", term_bucket(F.col("term"), buckets).alias("bucket")))


def day_postings(activity: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of :func:`build_postings` with ``day``, dealt out by day and share of the buckets and sorted by day,
    bucket and term, in one shuffle that moves every text's terms once and no single posting.

    A row of that shuffle holds the terms of one share as one string, parted by blanks, which no term has. Rows that
    repeat an event meet there; uses are counted behind it.
    """
    key = event_key(activity)
    own, shares = [*key, "day"], min(buckets, SHARES)
    words = (activity.filter(F.length("text") > 0).select(*own, search_terms("text").alias("terms"))
             .select(*own, F.size("terms").cast("long").alias("dl"), F.sort_array(F.transform("terms", lambda t: F.struct(
                 (term_bucket(t, buckets) % shares).alias("share"), t.alias("term")))).alias("words")).filter("dl > 0"))
    words = words.withColumn("starts", _starts("words", lambda w: w["share"]))
    packed = (words.select(*own, "dl", F.explode(_runs("words", lambda p, n: F.struct(
        F.get("words", p - 1)["share"].alias("share"), F.concat_ws(" ", F.slice("words", p, n)["term"]).alias("terms"))))
        .alias("of")).select(*own, "dl", "of.*"))
    met = (packed.repartition("day", "share").groupBy("share", *own, "dl")
           .agg(F.concat_ws(" ", F.collect_list("terms")).alias("terms"))
           .select(*own, "dl", F.sort_array(F.split("terms", " ")).alias("terms"))
           .withColumn("starts", _starts("terms", lambda t: t)))
    each = met.select(*own, "dl", F.explode(_runs("terms", lambda p, n: F.struct(
        F.get("terms", p - 1).alias("term"), n.cast("long").alias("tf")))).alias("of"))
    return (each.select("of.term", *own, "of.tf", "dl", term_bucket(F.col("of.term"), buckets).alias("bucket"))
            .sortWithinPartitions("day", "bucket", "term", *key))


def _starts(column: str, part) -> Column:
    """The places, from 1, at which ``part`` of a sorted array's elements changes."""
    return F.filter(F.sequence(F.lit(1), F.size(column)), lambda i: (i == 1) | (
        part(F.get(column, i - 1)) != part(F.get(column, i - 2))))


def _runs(column: str, make) -> Column:
    """What ``make`` says of each run of a sorted array, given its place and length; ``starts`` are the places."""
    behind = F.size(column) + 1
    return F.transform("starts", lambda p, j: make(p, F.coalesce(F.get("starts", j + 1), behind) - p))


def corpus_stats(activity: DataFrame) -> DataFrame:
    """One row: events with text and their total length in terms."""
    return (activity.select(term_count("text").cast("long").alias("dl")).filter(F.col("dl") > 0)
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl")))


def stats_from_postings(postings: DataFrame) -> DataFrame:
    """The same row from the index: each event's tf values add up to its dl."""
    return postings.agg(F.coalesce(F.sum(F.col("tf") / F.col("dl")), F.lit(0.0)).alias("d"),
                        F.coalesce(F.sum("tf"), F.lit(0)).alias("total_dl")) \
        .select(F.round("d").cast("long").alias("n_docs"), "total_dl")


def update_postings(postings: DataFrame, added: DataFrame | None = None,
                    removed: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Index after removing events and indexing new ones; equals a full rebuild.

    Re-added events replace their old entries.
    """
    key = event_key(postings)
    gone = [d.select(*key) for d in (removed, added) if d is not None]
    if gone:
        ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        postings = postings.join(ids, key, "left_anti").select(*postings.columns)
    if added is not None:
        postings = postings.unionByName(build_postings(added, buckets))
    return postings


def hits(postings: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Postings of the query terms; both predicates reach the scan."""
    return postings.filter(F.col("bucket").isin(buckets_of(terms, buckets)) & F.col("term").isin(terms))


def matching_events(postings: DataFrame, terms: list[str], match: str = "all",
                    buckets: int = BUCKETS) -> DataFrame:
    found = hits(postings, terms, buckets).groupBy(*event_key(postings)).agg(F.count(F.lit(1)).alias("matched"))
    return _enough(found, terms, match)


def _enough(found: DataFrame, terms: list[str], match: str) -> DataFrame:
    if match not in ("all", "any"):
        raise ValueError("match is 'all' or 'any'")
    return found.filter(F.col("matched") == len(terms)) if match == "all" else found


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def rank(postings: DataFrame, terms: list[str], stats: DataFrame, match: str = "any",
         buckets: int = BUCKETS) -> DataFrame:
    """(event's key, matched, score): BM25 with statistics of the whole index.

    Document frequencies are one row per query term, so that side of the join
    is bounded by the argument list and broadcast.
    """
    found = hits(postings, terms, buckets)
    corpus = stats.select(F.struct(F.col("n_docs").cast("double").alias("n"),
                                   F.col("total_dl").cast("double").alias("total")).alias("s")).scalar()
    n_docs, total = corpus["n"], corpus["total"]
    weights = (found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
               .select("term", idf(n_docs, F.col("df")).alias("idf")))
    scored = (found.join(F.broadcast(weights), "term")
              .groupBy(*event_key(postings))
              .agg(F.count(F.lit(1)).alias("matched"),
                   F.round(F.sum(F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), total / n_docs)),
                           SCORE_DIGITS).alias("score")))
    return _enough(scored, terms, match)


def rank_by_scan(activity: DataFrame, candidates: DataFrame, terms: list[str],
                 match: str = "any") -> DataFrame:
    """``candidates`` with ``score``, without an index.

    One aggregate pass over the text for the statistics, one narrow pass over
    the candidates; terms are counted where they stand, nothing is exploded or
    shuffled.
    """
    counts = F.array(*[term_uses("text", t).cast("long") for t in terms])
    seen = activity.select(term_count("text").alias("dl"), counts.alias("tf")).filter(F.col("dl") > 0)
    stats = seen.agg(
        F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("dl").alias("avg_dl"),
        *[F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    stats = stats.select(F.struct("avg_dl", F.array(
        *[idf(F.col("n_docs"), F.col(f"df{i}")) for i in range(len(terms))]).alias("idf")).alias("s")).scalar()

    matched = F.size(F.filter("tf", lambda x: x > 0))
    enough = matched == len(terms) if match == "all" else matched > 0
    score = sum((stats["idf"][i] * F.when(F.col("tf")[i] > 0, tf_norm(
        F.col("tf")[i], F.col("dl"), stats["avg_dl"])).otherwise(0.0)
        for i in range(len(terms))), F.lit(0.0))
    return (candidates.filter(_holds(terms, match))
            .withColumn("tf", counts).filter(enough)
            .withColumn("dl", term_count("text"))
            .withColumn("score", F.round(score, SCORE_DIGITS))
            .drop("tf", "dl"))


def _holds(terms: list[str], match: str) -> Column:
    """Cheap substring test that every match passes."""
    if match not in ("all", "any"):
        raise ValueError("match is 'all' or 'any'")
    tests = [F.contains(F.lower("text"), F.lit(t)) for t in terms]
    return reduce(Column.__and__ if match == "all" else Column.__or__, tests)
