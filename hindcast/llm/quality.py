"""Quality of event texts by hierarchical empirical Bayes.

Two kinds of evidence meet. The text's own: how much likelier its features
(words, word beginnings, punctuation runs, style marks) are among rejected
than among accepted labelled events. And where it comes from: the share of
rejected events of its application, shrunk toward the share overall, and of
its window within the application, shrunk toward the application's. How
strongly sparse places are shrunk is estimated from how much the places
differ. The features' weights are fitted on a bounded sample of the labels,
the places on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from hindcast.llm.grams import ALNUM, LOWER, SEPARATOR, Slice, mix, prefix_hashes, slices, span_hashes, spans
from hindcast.llm.stored import Workspace

FIT_EVENTS = 50_000  # labelled events that the weights are fitted on
MODEL_FEATURES = 1 << 16
BEGINNING = 5  # bytes of a word's beginning
LEAST_SHARE, LEAST_EVENTS = 0.003, 4  # of rejected events that have a feature
LEAST_ODDS, LEAST_Z = 2.0, 3.5
STYLE_WORDS = 8

COUNTS = "feature long, rejected long, accepted long"
EVIDENCE = "event_id long, app string, window string, evidence double"


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text in the slice, feature) of every distinct feature."""
    n_texts = len(part.offsets) - 1
    data = LOWER[part.data]
    running = prefix_hashes(data)
    texts, found = [], []

    def add(starts: np.ndarray, ends: np.ndarray, tag: int) -> np.ndarray:
        texts.append(np.searchsorted(part.offsets, starts, side="right") - 1)
        found.append(mix(span_hashes(running, starts, ends) + np.uint64(tag)))
        return texts[-1]

    starts, ends = spans(ALNUM[data], part.offsets)
    of = add(starts, ends, 1)
    long_words = ends - starts > BEGINNING
    add(starts[long_words], starts[long_words] + BEGINNING, 2)
    add(*spans(~ALNUM[data] & ~SEPARATOR[data], part.offsets), 3)
    text, feature = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    first = np.concatenate(([True], (text[1:] != text[:-1]) | (feature[1:] != feature[:-1]))) if len(text) else order
    text, feature = text[first.astype(bool)], feature[first.astype(bool)]
    # Style: the share of words that repeat the word before them, and the share of capitals.
    words = np.bincount(of, minlength=n_texts)
    word = found[0]
    echo = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
    capital = np.flatnonzero((part.data >= 65) & (part.data <= 90))
    capitals = np.bincount(np.searchsorted(part.offsets, capital, side="right") - 1, minlength=n_texts)
    some = np.flatnonzero(words >= STYLE_WORDS)
    shares = (np.bincount(of[echo], minlength=n_texts)[some] / words[some], capitals[some] / np.diff(part.offsets)[some])
    style = [mix((10 * v).astype(np.uint64) + np.uint64(tag << 32)) for v, tag in zip(shares, (4, 5), strict=True)]
    return np.concatenate((text, some, some)), np.concatenate((feature, *style))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """How many rejected and accepted events have each feature, of ``labelled`` (text, rejected)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            prints, bad = [], []
            for part in slices(batch.column(0)):
                text, feature = features(part)
                prints.append(feature)
                bad.append(rejected[part.lo:part.hi][text])
            if not prints:
                continue
            found, at = np.unique(np.concatenate(prints), return_inverse=True)
            bad = np.concatenate(bad)
            n_bad = np.bincount(at, weights=bad, minlength=len(found)).astype(np.int64)
            n_all = np.bincount(at, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n_bad), pa.array(n_all - n_bad)],
                                             ["feature", "rejected", "accepted"])

    return (labelled.select("text", "rejected").mapInArrow(counted, COUNTS).groupBy("feature")
            .agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")))


def weights(counts: DataFrame, rejected: int, accepted: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and their log odds, of the clearest features that speak
    for rejection; accepted is what a text is without any of them."""
    odds = (F.log((F.col("rejected") + 0.5) / F.lit(rejected + 1.0))
            - F.log((F.col("accepted") + 2.0) / F.lit(accepted + 4.0)))
    z = odds / F.sqrt(1 / (F.col("rejected") + 0.5) + 1 / (F.col("accepted") + 2.0))
    least = max(LEAST_EVENTS, LEAST_SHARE * rejected)
    rows = (counts.filter(F.col("rejected") >= least).select("feature", odds.alias("odds"), z.alias("z"))
            .filter((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
            .orderBy(F.desc("z"), "feature").limit(MODEL_FEATURES).collect())
    known = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r["odds"] for r in rows], np.float64)[order]


def text_evidence(activity: DataFrame, known: np.ndarray, odds: np.ndarray) -> DataFrame:
    """(event_id, app, window, evidence): the summed log odds of each text's features."""
    model = activity.sparkSession.sparkContext.broadcast((known, odds))  # at most MODEL_FEATURES

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odds = model.value
        for batch in batches:
            evidence = np.zeros(len(batch))
            if len(known):
                for part in slices(batch.column(3)):
                    text, feature = features(part)
                    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
                    hit = known[at] == feature
                    np.add.at(evidence, part.lo + text[hit], odds[at[hit]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(evidence)],
                                             ["event_id", "app", "window", "evidence"])

    return (activity.select(F.col("event_id").cast("long").alias("event_id"), F.col("app").cast("string").alias("app"),
                            F.col("window").cast("string").alias("window"), "text").mapInArrow(scored, EVIDENCE))


def shrinkage(places: DataFrame, center: Column) -> float:
    """How many events the center is worth, by the method of moments: ``places``
    has ``n`` labelled and ``k`` rejected events each and the center's columns."""
    share = F.col("k") / F.col("n")
    noise = center * (1 - center) / F.col("n")
    row: Row = places.filter("n > 0").agg(
        F.sum(F.col("n") * ((share - center) * (share - center) - noise)).alias("between"),
        F.sum(F.col("n") * center * (1 - center)).alias("within")).first()
    if not row["within"] or row["between"] is None:
        return 1.0
    ratio = row["between"] / row["within"]
    return float(min(1e4, max(1.0, 1 / ratio - 1 if ratio > 0 else 1e4)))


def score_quality(activity: DataFrame, labels: DataFrame) -> DataFrame:
    """Whether each event is to be rejected, from its text and its place.

    ``activity`` needs ``event_id, app, window`` and ``text``; ``labels`` needs
    ``event_id`` and ``rejected`` (boolean); other columns are not read.
    Returns one row per input row: ``event_id, evidence`` (log odds of the
    text's features), ``prior`` (shrunk share of rejected events of its window
    and application), ``posterior`` and ``rejected`` (posterior over one half).
    The weights are fitted on the ``FIT_EVENTS`` labelled events whose ids hash
    lowest; everything else covers all rows. Null application and window are
    places like any other; null and empty texts have no evidence; labels that
    are null or have a null id do not count, repeated labels count each; places
    without labels have their parent's share. Without labels nothing is
    rejected. An empty table gives no rows.
    """
    spark: SparkSession = activity.sparkSession
    work = Workspace(spark, "quality")
    known = work.saved(labels.filter("event_id is not null and rejected is not null")
                       .select(F.col("event_id").cast("long").alias("event_id"), F.col("rejected").cast("boolean")
                               .alias("rejected")), "labels")
    sample = work.saved(known.orderBy(F.xxhash64("event_id"), "event_id").limit(FIT_EVENTS), "sample")
    labelled = activity.select(F.col("event_id").cast("long").alias("event_id"), "text").join(
        F.broadcast(sample), "event_id")  # at most FIT_EVENTS rows of 9 bytes
    sums = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rejected").cast("long")).alias("k")).first()
    k, n = sums["k"] or 0, sums["n"]
    counts = work.saved(feature_counts(labelled).filter(
        F.col("rejected") >= max(LEAST_EVENTS, LEAST_SHARE * k)), "counts")
    scored = work.saved(text_evidence(activity, *weights(counts, k, n - k)), "evidence")

    one = F.count(F.lit(1)).alias("n"), F.sum(F.col("rejected").cast("long")).alias("k")
    windows = work.saved(scored.select("event_id", "app", "window").join(known, "event_id")
                         .groupBy("app", "window").agg(*one), "windows")
    total = windows.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1) if total["n"] else 0.0
    apps = windows.groupBy("app").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    m = shrinkage(apps, F.lit(overall))
    apps = work.saved(apps.select("app", ((F.col("k") + m * overall) / (F.col("n") + m)).alias("app_share")), "apps")
    below = windows.alias("w").join(apps.alias("a"), F.col("w.app").eqNullSafe(F.col("a.app"))).select(
        "w.app", "w.window", "w.n", "w.k", "a.app_share")
    m2 = shrinkage(below, F.col("app_share"))
    shares = work.saved(below.select("app", "window", ((F.col("k") + m2 * F.col("app_share"))
                                                       / (F.col("n") + m2)).alias("share")), "shares")
    prior = F.coalesce("s.share", "a.app_share", F.lit(overall))
    logit = F.col("evidence") + F.log("prior") - F.log(1 - F.col("prior"))
    return (scored.alias("e")
            .join(shares.alias("s"), F.col("e.app").eqNullSafe(F.col("s.app"))
                  & F.col("e.window").eqNullSafe(F.col("s.window")), "left")
            .join(apps.alias("a"), F.col("e.app").eqNullSafe(F.col("a.app")), "left")
            .select("e.event_id", "e.evidence", prior.alias("prior"))
            .withColumn("posterior", F.when(F.col("prior") <= 0, 0.0).otherwise(1 / (1 + F.exp(-logit))))
            .withColumn("rejected", F.col("posterior") > 0.5))


def accepted(activity: DataFrame, labels: DataFrame) -> DataFrame:
    """``activity`` without the events that are rejected; all columns stay."""
    out = score_quality(activity, labels).filter("rejected").select(F.col("event_id").alias("_out")).distinct()
    return activity.join(out, F.col("event_id") == F.col("_out"), "left_anti")
