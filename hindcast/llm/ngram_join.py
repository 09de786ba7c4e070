"""Similarity join of event texts on word n-grams.

The texts are rows and the n-grams columns of a sparse incidence matrix; what
two texts share is an entry of its product with itself. Only the part of the
product that can hold a link is formed. N-grams are ordered from rare to
frequent (the frequency classes come from exact counts in hash blocks), and of
a text only the first ``n - ceil(share * n) + 1`` enter the product: two texts
that link share one of them. N-grams that occur once are first in that order
and have no partner, so they use up places without making entries. A pair is
dropped when the sizes and the place of the n-gram where it meets show that
the overlap cannot reach the share. For the pairs left the overlap is counted
in full.

A family of copies would fill a square of the product. Before the product, each
text is therefore compared with the one text of its columns' heads that it
shares most with; what that links is one component, and the product is formed
only between different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hindcast.llm.components import connected
from hindcast.llm.grams import Slice, slices, word_shingles, words
from hindcast.llm.sketch import FrequentBits, frequent_bits
from hindcast.llm.stored import Workspace

WIDTH, PERCENT = 4, 85
BITS, FREQUENT = 26, 16
STARS = 2

PREFIXES = "id long, n int, partnered int, prefix array<long>"


def gram_sets(part: Slice, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a slice."""
    out = []
    for found in word_shingles(words(part), width):
        found = np.sort(found)
        out.append(found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found)
    return out


def _prints(width: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for part in slices(batch.column(1)):
                yield np.concatenate(gram_sets(part, width))
    return prints


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(texts: DataFrame, shared: Broadcast[FrequentBits], width: int, percent: int) -> DataFrame:
    """Set size, how many n-grams may occur in other texts, and the n-grams that enter the product, for each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, partnered, chosen = [], [], []
            for part in slices(batch.column(1)):
                sets = gram_sets(part, width)
                joined = np.concatenate(sets)
                again, often = shared.value.has(0, joined), shared.value.has(1, joined)
                at = 0
                for found in sets:
                    n = len(found)
                    here = again[at:at + n]
                    partnered.append(int(here.sum()))
                    room = prefix_length(n, percent) - (n - partnered[-1])
                    if n and room > 0:
                        frequent_here = often[at:at + n]
                        found = np.concatenate((found[here & ~frequent_here], found[here & frequent_here]))[:room]
                    else:
                        found = found[:0]
                    sizes.append(n)
                    chosen.append(found.view(np.int64))
                    at += n
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in chosen]))).astype(np.int32)
            values = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(partnered, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int64()))],
                ["id", "n", "partnered", "prefix"])

    return texts.mapInArrow(made, PREFIXES)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose n-gram sets have the share of their union in common, exactly."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            ours = [s for part in slices(batch.column(2)) for s in gram_sets(part, width)]
            keep = []
            for k, b in enumerate(batch.column(1).to_pylist()):
                if held[0] != b:
                    held = (b, gram_sets(next(slices(batch.column(3).slice(k, 1))), width)[0])
                both = len(np.intersect1d(ours[k], held[1], assume_unique=True))
                keep.append(100 * both >= percent * (len(ours[k]) + len(held[1]) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(check, "a long, b long"))


def _up(numerator: Column, percent: int) -> Column:
    """``numerator * percent / (100 + percent)``, rounded up."""
    return F.ceil(F.lit(percent) * numerator / F.lit(100 + percent))


def product(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``entries`` (gram, at, id, n, partnered, root) whose
    sizes and places let them link across components.

    The smaller text of a pair needs ``2 * percent / (100 + percent)`` of its
    n-grams in the other one, so only its first n-grams beyond that share meet
    those that the larger one entered. Of the n-grams that a pair shares the
    first one bounds the overlap by what is left of both texts from there on.
    """
    overlap, sole = _up(F.col("n") + F.col("m"), percent), F.col("n") - F.col("partnered")
    placed = entries.withColumn("rest", F.col("partnered") - F.col("at"))
    small = (placed.filter(F.col("at") < F.col("n") - _up(2 * F.col("n"), percent) + 1 - sole)
             .select("gram", F.col("id").alias("a"), "n", "rest", "root"))
    large = placed.select("gram", F.col("id").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"),
                          F.col("root").alias("root_b"))
    return (small.join(large, "gram")
            .filter((F.col("root") != F.col("root_b")) & (F.least("rest", "rest_b") >= overlap)
                    & ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).select("a", "b"))


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("id"))
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def ngram_components(activity: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Components of events whose texts share ``percent`` of their word n-grams.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set holds
    its distinct ``width``-word n-grams, or the whole sequence when it has
    fewer words. Returns ``event_id, n_shingles`` (set size) and
    ``component_id``, the smallest id reachable by links, itself included; one
    row per event. Null, empty and blank texts have an empty set and link with
    nothing. Rows with a null ``event_id`` are left out; repeated rows count
    once; ties do not arise; an empty table gives no rows.
    """
    spark: SparkSession = activity.sparkSession
    work = Workspace(spark, "ngrams")
    rows = activity.filter("event_id is not null").select(
        F.col("event_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = work.saved(rows.select("id", F.unhex(F.md5("text")).alias("whole")).distinct(), "whole")
    first = whole.groupBy("whole").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    copies = work.saved(whole.join(first.filter("n_copies > 1").drop("n_copies"), "whole")
                        .filter("id <> first").select("id", "first"), "copies")
    texts = rows.join(copies.select("id").distinct(), "id", "left_anti")
    shared = spark.sparkContext.broadcast(frequent_bits(texts, _prints(width), [2, FREQUENT], BITS))  # of fixed size
    sized = work.saved(prefixes(texts, shared, width, percent), "prefixes")
    shared.destroy()
    entries = sized.select("id", "n", "partnered", F.posexplode("prefix").alias("at", "gram"))
    columns = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("gram")
    members = work.saved(entries.join(columns, "gram", "left_semi"), "entries")

    links, roots = None, None
    for turn in range(STARS):
        # The text whose n-grams others hold most is likeliest to link; then the smallest id.
        head = F.max(F.struct(F.col("partnered") / F.col("n"), F.col("id")))["id"] if turn == 0 else F.min("id")
        labelled = _labelled(members, roots)
        heads = (labelled.groupBy("gram").agg(head.alias("head"), F.min("root").alias("r0"),
                                              F.max("root").alias("r1"))
                 .filter("r0 <> r1").select("gram", "head"))
        head_roots = _labelled(heads.select(F.col("head").alias("id")).distinct(), roots).select(
            F.col("id").alias("head"), F.col("root").alias("head_root"))
        best = (labelled.join(heads, "gram").groupBy("id", "root", "head").agg(F.count(F.lit(1)).alias("shared"))
                .join(head_roots, "head").filter("root <> head_root")
                .groupBy(F.col("id").alias("a")).agg(F.max_by("head", F.struct("shared", "head")).alias("b")))
        found = work.saved(verified(best, texts, width, percent), f"star-{turn}")
        links = found if links is None else links.unionByName(found)
        roots = connected(links, work, f"roots-{turn}")

    labelled = _labelled(members, roots)
    open_columns = (labelled.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
                    .filter("r0 <> r1").select("gram"))
    left = work.saved(labelled.join(open_columns, "gram", "left_semi"), "open")
    rest = work.saved(verified(product(left, percent), texts, width, percent), "product")
    roots = connected(links.unionByName(rest), work, "roots")
    return (whole.join(copies, "id", "left").withColumn("first", F.coalesce("first", "id"))
            .join(sized.select(F.col("id").alias("first"), "n").distinct(), "first")
            .join(roots.select(F.col("id").alias("first"), "root"), "first", "left")
            .select(F.col("id").alias("event_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("root", "first")).otherwise(F.col("id")).alias("component_id")))
