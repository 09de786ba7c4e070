"""Decontamination by greedy string tiling against held-out items.

Runs of ``SEED`` tokens that an event shares with an item are found by hash; a
pair whose shared runs could cover too little of the item is dropped by their
number alone. For the pairs left, rolling hashes give all matching runs, and
the longest match among tokens not yet marked is marked on both sides again
and again. The share of the item's tokens that end up marked is its coverage,
so passages in another order count as well as whole ones.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.grams import BASE, mix, plain_words, slices
from hindcast.llm.sketch import frequent_bits
from hindcast.llm.stored import Workspace

SEED, COVERAGE = 5, 0.5
BITS = 24
BROADCAST_PAIRS = 1 << 20  # of 16 bytes

SEEDS = "id long, print long, times int, n_tokens int"
TILED = "event_id long, item_id long, n_tokens int, n_covered int, n_tiles int, coverage double"


def runs(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hashes of every ``width`` tokens."""
    count = len(tokens) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(BASE) + tokens[k:k + count]
    return mix(rolled + np.uint64(width))


def tokens_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The token hashes of each text."""
    for part in slices(column):
        found = plain_words(part)
        for lo, hi in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            yield found.hashes[lo:hi]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of the tiles of at least ``least`` tokens."""
    ours, theirs = runs(item, least), runs(text, least)
    at = np.flatnonzero(np.isin(theirs, ours))
    if not len(at):
        return []
    index = defaultdict(list)
    for i, print_ in enumerate(ours.tolist()):
        index[print_].append(i)
    diagonals = defaultdict(list)
    for j, print_ in zip(at.tolist(), theirs[at].tolist(), strict=True):
        for i in index[print_]:
            diagonals[j - i].append(i)
    heap = []
    for shift, places in diagonals.items():  # places rise, as the text is read forwards
        places.sort()
        first = last = places[0]
        for i in [*places[1:], None]:
            if i is not None and i == last + 1:
                last = i
                continue
            heap.append((-(last - first + least), first, first + shift))
            if i is not None:
                first = last = i
    heapq.heapify(heap)
    item_free, text_free = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles = []
    while heap:
        length, i, j = heapq.heappop(heap)
        free = item_free[i:i - length] & text_free[j:j - length]
        if free.all():
            item_free[i:i - length] = text_free[j:j - length] = False
            tiles.append((i, j, -length))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= least:
                heapq.heappush(heap, (lo - hi, i + lo, j + lo))
    return tiles


def _seeds(texts: DataFrame, widths: list[int] | None, shared: Broadcast | None = None) -> DataFrame:
    """(id, print, times, n_tokens): the distinct seeds of each text. Without
    ``widths`` a text's own seed is as long as the text where that is shorter."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for event_id, tokens in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1)), strict=True):
                for width in widths or ([min(SEED, len(tokens))] if len(tokens) else []):
                    found = runs(tokens, width)
                    if shared is not None:
                        found = found[shared.value.has(0, found)]
                    if len(found):
                        prints, times = np.unique(found, return_counts=True)
                        for kept, v in zip(out, (np.full(len(prints), event_id, np.int64), prints.view(np.int64), times,
                                                 np.full(len(prints), len(tokens))), strict=True):
                            kept.append(v)
            joined = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(joined, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                ["id", "print", "times", "n_tokens"])

    return texts.mapInArrow(made, SEEDS)


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for tokens in tokens_of(batch.column(1)):
            if len(tokens):
                yield runs(tokens, min(SEED, len(tokens)))


def item_coverage(activity: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The events that hold a held-out item, with how much of it.

    ``activity`` needs ``event_id`` and ``text``, ``items`` needs ``item_id``
    and ``text``; other columns are not read. Tokens are runs of letters and
    digits without case. Returns one row per event and item whose tiles of at
    least ``SEED`` tokens (or of the whole item, where it is shorter) cover
    ``coverage`` of the item's tokens: ``event_id, item_id, n_tokens`` (of the
    item), ``n_covered, n_tiles, coverage``. Of equal tiles the one first in
    the item, then in the text, is marked first. Null, empty and token-less
    texts and items match nothing; rows with a null id take no part; repeated
    rows give one row; an empty table gives no rows.
    """
    spark: SparkSession = activity.sparkSession
    work = Workspace(spark, "tiling")
    texts = activity.filter("event_id is not null").select(F.col("event_id").cast("long").alias("id"), "text")
    held_out = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    item_seeds = work.saved(_seeds(held_out, None).withColumnRenamed("id", "item_id"), "item-seeds")
    # At most SEED widths: all but the longest come from items that are shorter than a seed.
    widths = sorted(r["width"] for r in item_seeds.select(
        F.least("n_tokens", F.lit(SEED)).alias("width")).distinct().collect())
    shared = spark.sparkContext.broadcast(frequent_bits(held_out, _item_prints, [1], BITS))  # of fixed size
    seeds = _seeds(texts, widths or [SEED], shared).select(F.col("id").alias("event_id"), "print")
    enough = F.sum("times") * F.least(F.max("n_tokens"), F.lit(SEED)) >= F.lit(coverage) * F.max("n_tokens")
    pairs = work.saved(seeds.join(item_seeds, "print").groupBy("event_id", "item_id")
                       .agg(enough.alias("enough")).filter("enough").select("event_id", "item_id"), "pairs")
    shared.destroy()
    # Few events have any pair; the pairs are broadcast only while they are at most BROADCAST_PAIRS.
    near = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    facing = (texts.withColumnRenamed("id", "event_id").join(near, "event_id")
              .join(held_out.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
              .select("event_id", "item_id", "text", "item"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for event_id, item_id, text, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                     tokens_of(batch.column(2)), tokens_of(batch.column(3)), strict=True):
                if len(item):
                    found = tile(item, text, min(SEED, len(item)))
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(item) and found:
                        rows.append((event_id, item_id, len(item), covered, len(found), covered / len(item)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
                ["event_id", "item_id", "n_tokens", "n_covered", "n_tiles", "coverage"])

    return facing.mapInArrow(tiled, TILED).distinct()


def without_items(activity: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``activity`` without the events that hold a held-out item; all columns stay."""
    held = item_coverage(activity, items, coverage).select(F.col("event_id").alias("_held")).distinct()
    return activity.join(held, F.col("event_id") == F.col("_held"), "left_anti")
