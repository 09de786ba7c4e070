"""Exact top-k search of energy envelopes by inner product.

Every envelope is described at several resolutions by the means and deviations
of its segments. Two envelopes are at least
``sum(length * ((mean - mean')^2 + (deviation - deviation')^2))`` apart
(squared), and the inner product is half of the two squared norms less that
distance; so segment statistics bound the score from above. A block of
envelopes is searched coarse to fine: the bound of the coarsest resolution
gives a few candidates whose exact scores set the mark, finer bounds drop what
cannot reach it, and exact scores are taken of the survivors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RESOLUTIONS = (4, 16)
QUERY_BLOCK, ENVELOPE_BLOCK = 1024, 8192
LARGEST = float(1 << 31)

FOUND = "query_id long, event_id long, score long"


def usable(rms: Column) -> Column:
    """Not null, not empty, every component finite."""
    odd = F.exists(rms, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return rms.isNotNull() & (F.size(rms) > 0) & ~odd


def scaled(rms: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component as double, held within 32 bits."""
    return F.transform(rms, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"),
                                                         F.lit(-LARGEST)), F.lit(LARGEST - 1)).cast("long"))


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, both times the root of the segment's length."""
    parts = np.array_split(x.astype(np.float64), min(count, x.shape[1]), axis=1)
    roots = [np.sqrt(p.shape[1]) for p in parts]
    return (np.stack([p.mean(axis=1) * r for p, r in zip(parts, roots, strict=True)], axis=1),
            np.stack([p.std(axis=1) * r for p, r in zip(parts, roots, strict=True)], axis=1))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; where they might leave 64 bits they are formed
    without a limit and held at the 64-bit ends."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2.0 ** 62:
        return x @ q
    wide = x.astype(object) @ q.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in wide], np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray,
                 k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best (id, score) of the block, ties to the smaller id."""
    levels = [(segments(q, n), segments(x, n)) for n in RESOLUTIONS]
    q_norm, x_norm = (q.astype(np.float64) ** 2).sum(axis=1), (x.astype(np.float64) ** 2).sum(axis=1)
    for n, query_id in enumerate(q_ids.tolist()):
        slack = 1e-9 * (q_norm[n] + x_norm) + 1e-3

        def ceiling(level: int, rows: np.ndarray, n=n, slack=slack) -> np.ndarray:
            (qm, qd), (xm, xd) = levels[level]
            apart = ((xm[rows] - qm[n]) ** 2).sum(axis=1) + ((xd[rows] - qd[n]) ** 2).sum(axis=1)
            return (q_norm[n] + x_norm[rows] - apart) / 2 + slack[rows]

        rows = np.flatnonzero(ids != query_id)
        if len(rows) > k:
            most = ceiling(0, rows)
            likely = rows[np.argpartition(-most, k - 1)[:k]]
            mark = exact(x[likely], q[n]).min()
            rows = rows[most >= mark]
            for level in range(1, len(levels)):
                rows = rows[ceiling(level, rows) >= mark]
        scores = exact(x[rows], q[n])
        best = np.lexsort((ids[rows], -scores))[:k]
        yield query_id, ids[rows[best]], scores[best]


def top_envelopes(envelopes: DataFrame, asked: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` envelopes with the largest inner product for each asked envelope.

    Both tables need ``event_id`` and ``rms`` (array of numbers); other columns
    are not read. Components are taken as ``floor(scale * x)``. Returns
    ``query_id, rank`` (from 1), ``event_id, score``; ties go to the smaller
    ``event_id``, an envelope is never compared with its own id, and only
    envelopes of one length are compared. Rows whose id or envelope is null,
    or whose envelope is empty or holds null or non-finite components, take no
    part. Repeated rows are candidates each, and a repeated query is asked
    once. With fewer than ``k`` candidates all are given; empty tables give no
    rows. Scaled components are held within 32 bits, scores within 64.

    Asked envelopes meet all others in blocks of bounded size, so neither side
    is held or broadcast as a whole.
    """
    def prepared(df: DataFrame) -> DataFrame:
        return (df.select(F.col("event_id").cast("long").alias("event_id"), "rms")
                .filter(F.col("event_id").isNotNull() & usable(F.col("rms")))
                .select("event_id", scaled(F.col("rms"), scale).alias("x")).withColumn("size", F.size("x")))

    queries, rows = prepared(asked).dropDuplicates(["event_id"]), prepared(envelopes)
    counts = [df.count() for df in (queries, rows)]
    q_blocks, blocks = (max(1, -(-n // most)) for n, most in zip(counts, (QUERY_BLOCK, ENVELOPE_BLOCK), strict=True))
    spread = int(envelopes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(blocks, min(spread, -(-counts[1] // 512)))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("event_id"), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    def searched(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if ours.empty or theirs.empty:
            return pd.DataFrame({"query_id": [], "event_id": [], "score": []}, dtype="int64")
        found = list(search_block(ours["event_id"].to_numpy(), np.stack(ours["x"].to_list()),
                                  theirs["event_id"].to_numpy(), np.stack(theirs["x"].to_list()), k))
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                             "event_id": np.concatenate([f[1] for f in found]),
                             "score": np.concatenate([f[2] for f in found])})

    key = ["size", "q_block", "block"]
    return (dealt(queries, "q_block", q_blocks, "block", blocks).groupBy(*key)
            .cogroup(dealt(rows, "block", blocks, "q_block", q_blocks).groupBy(*key))
            .applyInPandas(searched, FOUND)
            .withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, event_id)"))
            .filter(F.col("rank") <= k).select("query_id", "rank", "event_id", "score"))
