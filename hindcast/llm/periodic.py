"""Runs of periodically repeated words in texts, by Lyndon roots and suffix trees.

A run is a stretch of words with a smallest period that no neighbouring word
extends. Every run has a Lyndon root that is the longest Lyndon word at its
place, in one of the two orders of the words (the runs theorem), so each place
gives one candidate for each order. A candidate is extended to the right and
to the left by two questions for the longest common extension (LCE), which a
suffix tree of the words and one of their reversal answer: the trees are
Ukkonen's, and the LCE of two places is the depth of their leaves' lowest
common ancestor, a range minimum over the Euler tour. The tour is kept only at
its turning points between leaves, and a sparse table answers in constant time.

Trees are built only where a run can be: each run lies in a stretch of words
whose n-grams occur again within a third of the text, so other stretches, most
texts as a whole, need none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hindcast.llm.grams import BASE, SEPARATOR, Slice, Words, mix, prefix_hashes, slices, span_hashes, spans

GRAM = 8
MIN_LENGTH, MIN_POWER = 24, 3

RUNS = "event_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (from 1 up), closed by the smallest symbol 0."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.size, self.sigma = len(s), max(s) + 1
        sigma, size = self.sigma, self.size
        start, end, link, suffix = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = edge = length = rest = 0
        for i, symbol in enumerate(s):
            waiting = 0
            rest += 1
            while rest:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    suffix.append(i - rest + 1)
                    if waiting:
                        link[waiting] = node
                    waiting = 0
                else:
                    from_ = start[below]
                    to = end[below]
                    span = (to if to <= i else i + 1) - from_
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[from_ + length] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = len(start)
                    child[key] = split
                    child[split * sigma + s[from_ + length]] = below
                    child[split * sigma + symbol] = split + 1
                    start += (from_, i)
                    end += (from_ + length, size)
                    link += (0, 0)
                    suffix += (-1, i - rest + 1)
                    start[below] = from_ + length
                    if waiting:
                        link[waiting] = split
                    waiting = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.spans = [b - a for a, b in zip(start, end, strict=True)]
        self.suffix = suffix
        self.keys = np.fromiter(child.keys(), np.int64, len(child))
        self.below = np.fromiter(child.values(), np.int64, len(child))

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of the leaves, and before each leaf the
        depth of the highest node that the tour passes since the leaf before.

        With ``reverse`` the order of the symbols is reversed; the closing one stays the smallest.
        """
        parents, symbols = np.divmod(self.keys, self.sigma)
        if reverse:
            symbols = (self.sigma - symbols) % self.sigma
        by = np.argsort(parents * self.sigma + symbols)
        below = self.below[by].tolist()
        bounds = np.searchsorted(parents[by], np.arange(len(self.spans) + 1)).tolist()
        spans, suffix = self.spans, self.suffix
        depth, turn_at = [0] * len(spans), [-1] * len(spans)
        leaves, turns, turn, stack = [], [], 0, [0]
        while stack:
            node = stack.pop()
            if turn_at[node] >= 0:
                turn = turn_at[node]
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                turns.append(turn)
                continue
            here, lo, hi = depth[node], bounds[node], bounds[node + 1]
            for k in range(hi - 1, lo, -1):
                kid = below[k]
                depth[kid] = here + spans[kid]
                turn_at[kid] = here
                stack.append(kid)
            kid = below[lo]
            depth[kid] = here + spans[kid]
            stack.append(kid)
        return np.array(leaves, np.int32), np.array(turns, np.int32)


class Extensions:
    """Longest common extensions of places in constant time each."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(leaves), np.int32)
        self.rank[leaves] = np.arange(len(leaves), dtype=np.int32)
        self.table, width = [turns], 1
        while 2 * width <= len(turns):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the suffixes at ``a`` and ``b``, which differ."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank: where the longest Lyndon word from there ends."""
    out, stack = np.full(len(rank), len(rank), np.int64), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: list[int], min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """(start, length, period) of every run of ``symbols`` (from 1 up) that is
    at least ``min_length`` and ``min_power`` periods long, by start, then period.
    ``min_power`` is 2 or more."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    leaves, turns = tree.tour()
    forward = Extensions(leaves, turns)
    starts, ends = [], []
    for order in (forward.rank, np.argsort(tree.tour(reverse=True)[0])):
        end = next_smaller(order[:n].tolist())
        at = np.flatnonzero((end < n) & (min_power * (end - np.arange(n)) <= n))
        starts.append(at)
        ends.append(end[at])
    i, j = np.concatenate(starts), np.concatenate(ends)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    del tree
    right = forward.lce(i, j)
    del forward
    backward = Extensions(*SuffixTree(symbols[::-1]).tour())
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = backward.lce(n - i[inner], n - j[inner])
    found = np.stack([i - left, left + (j - i) + right, j - i], axis=1)
    found = found[(found[:, 1] >= min_length) & (found[:, 1] >= min_power * found[:, 2])]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _words(part: Slice) -> Words:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` as they stand."""
    starts, ends = spans(~SEPARATOR[part.data], part.offsets)
    return Words(span_hashes(prefix_hashes(part.data), starts, ends), np.searchsorted(starts, part.offsets))


def stretches(hashes: np.ndarray, min_length: int, min_power: int, gram: int) -> list[tuple[int, int]]:
    """The stretches [lo, hi) of a text's words that can hold a run.

    The grams of a run but those in its last period occur again one period
    on, and with those copies they cover all its words. So a run lies in a
    stretch covered by grams of which another is that near.
    """
    n = len(hashes) - gram + 1
    if len(hashes) < min_length:
        return []
    rolled = np.zeros(n, np.uint64)
    for k in range(gram):
        rolled = rolled * np.uint64(BASE) + hashes[k:k + n]
    rolled = mix(rolled)
    by = np.argsort(rolled, kind="stable")
    same = rolled[by[1:]] == rolled[by[:-1]]
    if not same.any():
        return []
    gap = np.full(n, n + 1, np.int64)  # to the next place of the same gram
    gap[by[:-1][same]] = (by[1:] - by[:-1])[same]
    near = np.flatnonzero(gap * min_power <= len(hashes))
    covered = np.zeros(len(hashes) + 1, np.int64)
    for at in (near, near + gap[near]):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + gram, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]))))
    found = []
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if hi - lo >= min_length and gap[lo:hi - gram + 1].min() * min_power <= hi - lo:
            found.append((lo, hi))
    return found


def text_runs(text: bytes, hashes: np.ndarray, min_length: int, min_power: int) -> tuple[list[list[int]], bytes]:
    """The runs of a text and what is left of it when each is cut to its first period."""
    words = text.split()
    gram = max(1, min(GRAM, min_length // min_power))
    where = stretches(hashes, min_length, min_power, gram)
    if not where:
        return [], b" ".join(words)
    found, keep = [], np.ones(len(words), bool)
    for lo, hi in where:
        ids: dict[bytes, int] = {}
        runs = runs_of([ids.setdefault(w, len(ids) + 1) for w in words[lo:hi]], min_length, min_power)
        runs[:, 0] += lo
        for start, length, period in runs.tolist():
            keep[start + period:start + length] = False
            found.append([start, length, period])
    return found, b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def periodic_runs(activity: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """The periodic runs of every event's whole text, and the text without the repeats.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0, and equal only as they
    stand. Returns ``event_id, n_words, runs`` (array of ``start, length,
    period`` in words, by start, then period) and ``collapsed`` (the words
    that no run holds after its first period, joined by one space), one row
    per input row. A run counts from ``max(min_length, min_power * period)``
    words on; ``min_power`` is at least 2 and ``min_length`` at least
    ``3 * min_power``. A null or empty text has no words, no runs and an empty
    ``collapsed``; a null ``event_id`` is kept; repeated rows are each given;
    an empty table gives no rows. A stretch that repeats takes about 600 bytes
    a word while its trees are built; text that does not repeat takes none.
    """
    if min_power < 2 or min_length < 3 * min_power:
        raise ValueError("min_power is at least 2 and min_length at least 3 * min_power")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            for part in slices(batch.column(1)):
                words = _words(part)
                data = part.data.tobytes()
                counts, runs, left = np.diff(words.bounds), [], []
                for (a, b), (lo, hi) in zip(pairwise(part.offsets.tolist()), pairwise(words.bounds.tolist()), strict=True):
                    found, text = text_runs(data[a:b], words.hashes[lo:hi], min_length, min_power)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    left.append(text.decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(counts, pa.int64()),
                     pa.array(runs, kind), pa.array(left, pa.string())], ["event_id", "n_words", "runs", "collapsed"])

    return activity.selectExpr("cast(event_id as long) event_id", "text").mapInArrow(find, RUNS)
