"""Repeated passages of event text by an enhanced suffix array over anchors.

A passage of ``WIDTH`` bytes holds an anchor: the smallest hash among its
``GRAM``-byte grams, the leftmost of equals. Equal passages hold equal anchors
at the same place, so it is enough to compare the surroundings of equal
anchors. The text right of the anchors, sorted with its common-prefix lengths,
is a sparse suffix array; the text left of them, read backwards, a second one.
A stack scan of the left array gives the nodes of its common-prefix interval
tree, that is sets of occurrences with the same ``reach`` bytes before the
anchor; a stack scan of such a set in the right array gives its intervals.
An interval whose members differ in what comes before them (they lie below
different children of the left node) is a maximal repeat group, and all its
members are occurrences of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hindcast.llm.grams import Slice, mix, prefix_hashes, slices, span_hashes, window_hashes
from hindcast.llm.sketch import FrequentBits, frequent_bits
from hindcast.llm.stored import Workspace

WIDTH, GRAM = 100, 32
BLOCK_ROWS = 20_000
BITS = 26

CONTEXTS = "print long, event_id long, at int, reach int, context binary"
LATER = "of_event long, of_at int"  # of a repeated context: the place whose groups it shares
CUTS = "event_id long, start int, stop int"
GROUPS = "print long, reach int, length int, event_id long, start int"
RESULT = "event_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(part: Slice, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor places in the slice and the hashes of the grams there."""
    n, w = len(part.data), width - gram + 1
    count = n - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(prefix_hashes(part.data), gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:count], low[w - size:w - size + count])
    begins, ends = part.offsets[:-1], part.offsets[1:] - width + 1
    step = np.zeros(n + 1, np.int32)
    long_enough = ends > begins
    np.add.at(step, begins[long_enough], 1)
    np.add.at(step, ends[long_enough], -1)
    low = low[np.cumsum(step[:count]) > 0] & np.uint64(0xFFFFFFFF)
    at = low[np.concatenate(([True], low[1:] != low[:-1]))].astype(np.int64) if len(low) else low.astype(np.int64)
    return at, h[at]


def side_prints(part: Slice, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors with what is before and after them, up to half of a
    passage's other bytes. A passage holds one of the two whole, so an anchor
    matters only if one of them repeats."""
    reach = (width - gram) // 2
    running = prefix_hashes(part.data)
    text = np.searchsorted(part.offsets, at, side="right") - 1
    before = np.maximum(at - reach, part.offsets[text])
    after = np.minimum(at + width - reach, part.offsets[text + 1])
    return (mix(span_hashes(running, before, at + gram) + np.uint64(1)),
            mix(span_hashes(running, at, after) + np.uint64(2)))


def _prints(width: int, gram: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for part in slices(batch.column(1)):
                at, found = anchors(part, width, gram)
                yield np.concatenate((*side_prints(part, at, width, gram), mix(found + np.uint64(3))))
    return prints


def contexts(texts: DataFrame, shared: Broadcast[FrequentBits], width: int, gram: int, everything: bool) -> DataFrame:
    """A row for each anchor that may repeat: the bytes that any passage around it can have.

    Where a context occurs again within a slice, as in texts that say one thing
    over and over, only the first keeps its bytes; the others are cuts at once
    (``context`` null, ``reach`` the length, ``print`` spread by text). With
    ``everything`` the first two keep theirs, so that they make a group by
    themselves, and the others name the first (``LATER``).
    """
    half, spare = (width - gram) // 2, 2 if everything else 1

    def rows(prints, ids, at, reach, found, *of) -> pa.RecordBatch:
        columns = [pa.array(prints.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(at.astype(np.int32)),
                   pa.array(reach.astype(np.int32)), pa.array(found, pa.binary())]
        names = ["print", "event_id", "at", "reach", "context"]
        if everything:
            of_event, of_at = of or ([None] * len(found), [None] * len(found))
            columns += [pa.array(of_event, pa.int64()), pa.array(of_at, pa.int32())]
            names += ["of_event", "of_at"]
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                at, prints = anchors(part, width, gram)
                sides = side_prints(part, at, width, gram)
                before, after = (shared.value.has(0, p) for p in sides)
                if not everything:  # the windows of hot sides are compared by themselves
                    before, after = (x & ~shared.value.has(1, p) for x, p in zip((before, after), sides, strict=True))
                    # A hot anchor is split by its sides; a passage holds one of them.
                    split = shared.value.has(1, mix(prints + np.uint64(3)))
                    both = np.flatnonzero(split & before & after)
                    prints = np.where(split, np.where(before, *sides), prints)
                    at, prints = np.concatenate((at, at[both])), np.concatenate((prints, sides[1][both]))
                    before = np.concatenate((before, np.zeros(len(both), bool)))
                    after = np.concatenate((after, np.ones(len(both), bool)))
                    after[both] = False
                    placed = np.argsort(at, kind="stable")
                    at, prints, before, after = at[placed], prints[placed], before[placed], after[placed]
                text = np.searchsorted(part.offsets, at, side="right") - 1
                lo = np.maximum(part.offsets[text], at - np.where(before, width - gram, half))
                hi = np.minimum(part.offsets[text + 1], at + np.where(after, width, width - half))
                again = (before | after) & (hi - lo >= width)
                at, prints, text, lo, hi = at[again], prints[again], text[again], lo[again], hi[again]
                if not len(at):
                    continue
                begin = part.offsets[text]
                whole = mix(span_hashes(prefix_hashes(part.data), lo, hi) + (at - lo).astype(np.uint64)) ^ prints
                order = np.lexsort((at, ids[part.lo + text], whole))
                head = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
                heads = np.flatnonzero(head)[np.cumsum(head) - 1]
                same = np.arange(len(order)) - heads >= spare
                first, later = np.sort(order[~same]), np.sort(order[same])
                raw = part.data.tobytes()
                yield rows(prints[first], ids[part.lo + text[first]], (at - begin)[first], (at - lo)[first],
                           [raw[i:j] for i, j in zip(lo[first].tolist(), hi[first].tolist(), strict=True)])
                if len(later) and everything:
                    later, of = order[same], order[heads[same]]
                    yield rows(prints[later], ids[part.lo + text[later]], (at - begin)[later], (at - lo)[later],
                               [None] * len(later), ids[part.lo + text[of]].astype(np.int64),
                               (at - begin)[of].astype(np.int32))
                elif len(later):
                    joined = np.concatenate(([True], (lo[later][1:] > hi[later][:-1])
                                             | (text[later][1:] != text[later][:-1])))
                    head = np.flatnonzero(joined)
                    ends = np.maximum.reduceat(hi[later], head)
                    starts, of = np.minimum.reduceat(lo[later], head), text[later][head]
                    yield rows(mix(of.astype(np.uint64)), ids[part.lo + of], starts - part.offsets[of], ends - starts,
                               [None] * len(head))

    return texts.mapInArrow(cut, f"{CONTEXTS}, {LATER}" if everything else CONTEXTS)


def hot_cuts(texts: DataFrame, shared: Broadcast[FrequentBits], width: int, gram: int) -> DataFrame:
    """The cuts (``CUTS``) at anchors with a side that more than ``BLOCK_ROWS``
    places share, from the windows of ``width`` bytes that hold that side.

    Equal windows of a slice fold to their earliest place before the shuffle,
    so a window in every text makes a row for each slice; its places are then
    ordered by a spillable sort. Windows are told apart by their bytes within
    a slice and by a 128-bit digest between slices.
    """
    half = (width - gram) // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                at, _ = anchors(part, width, gram)
                before, after = (shared.value.has(1, p) for p in side_prints(part, at, width, gram))
                marked = np.zeros(len(part.data) + 1, np.int32)
                text = np.searchsorted(part.offsets, at, side="right") - 1
                for hot, lo, hi in ((before, at - (width - gram), at - half), (after, at - half, at)):
                    lo = np.maximum(lo, part.offsets[text])[hot]
                    hi = np.minimum(hi, part.offsets[text + 1] - width)[hot] + 1
                    np.add.at(marked, lo[hi > lo], 1)
                    np.add.at(marked, hi[hi > lo], -1)
                at = np.flatnonzero(np.cumsum(marked) > 0)
                if not len(at):
                    continue
                text = np.searchsorted(part.offsets, at, side="right") - 1
                raw, found, cuts = part.data.tobytes(), {}, []
                places = zip([ids[part.lo + k] for k in text.tolist()], (at - part.offsets[text]).tolist(), at.tolist(),
                             strict=True)
                for event_id, start, k in sorted(places):
                    place = (event_id, start, start + width)
                    if found.setdefault(raw[k:k + width], place) == place:
                        continue
                    if cuts and cuts[-1][0] == event_id and start <= cuts[-1][2]:
                        place = (event_id, cuts.pop()[1], start + width)
                    cuts.append(place)
                names = [hashlib.blake2b(w, digest_size=16).digest() for w in found]
                names += [b"%d/%d" % place[:2] for place in cuts]  # known, so they need no company
                some = [*found.values(), *cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array([k >= len(found) for k in range(len(some))]),
                     *(pa.array([p[k] for p in some], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32())))],
                    ["window", "known", "event_id", "start", "stop"])

    rows = texts.mapInArrow(windows, f"window binary, known boolean, {CUTS}")
    place = F.struct("event_id", "start")
    first = F.first(place).over(Window.partitionBy("window").orderBy("event_id", "start"))
    return (rows.withColumn("later", F.col("known") | (place != first)).filter("later")
            .select("event_id", "start", "stop"))


def _sorted_side(prints: np.ndarray, data: np.ndarray, first: np.ndarray, step: int, lengths: np.ndarray,
                 most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (print, bytes from ``first`` in direction ``step``)
    and each row's common-prefix length with the row before; -1 where the print changes."""
    cols = np.arange(most, dtype=np.int32)
    where = first.astype(np.int32)[:, None] + np.int32(step) * cols
    inside = cols < lengths[:, None]
    side = np.where(inside, data[np.where(inside, where, 0)], 0).astype(np.uint8)
    order = np.lexsort((lengths, np.ascontiguousarray(side).view(f"S{most}").ravel(), prints))
    a, b = order[:-1], order[1:]
    same = side[a] == side[b]
    lcp = np.where(same.all(axis=1), most, same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(lengths[a], lengths[b]))
    return order, np.concatenate(([-1], np.where(prints[a] == prints[b], lcp, -1)))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan: the common-prefix intervals (length, first, last) of at least ``least``, inner ones first.
    ``lcp[i]`` belongs to the rows i - 1 and i; ``lcp[0]`` is not read."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def scan(left: list[int], left_lcp: list[int], right_rank: dict[int, int], right_lcp: list[int],
         width: int, gone: set[int]) -> Iterator[tuple[int, int, list[int]]]:
    """The maximal repeat groups among the occurrences of one anchor, as (reach,
    length from the anchor, occurrences), the longer ones of a reach first.

    ``left`` has the occurrences in the order of the left array; ``right_rank``
    gives an occurrence's place in the right array. Those in ``gone``, which
    may grow meanwhile, are passed over.
    """
    for reach, lo, hi in intervals(left_lcp, 0):
        child, children = 0, {}
        for i in range(lo, hi + 1):
            child += i > lo and left_lcp[i] == reach
            if left[i] not in gone:
                children[left[i]] = child
        if len(children) < 2:
            continue
        rows = sorted(children, key=right_rank.__getitem__)
        ranks = [right_rank[r] for r in rows]
        lcp = [-1, *(min(right_lcp[a + 1:b + 1]) for a, b in zip(ranks, ranks[1:], strict=False))]
        changes, runs = 0, [0]
        for a, b in zip(rows, rows[1:], strict=False):
            changes += children[a] != children[b]
            runs.append(changes)
        for length, first, last in intervals(lcp, width - reach):
            if runs[first] != runs[last]:  # else a child of the node reaches further back
                yield reach, length, rows[first:last + 1]


def block_groups(prints: np.ndarray, ids: np.ndarray, at: np.ndarray, reach: np.ndarray, parts: list[bytes],
                 width: int, gram: int, everything: bool) -> tuple[list, list, list]:
    """Occurrences of maximal repeat groups among whole anchors, as the lists row, reach and length.

    Without ``everything`` an occurrence is given with the longest group of a
    reach in which another one is earlier, and again for a smaller reach only
    if that group goes on further; that is all that a removal needs.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = np.frombuffer(b"".join(parts), np.uint8)
    out: tuple[list, list, list] = ([], [], [])
    rows = np.arange(len(parts))
    for narrowed in (False, True):
        where = starts[rows] + reach[rows]
        left, left_lcp = _sorted_side(prints[rows], data, where - 1, -1, reach[rows], width - gram)
        right, right_lcp = _sorted_side(prints[rows], data, where, 1, sizes[rows] - reach[rows], width)
        if narrowed:
            break
        best = np.zeros((2, len(rows)), np.int64)
        for side, (order, lcp) in enumerate(((left, left_lcp), (right, right_lcp))):
            best[side, order] = np.maximum(lcp, np.append(lcp[1:], -1))
        keep = best.sum(axis=0) >= width  # others share too little with any neighbour
        rows = rows[keep]
        if len(rows) < 2:
            return out
    rank = np.empty(len(rows), np.int64)
    rank[right] = np.arange(len(rows))
    age = np.empty(len(rows), np.int64)
    age[np.lexsort((at[rows], ids[rows]))] = np.arange(len(rows))
    bounds = np.append(np.flatnonzero(left_lcp < 0), len(rows)).tolist()
    left_all, lcp_all, right_all = left.tolist(), left_lcp.tolist(), right_lcp.tolist()
    rank_all, age_all, row_all = rank.tolist(), age.tolist(), rows.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi - lo < 2:
            continue
        if hi - lo == 2 and not everything:
            a, b = left_all[lo:hi]
            if lcp_all[lo + 1] + right_all[lo + 1] >= width:
                for kept, v in zip(out, (row_all[a if age_all[a] > age_all[b] else b], lcp_all[lo + 1],
                                         right_all[lo + 1]), strict=True):
                    kept.append(v)
            continue
        members = left_all[lo:hi]
        local = {r: rank_all[r] - lo for r in members}
        best: dict[int, int] = {}
        gone: set[int] = set()
        for far, length, found in scan(members, lcp_all[lo:hi], local, right_all[lo:hi], width, gone):
            if everything:
                some = found
            else:
                head = min(found, key=age_all.__getitem__)
                some = [r for r in found if best.get(r, 0) < length and r != head]
                best.update(dict.fromkeys(some, length))
                if length == width:  # what repeats these also repeats the first of them
                    gone.update(some)
            for r in some:
                for kept, v in zip(out, (row_all[r], far, length), strict=True):
                    kept.append(v)
    return out


def _by_anchor(rows: DataFrame, width: int, gram: int, everything: bool, schema: str) -> DataFrame:
    """Whole anchors, sorted together by a spillable sort, a block of them at a time."""

    def found(table: pa.Table) -> pa.RecordBatch:
        prints, ids, at, reach = (table.column(k).to_numpy() for k in range(4))
        row, far, length = (np.array(x, np.int64) for x in block_groups(
            prints, ids, at.astype(np.int64), reach.astype(np.int64), table.column(4).to_pylist(),
            width, gram, everything))
        start = (at[row] - far).astype(np.int32)
        if everything:
            columns = [prints[row], far.astype(np.int32), (far + length).astype(np.int32), ids[row], start]
        else:
            columns = [ids[row], start, (at[row] + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bare = pc.is_null(batch.column(4))
            if not everything and pc.any(bare).as_py():
                _, ids, at, length, _ = batch.filter(bare).columns
                yield pa.RecordBatch.from_arrays([ids, at, pc.add(at, length)], ["event_id", "start", "stop"])
            batch = batch.filter(pc.invert(bare))
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS and held[0].column(0)[0] != batch.column(0)[-1]:
                table = pa.Table.from_batches(held).combine_chunks()
                prints = table.column(0).to_numpy()
                whole = int(np.searchsorted(prints, prints[-1]))  # the last anchor may go on
                yield found(table.slice(0, whole).combine_chunks())
                held, size = table.slice(whole).to_batches(), size - whole
        if size:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("print").sortWithinPartitions("print").mapInArrow(scanned, schema)


def _texts(activity: DataFrame) -> DataFrame:
    return activity.select(F.col("event_id").cast("long").alias("event_id"), "text")


def _found(work: Workspace, texts: DataFrame, width: int, gram: int, everything: bool) -> DataFrame:
    """The occurrences, or the cuts, of all anchors of ``texts``, as a written table."""
    bits = frequent_bits(texts, _prints(width, gram), [2, BLOCK_ROWS], BITS)
    shared = work.spark.sparkContext.broadcast(bits)  # of fixed size
    rows = contexts(texts, shared, width, gram, everything)
    if everything:
        rows = work.saved(rows, "contexts")
        later = rows.filter("of_event is not null").select(
            "print", F.col("event_id").alias("later_event"), F.col("at").alias("later_at"), "of_event", "of_at")
        whole = rows.filter("of_event is null").drop("of_event", "of_at")
        groups = work.saved(_by_anchor(whole, width, gram, True, GROUPS), "groups")
        more = (groups.withColumnsRenamed({"event_id": "of_event"}).withColumn("of_at", F.col("start") + F.col("reach"))
                .join(later, ["print", "of_event", "of_at"])
                .select("print", "reach", "length", F.col("later_event").alias("event_id"),
                        (F.col("later_at") - F.col("reach")).alias("start")))
        found = work.saved(groups.unionByName(more), "found")
    else:
        cuts = _by_anchor(rows, width, gram, False, CUTS)
        if bits.tables[1].any():
            cuts = cuts.unionByName(hot_cuts(texts, shared, width, gram))
        found = work.saved(cuts, "found")
    shared.destroy()
    return found


def repeat_groups(activity: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeat groups of at least ``width`` bytes around each anchor:
    ``print`` (the anchor), ``reach`` (bytes of the repeat before it), ``length``,
    and the occurrences ``event_id, start``. A repeat is followed for up to
    ``width`` bytes from an anchor; a longer one shows as one group for each
    anchor in it. Equal contexts of a slice are compared as two and joined back to
    their groups. The different contexts of one anchor are one task's work, in
    memory. Null and short texts have none."""
    work = Workspace(activity.sparkSession, "repeats")
    texts = _texts(activity).filter("event_id is not null and octet_length(text) >= %d" % width)
    return _found(work, texts, width, gram, True).distinct()


def remove_repeats(activity: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts
    earlier: in an event with a smaller ``event_id``, or before in the same text.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Returns one row per input row: ``event_id, n_bytes, n_removed, n_spans``
    (maximal removed runs) and ``kept_sha256`` of the bytes that stay. Bytes
    are UTF-8; passages never reach over an event's end; what repeats is judged
    on the input. Null and empty texts have 0 bytes. A row with a null
    ``event_id`` takes no part and is kept whole; rows that repeat an id and
    its text are one event; an empty table gives no rows.
    """
    spark: SparkSession = activity.sparkSession
    work = Workspace(spark, "repeats")
    texts = _texts(activity)
    long_texts = texts.filter("event_id is not null and octet_length(text) >= %d" % width)
    # Exact copies of a whole text: all but the first go as they are, without any comparison of passages.
    prints = work.saved(long_texts.select("event_id", F.unhex(F.md5("text")).alias("whole")), "whole")
    firsts = prints.groupBy("whole").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = work.saved(prints.join(firsts, "whole").filter("event_id <> first").select("event_id").distinct(),
                        "copies")
    alone = long_texts.join(copies, "event_id", "left_anti")
    cuts = _found(work, alone, width, gram, False)
    spans = (cuts.groupBy("event_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
             .unionByName(copies.select("event_id", F.expr(
                 "array(named_struct('start', 0, 'stop', 2147483647))").alias("cuts"))))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for event_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                pieces, done, removed, runs, end = [], 0, 0, 0, -1
                for start, stop in sorted((c["start"], min(c["stop"], len(data))) for c in found or ()):
                    if start > end:
                        pieces.append(data[done:start])
                        runs += 1
                        removed += stop - start
                        end = done = stop
                    elif stop > end:
                        removed += stop - end
                        end = done = stop
                pieces.append(data[done:])
                rows.append((event_id, len(data), removed, runs, hashlib.sha256(b"".join(pieces)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows, strict=True),
                                                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["event_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(spans, "event_id", "left").mapInArrow(kept, RESULT)
