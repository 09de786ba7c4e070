"""Best-fit packing of token pieces by minimum bin slack.

Only the number of pieces of each length matters for a packing, and there are
at most ``capacity`` lengths. The plan is therefore made on that histogram,
whatever the number of pieces: the longest length left opens a bin, a bitset
subset-sum over the other lengths finds the fullest combination that fits, and
the combination is taken out as often as the counts allow. Each step uses up a
length or nearly does, so the steps do not grow with the input. Pieces then
find their place by their rank within their length.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.stored import Workspace

CAPACITY = 4096
MEMO_CHUNKS, MEMO_CHARS = 300_000, 64
SALTS = 256

PIECES = "event_id long, piece int, start long, length long, ids_crc32 long, salt int"
PACKED = ("event_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level models put for each byte: a printable
    Latin-1 byte stands for itself, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Chunks(dict):
    """Ids, as little-endian 32-bit bytes, of chunks without blanks and line ends.

    A chunk that is one word goes straight to the tokenizer's model,
    lower-cased as it does; a closing full stop or comma is
    encoded by itself; anything else goes through the whole tokenizer. At most
    two generations of ``MEMO_CHUNKS`` chunks of up to ``MEMO_CHARS`` characters
    are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs, self.older = self.tokenizer.model, byte_signs(), {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > MEMO_CHARS:
            return self.found(chunk)
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.found(chunk)
        if len(self) >= MEMO_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def found(self, chunk: str) -> bytes:
        if not chunk:  # an empty text, or between two blanks; a memo that was emptied does not hold it
            return b""
        if chunk[-1] in ".," and chunk[-2:-1].islower():
            return self[chunk[:-1]] + self[chunk[-1]]
        word = chunk.lower()
        if (word.isalpha() and word.islower() and len(word) == len(chunk) and "Σ" not in chunk
                and (word.isascii() or unicodedata.is_normalized("NFC", word))):
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(signs)])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer's words never reach over a blank or a line end, so a text's
    ids are its chunks' ids, whatever its length.
    """

    def __init__(self, path: str):
        self.chunks = Chunks(path)

    @staticmethod
    def of(path: str) -> Encoder:
        """The encoder of this Python worker, which serves many tasks."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        if text.isascii() and "<|" not in text:  # the tokenizer lower-cases all but its special tokens
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(activity: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Each event's ids, ended by ``end_id`` and cut every ``capacity`` ids, as
    ``event_id, piece, start, length, ids_crc32`` and a ``salt`` for ranking."""
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for event_id, text, salt in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                ids = encoder.encode(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((event_id, piece, at // 4, len(part) // 4, zlib.crc32(part), salt))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(
                    zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()),
                    strict=True)], ["event_id", "piece", "start", "length", "ids_crc32", "salt"])

    salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int").alias("salt")
    return (activity.select(F.col("event_id").cast("long").alias("event_id"), "text", salt)
            .mapInArrow(cut, PIECES))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) of lengths in ``counts`` whose sum is the largest
    that is at most ``room``. Bit s of the set says that sum s can be reached;
    longer lengths enter first and are preferred."""
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:  # powers of two: any number of times up to the count
            size = min(size, left)
            grown = (reach | reach << length * size) & limit
            if grown != reach:
                steps.append((length, size, reach))
                reach = grown
            left -= size
            size *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + size
            total -= length * size
    return sorted(taken.items(), reverse=True)


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Bins for ``counts`` (length to number) as rows (length, first rank, last
    rank, first sequence, times in a bin, offset in the bin). Ranks count from
    0 within a length."""
    left = {length: n for length, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = dict(fullest({k: n for k, n in left.items() if n}, capacity - longest))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // m for k, m in combination.items())
        offset = 0
        for length, m in sorted(combination.items(), reverse=True):
            plan.append((length, used[length], used[length] + m * times - 1, sequence, m, offset))
            used[length] += m * times
            offset += m * length
            left[length] -= m * times
            if not left[length]:
                del left[length]
        sequence += times
    return plan


def _placed(pieces: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    by_length: dict[int, list[tuple]] = {}
    for row in sorted(plan):
        by_length.setdefault(row[0], []).append(row)
    firsts = {length: [row[1] for row in rows] for length, rows in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                _, first, _, base, m, offset = by_length[length][bisect.bisect_right(firsts[length], rank) - 1]
                sequences.append(base + (rank - first) // m)
                offsets.append(offset + (rank - first) % m * length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                ["event_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.select("event_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)


def pack_best_fit(activity: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack every event's token ids into sequences of at most ``capacity`` ids.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Returns one row per piece: ``event_id, piece, start`` (ids of the event
    before it), ``length, ids_crc32`` (of the ids as unsigned little-endian
    32-bit numbers), ``sequence_id`` and ``offset`` (gapless from 0 within a
    sequence). Only events of more than ``capacity`` ids are cut. A null or
    empty text is ``end_id`` alone; rows with a null or repeated ``event_id``
    are packed each; an empty table gives no rows. What the driver holds is the
    histogram of at most ``capacity`` lengths and the plan made from it.
    """
    spark: SparkSession = activity.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.saved(token_pieces(activity, tokenizer_path, end_id, capacity), "pieces")
    tallies = work.saved(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Ranks within a length: a salted part's base is the sum of the parts before it, at most SALTS for each length.
    before = (tallies.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("salt", "n"))).alias("parts"))
              .select("length", F.posexplode("parts").alias("at", "part"), "parts")
              .select("length", F.col("part.salt").alias("salt"),
                      F.expr("aggregate(slice(parts, 1, at), 0L, (s, p) -> s + p.n)").alias("base")))
    ranked = (pieces.join(before, ["length", "salt"])
              .withColumn("rank", F.col("base") + F.expr(
                  "row_number() over (partition by length, salt order by event_id, piece)") - 1))
    return _placed(ranked, slack_plan(counts, capacity))
