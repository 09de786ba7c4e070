"""Token counts of whole texts by a piece model.

The piece model never merges across the start of a space run, so a text is the
sum of its pieces: each run of spaces with the characters up to the next
space. Texts of any length are cut there, the distinct pieces of a batch are
encoded together in groups of bounded bytes, and only lengths leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 1 << 20
MEMO_PIECES, MEMO_CHARS = 200_000, 64
MARK = "▁"  # the model's own sign for a space
_PIECE = re.compile(" +[^ ]*")

COUNTS = "event_id long, n_bytes long, n_tokens long, over_limit boolean"


def pieces(text: str) -> list[str]:
    """``text`` cut before every run of spaces, as the model is to be given each
    part: without the one space that the model itself puts in front."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [found[1:] for found in _PIECE.findall(" " + text)]


def balanced(parts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """``parts`` in groups of about ``size`` characters each."""
    group, held = [], 0
    for part in parts:
        group.append(part)
        held += len(part)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


class PieceCounter:
    """Token counts of texts; remembers the lengths of some ``MEMO_PIECES`` pieces of up to ``MEMO_CHARS`` characters."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        # A lone space after text: the model adds its own in front only of what is not empty.
        self.lengths: dict[str, int] = {"": 1}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) if t else [] for t in texts]
        if len(self.lengths) > MEMO_PIECES:
            self.lengths = {"": 1}
        fresh: set[str] = set()
        for parts in cut:
            fresh.update(parts)
        fresh -= self.lengths.keys()
        for group in balanced(list(fresh)):
            self.lengths.update(zip(group, map(len, self.model.encode(group, num_threads=1)), strict=True))
        lengths = self.lengths
        counts = [sum(map(lengths.__getitem__, parts)) for parts in cut]
        for part in fresh:
            if len(part) > MEMO_CHARS:
                del lengths[part]
        return counts


def count_tokens(activity: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Token count of every event's whole text.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Returns ``event_id, n_bytes`` (UTF-8), ``n_tokens`` (no begin, end or added
    tokens; nothing cut) and ``over_limit`` (more than ``limit`` tokens), one
    row per input row. A null or empty text has 0 bytes and 0 tokens; a null
    ``event_id`` is kept; repeated rows are counted each; an empty table gives
    no rows. ``model_path`` must be readable on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, n = [len(t.encode()) for t in texts], counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([k > limit for k in n], pa.bool_())], ["event_id", "n_bytes", "n_tokens", "over_limit"])

    return activity.selectExpr("cast(event_id as long) event_id", "text").mapInArrow(count, COUNTS)
