"""Exact BPE encoding of texts of any length by tree concatenation, and decoding.

A text of up to ``LEAF_CHARS`` characters is encoded word by word. A longer one
is halved until its leaves are that short, wherever the cuts fall, and the
leaves are encoded in parallel. A task then joins a text's leaves in the order of the
tree. At a join only a window around the cut is encoded again. It grows until
on each side one token is the same, with the same place, in the window's
encoding and in the half's own. Up to that token the left half stands, from
there the window, and from the right one on the right half. So a leaf is sent
on as bare ids but for its two edges of ``EDGE_CHARS``, which keep their text
and the tokens' places. A text where a window would outgrow an edge (one
character repeated without end does that) is encoded whole.

Why this is exact: words are found by a scan that looks only forward, so two
scans that both end a word at one place go on alike; inside a long run both
lie in the same word. Within a word, a token sequence is the encoding exactly
if each two neighbours are the encoding of their joint text, and every two
neighbours of the result are neighbours in a half's or in the window's
encoding. Tokens within ``MARGIN`` characters of a cut, and places where a
character could compose with the one before, are not trusted.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hindcast.llm.packing import Encoder
from hindcast.llm.stored import Workspace

LEAF_CHARS = 16_384
EDGE_CHARS = 512
WINDOW_CHARS = 128  # at first, on each side of a cut
MARGIN = 16  # more than the longest special string and the longest contraction
GROUP_BYTES = 4 << 20  # of whole texts' ids at once; in memory some ten times as much
CONTRACTION = 3  # characters; a longer word is a run of one kind of character

PARTS = "event_id long, digest string, copies long, leaves int, leaf int, text string"
EDGE = "struct<text: string, ids: binary, starts: binary, ends: binary, first: binary>"
NODES = f"event_id long, digest string, copies long, leaves int, leaf int, head {EDGE}, middle binary, tail {EDGE}"
TREES = "event_id long, digest string, copies long, ids array<int>"
ENCODED = "event_id long, ids array<int>, decoded string"

_tokenizers: dict[str, object] = {}


def tokenizer_of(path: str):
    """The tokenizer of this Python worker, single-threaded as Spark gives each task one core."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.no_truncation()
        held.no_padding()
        _tokenizers[path] = held
    return _tokenizers[path]


@dataclass
class Tokens:
    """An encoding: ids, the characters [start, end) of each and whether it is the first of a word."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(tokenizer, text: str) -> Tokens:
        found = tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, np.int32).reshape(-1, 2)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        first = np.ones(len(words), bool)
        first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return Tokens(np.array(found.ids, np.int32), spans[:, 0], spans[:, 1], first)

    def part(self, lo: int, hi: int, shift: int = 0) -> Tokens:
        return Tokens(self.ids[lo:hi], self.starts[lo:hi] + np.int32(shift), self.ends[lo:hi] + np.int32(shift),
                      self.first[lo:hi])

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: ends its word; lies in a word too long for a contraction; covers whole characters."""
        n = len(self.ids)
        last = np.ones(n, bool)
        last[:-1] = self.first[1:]
        opens = self.first.copy()
        opens[:1] = True  # a part may begin within a word, of which it then sees less
        begin, end = np.flatnonzero(opens), np.flatnonzero(last)
        long = np.repeat(self.ends[end] - self.starts[begin] > CONTRACTION, end - begin + 1)
        whole = np.ones(n, bool)
        whole[1:] &= self.ends[:-1] <= self.starts[1:]
        whole[:-1] &= self.starts[1:] >= self.ends[:-1]
        return last, long, whole


def word_ids(encoder: Encoder, text: str) -> np.ndarray:
    """Ids of a text that is cut at its blanks and line ends."""
    return np.frombuffer(encoder.encode(text), np.int32)


def _joined(*parts: Tokens) -> Tokens:
    return Tokens(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "starts", "ends", "first")))


def parts_here(ch: str) -> bool:
    """Whether normalisation never moves or joins anything across the front of ``ch``."""
    return ch.isascii() or not (unicodedata.combining(ch) or unicodedata.category(ch).startswith("M")
                                or "ᄀ" <= ch <= "ᇿ" or "\U00016d40" <= ch <= "\U00016d7f")


def _common(one: Tokens, two: Tokens) -> list[tuple[int, int]]:
    """Indices of the tokens that both have, whole characters in each."""
    whole_one, whole_two = one.marks()[2], two.marks()[2]
    there = {key: k for k, key in enumerate(zip(two.ids.tolist(), two.starts.tolist(), two.ends.tolist(),
                                                strict=True)) if whole_two[k]}
    keys = zip(one.ids.tolist(), one.starts.tolist(), one.ends.tolist(), strict=True)
    return [(i, there[key]) for i, key in enumerate(keys) if whole_one[i] and key in there]


@dataclass
class Edge:
    """The text at one side of a node and the tokens that lie in it; ``whole`` if that is the node's whole text."""

    text: str
    tokens: Tokens
    whole: bool

    def packed(self) -> dict:
        t = self.tokens
        return {"text": self.text, "ids": t.ids.tobytes(), "starts": t.starts.tobytes(), "ends": t.ends.tobytes(),
                "first": t.first.tobytes()}

    @staticmethod
    def unpacked(row: dict, whole: bool) -> Edge:
        return Edge(row["text"], Tokens(*(np.frombuffer(row[name], bool if name == "first" else np.int32)
                                          for name in ("ids", "starts", "ends", "first"))), whole)


@dataclass
class Node:
    """The encoding of a part of a text: two edges and the ids between them. A short one has one edge only."""

    head: Edge
    middle: list[np.ndarray]
    tail: Edge | None

    @staticmethod
    def of(text: str, tokens: Tokens) -> Node:
        if len(text) <= 2 * EDGE_CHARS:
            return Node(Edge(text, tokens, True), [], None)
        a = int(np.searchsorted(tokens.ends, EDGE_CHARS, side="right"))
        at = len(text) - EDGE_CHARS
        b = max(a, int(np.searchsorted(tokens.starts, at)))
        return Node(Edge(text[:EDGE_CHARS], tokens.part(0, a), False), [tokens.ids[a:b]],
                    Edge(text[at:], tokens.part(b, len(tokens.ids), -at), False))

    @staticmethod
    def leaf(encoder: Encoder, text: str) -> Node:
        """The node of a leaf. Words end at a blank, so only its edges need tokens with places."""
        i, j = text.find(" ", EDGE_CHARS), text.rfind(" ", 0, max(0, len(text) - EDGE_CHARS))
        if i < 0 or j < i:
            return Node.of(text, Tokens.of(encoder.chunks.tokenizer, text))
        head, tail = text[:i], text[j:]
        return Node(Edge(head, Tokens.of(encoder.chunks.tokenizer, head), False), [word_ids(encoder, text[i:j])],
                    Edge(tail, Tokens.of(encoder.chunks.tokenizer, tail), False))

    def ids(self) -> np.ndarray:
        return np.concatenate([self.head.tokens.ids, *self.middle, *([self.tail.tokens.ids] if self.tail else [])])


def join_nodes(tokenizer, a: Node, b: Node) -> Node | None:
    """The encoding of both texts joined; none if a window would have to reach beyond an edge."""
    left, right = a.tail or a.head, b.head
    found = join_edges(tokenizer, left, right)
    if found is None:
        return None
    if a.tail is None and b.tail is None:
        return Node.of(left.text + right.text, found)
    if a.tail is None:
        return Node(Edge(left.text + right.text, found, False), b.middle, b.tail)
    if b.tail is None:
        return Node(a.head, a.middle, Edge(left.text + right.text, found, False))
    return Node(a.head, [*a.middle, found.ids, *b.middle], b.tail)


def join_edges(tokenizer, one: Edge, two: Edge) -> Tokens | None:
    """The tokens of two edges that meet at a cut."""
    left, right = one.tokens, two.tokens
    cut, size = len(one.text), len(one.text) + len(two.text)
    right = right.part(0, len(right.ids), cut)
    reach = WINDOW_CHARS
    while True:
        lo, hi = max(0, cut - reach), min(size, cut + reach)
        if (lo == 0 and not one.whole) or (hi == size and not two.whole):
            return None
        text = one.text[lo:] + two.text[:hi - cut]
        window = Tokens.of(tokenizer, text)
        window = window.part(0, len(window.ids), lo)
        # Only the tokens of the halves inside the window are looked at.
        a = int(np.searchsorted(left.starts, lo))
        b = int(np.searchsorted(right.starts, hi))
        front, w_from = (0, 0) if lo == 0 else _left(left, a, window, text, lo, cut)
        back, w_to = (len(right.ids), len(window.ids)) if hi == size else _right(right, b, window, text, lo, cut, hi)
        if front is not None and back is not None and w_from <= w_to:
            return _joined(left.part(0, front), window.part(w_from, w_to), right.part(back, len(right.ids)))
        reach *= 2


def join_tree(tokenizer, nodes: list[Node]) -> Node | None:
    """All ``nodes`` of a text, in order, joined half by half."""
    if len(nodes) == 1:
        return nodes[0]
    half = len(nodes) // 2
    a, b = join_tree(tokenizer, nodes[:half]), join_tree(tokenizer, nodes[half:])
    return None if a is None or b is None else join_nodes(tokenizer, a, b)


def _left(left: Tokens, a: int, window: Tokens, text: str, lo: int, cut: int) -> tuple[int | None, int]:
    """How many tokens of the left half stand, and the window's first token after them."""
    near = left.part(a, len(left.ids))
    last_n, long_n, _ = near.marks()
    last_w, long_w, _ = window.marks()
    for i, j in reversed(_common(near, window)):
        end = int(window.ends[j])
        if (end <= cut - MARGIN and parts_here(text[end - lo])
                and ((last_n[i] and last_w[j]) or (long_n[i] and long_w[j]))):
            return a + i + 1, j + 1
    return None, 0


def _right(right: Tokens, b: int, window: Tokens, text: str, lo: int, cut: int, hi: int) -> tuple[int | None, int]:
    """From which token on the right half stands, and the window's end before it."""
    near = right.part(0, b)
    _, long_n, _ = near.marks()
    _, long_w, _ = window.marks()
    for i, j in _common(near, window):
        start, end = int(window.starts[j]), int(window.ends[j])
        if (cut <= start and end <= hi - MARGIN and parts_here(text[start - lo])
                and ((near.first[i] and window.first[j]) or (long_n[i] and long_w[j]))):
            return i + 1, j + 1
    return None, 0


def leaves(texts: DataFrame, leaf_chars: int) -> DataFrame:
    """``texts`` (event_id, digest, text) halved to leaves, numbered from 0; ``copies`` counts equal rows."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for event_id, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = 1 << max(0, (-(-len(text) // leaf_chars) - 1).bit_length())
                cuts = [k * len(text) // count for k in range(count + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([event_id] * count, pa.int64()), pa.array([digest] * count, pa.string()),
                     pa.array([1] * count, pa.int64()), pa.array([count] * count, pa.int32()),
                     pa.array(range(count), pa.int32()), pa.array([text[i:j] for i, j in pairwise(cuts)], pa.string())],
                    ["event_id", "digest", "copies", "leaves", "leaf", "text"])

    return (texts.select("event_id", "digest", "text").mapInArrow(halve, PARTS)
            .groupBy("event_id", "digest", "leaves", "leaf")
            .agg(F.sum("copies").alias("copies"), F.any_value("text").alias("text")))


def encode_trees(texts: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(event_id, digest, copies, ids) of ``texts`` (event_id, digest, text); no
    ids where a window outgrew an edge. Leaves are spread over all tasks; then
    one text's nodes, mostly bare ids, meet in one task, as its row does."""
    edge = pa.struct([("text", pa.string()), *((n, pa.binary()) for n in ("ids", "starts", "ends", "first"))])
    own = ["event_id", "digest", "copies", "leaves", "leaf"]

    def narrow(tokenizer) -> type:
        return np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.int32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, encoder = tokenizer_of(tokenizer_path), Encoder.of(tokenizer_path)
        for batch in batches:
            nodes = [Node.leaf(encoder, text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in own), pa.array([n.head.packed() for n in nodes], edge),
                 pa.array([np.concatenate([*n.middle, []]).astype(narrow(tokenizer)).tobytes() for n in nodes], pa.binary()),
                 pa.array([n.tail and n.tail.packed() for n in nodes], edge)], [*own, "head", "middle", "tail"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, held = tokenizer_of(tokenizer_path), []
        for batch in batches:
            for row in batch.to_pylist():
                tail = row["tail"] and Edge.unpacked(row["tail"], False)
                held.append(Node(Edge.unpacked(row["head"], tail is None),
                                 [np.frombuffer(row["middle"], narrow(tokenizer))], tail))
                if len(held) == row["leaves"]:
                    whole, held = join_tree(tokenizer, held), []
                    ids = None if whole is None else whole.ids().astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["event_id"]], pa.int64()), pa.array([row["digest"]]),
                         pa.array([row["copies"]], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                        ["event_id", "digest", "copies", "ids"])

    order = ["event_id", "digest", "leaf"]
    return (leaves(texts, leaf_chars).select(*own, "text").mapInArrow(encode, NODES)
            .repartition("event_id", "digest").sortWithinPartitions(*order).mapInArrow(join, TREES))


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))


def encode_texts(activity: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS,
                 decode: bool = False) -> DataFrame:
    """Token ids of every event's whole text, as the tokenizer gives them without added special tokens.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Returns ``event_id`` and ``ids`` (array of int), and with ``decode`` also
    ``decoded``, the text that the ids decode to (see :func:`decoded`), one
    row per input row. A text of more than ``leaf_chars`` characters is
    encoded by tree concatenation; the result does not depend on
    ``leaf_chars``. Special strings inside texts become their ids, as is the
    tokenizer's default. A null or empty text has no ids (an empty array); a
    null ``event_id`` is kept; repeated rows are encoded each; an empty table
    gives no rows. ``tokenizer_path`` must be readable on every executor, its
    words must be found by a forward scan as in ``word_bpe_49k.json``. A long
    text takes about 6 bytes a character in the task that joins its leaves.
    """
    work = Workspace(activity.sparkSession, "bpe-trees")
    rows = activity.select(F.col("event_id").cast("long").alias("event_id"), F.coalesce("text", F.lit("")).alias("text"))
    columns = ["event_id", "ids", "decoded"] if decode else ["event_id", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            ids = [word_ids(encoder, text) for text in batch.column(1).to_pylist()]
            texts = [_decode(tokenizer_of(tokenizer_path), k) if decode else None for k in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(ids), pa.array(texts, pa.string())],
                                             ["event_id", "ids", "decoded"])

    short = rows.filter(F.length("text") <= leaf_chars).mapInArrow(encode, ENCODED).select(*columns)
    long = rows.filter(F.length("text") > leaf_chars).withColumn("digest", F.sha2("text", 256))
    trees = work.saved(encode_trees(long, tokenizer_path, leaf_chars), "trees", GROUP_BYTES)
    joined = trees.filter(F.col("ids").isNotNull())
    if decode:
        joined = joined.withColumn("decoded", decoded(F.col("ids"), tokenizer_path))
    found = short.unionByName(joined.select(*columns, F.explode(F.sequence(F.lit(1), "copies"))).select(*columns))
    outgrown = trees.filter(F.col("ids").isNull()).select(F.col("event_id").alias("_event"), F.col("digest").alias("_digest"))
    if outgrown.isEmpty():
        return found
    rest = long.join(outgrown, F.col("event_id").eqNullSafe(F.col("_event")) & (F.col("digest") == F.col("_digest")),
                     "left_semi").select("event_id", "text")
    return found.unionByName(rest.mapInArrow(encode, ENCODED).select(*columns))


def _decode(tokenizer, ids: np.ndarray) -> str:
    return tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def decoded(ids: Column, tokenizer_path: str) -> Column:
    """The text that the tokenizer decodes an array of ids to, special tokens included; null stays null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        tokenizer, values = tokenizer_of(tokenizer_path), column.values.to_numpy()
        rows = zip(pairwise(column.offsets.to_pylist()), column.is_valid().to_pylist(), strict=True)
        return pa.array([_decode(tokenizer, values[a:b]) if valid else None for (a, b), valid in rows], pa.string())

    return decode(ids)
