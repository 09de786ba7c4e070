"""Numpy helpers over Arrow text columns: byte slices, word spans and rolling hashes.

Everything works on the UTF-8 buffer of a batch, a few megabytes at a time, so
no Python object per word or per shingle is made. A slice always holds whole
texts; one text longer than the slice size is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# The separators \x09-\x0D and \x20.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, size: int) -> np.ndarray:
    """``base`` to the powers 0 .. size - 1, modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < size:
        held = np.full(max(size, SLICE_BYTES + 1), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) <= 4 * SLICE_BYTES:
            _powers[base] = held
    return held[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Slice:
    """Texts ``lo`` .. ``hi`` of a batch: their bytes joined, and where each begins (one more entry: the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow column in slices of about ``size`` bytes; null is the empty text."""
    text = pc.fill_null(column, "").cast(pa.large_binary())
    _, where, held = text.buffers()
    offsets = np.frombuffer(where, np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hashes: any substring's hash follows from two of them (``span_hashes``)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=out[1:])
    return out


def span_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end)."""
    return mix((running[ends] - running[starts]) * _power(_UNBASE, len(running))[starts])


def window_hashes(running: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every byte window of ``width``."""
    n = len(running) - width
    return mix((running[width:] - running[:-width]) * _power(_UNBASE, n)) if n > 0 else np.zeros(0, np.uint64)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; a run never leaves its text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (edge[:-1] | ~before)), np.flatnonzero(inside & (edge[1:] | ~after)) + 1


@dataclass
class Words:
    """Word hashes of a slice, in order; text i of the slice has words ``bounds[i]`` .. ``bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray


def words(part: Slice) -> Words:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    data = LOWER[part.data]
    starts, ends = spans(~SEPARATOR[data], part.offsets)
    return Words(span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, part.offsets))


# Letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(part: Slice) -> Words:
    """Hashes of the runs of letters and digits with A-Z lower-cased; punctuation only separates."""
    data = LOWER[part.data]
    starts, ends = spans(ALNUM[data], part.offsets)
    return Words(span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, part.offsets))


def word_shingles(found: Words, width: int) -> list[np.ndarray]:
    """Per text the hashes of its word n-grams, with repeats and in order; a
    shorter text is one n-gram as a whole, a text without words has none."""
    h, bounds = found.hashes, found.bounds
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(BASE) + h[k:k + len(rolled)]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(rolled[lo:hi - width + 1])
        elif hi > lo:
            short = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                short = short * np.uint64(BASE) + h[k:k + 1]
            out.append(mix(short + np.uint64(hi - lo)))
        else:
            out.append(h[:0])
    return out
