"""Which 64-bit prints occur often, as bit tables of a fixed size.

Prints are cut into hash blocks by their leading bits; a block's prints are
counted by their next 32 bits, and a bit is set for each that reaches a count. The tables' size is a
parameter and does not grow with the input. Where prints share a bit, a rare
print may pass for a frequent one, never the other way round: users of the
tables must stay right in that case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from hindcast.llm.stored import blocks

BITS = 26

Prints = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]
FLUSH_PRINTS = 1 << 20


class FrequentBits:
    """Bit tables, one for each count in ``least``; pass ``has`` a position in ``least`` and prints."""

    def __init__(self, tables: list[np.ndarray], bits: int):
        self.tables, self.bits = tables, bits

    def has(self, which: int, prints: np.ndarray) -> np.ndarray:
        slot = prints >> np.uint64(64 - self.bits)
        return (self.tables[which][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent_bits(df: DataFrame, prints: Prints, least: list[int], bits: int = BITS) -> FrequentBits:
    """Count the prints that ``prints`` makes of ``df``'s batches.

    A block is counted in one task and holds its share of all prints as plain
    32-bit numbers; the number of blocks follows the shuffle partitions.
    """
    n_blocks = min(blocks(df.sparkSession), 1 << bits - 6)
    lead = n_blocks.bit_length() - 1
    width = (1 << bits) // n_blocks

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.sort(np.concatenate(held))
        cuts = np.searchsorted(found, np.arange(n_blocks, dtype=np.uint64) << np.uint64(64 - lead))
        cuts = np.append(cuts, len(found)).tolist()
        found = (found >> np.uint64(32 - lead)).astype(np.uint32)
        rows = [(b, found[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.binary())], ["block", "prints"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in prints(batches):
            held.append(found)
            size += len(found)
            if size >= FLUSH_PRINTS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        found = np.sort(np.concatenate([np.frombuffer(p, np.uint32) for p in group["prints"]]))
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        times = np.diff(np.append(first, len(found)))
        out = []
        for n in least:
            slots = found[first[times >= n]] >> np.uint32(32 + lead - bits)
            table = np.zeros(width, np.uint8)
            table[slots] = 1
            out.append(np.packbits(table, bitorder="little").tobytes())
        return pd.DataFrame({"block": [block], "tables": [out]})

    slices = (df.mapInArrow(dealt, "block int, prints binary").groupBy("block")
              .applyInPandas(counted, "block int, tables array<binary>"))
    tables = [np.zeros((1 << bits) // 8, np.uint8) for _ in least]
    for row in slices.toLocalIterator():
        for table, part in zip(tables, row["tables"], strict=True):
            table[row["block"] * width // 8:(row["block"] + 1) * width // 8] = np.frombuffer(part, np.uint8)
    return FrequentBits(tables, bits)
