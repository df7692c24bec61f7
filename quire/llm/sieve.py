"""Bounded bit tables that tell cheaply which rows cannot matter.

A table has a fixed number of bits, whatever the data, so it may be sent to
every task. A key that was put in is always found; another key is sometimes
found too, so what passes still has to be checked exactly. With more keys the
table only lets more rows through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table (4 MB).
BITS = 1 << 25


def bits_of(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bit table, as bytes, of a column of longs, well spread hashes; ``bits`` is a power of two, 2 ** 32 at most.
    Each key sets two bits, by its low and its high half. Nulls are left out."""
    halves = F.array(*[F.expr(f"{half} & {bits - 1}L") for half in (column, f"shiftrightunsigned({column}, 32)")])
    words = (keys.where(F.col(column).isNotNull()).select(F.explode(halves).alias("at"))
             .select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bit"].to_numpy()
    return table.view(np.uint8)


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (64-bit integers) may be in the table."""
    keys, last = keys.view(np.uint64), np.uint64(8 * len(table) - 1)
    out = np.ones(len(keys), bool)
    for at in (keys & last, (keys >> np.uint64(32)) & last):
        byte = table[(at >> np.uint64(3)).astype(np.int64)]
        out &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return out
