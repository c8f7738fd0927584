"""A table of bits of fixed size that tells which hashes may occur more than once, so that only their rows are made and shuffled.

Hashes that occur once but share a bit with one that does not come through, and are told apart later; so the table's size never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table: 8 MB, whatever the size of the input.
MARKS = 1 << 26


def repeated(hashes: DataFrame) -> Broadcast:
    """The table for the column h (long) of ``hashes``, by its low bits: counted over all rows, combined before the shuffle."""
    twice = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = twice.selectExpr(f"CAST((h & {MARKS - 1}) >> 6 AS INT) AS word", "shiftleft(1L, CAST(h & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(MARKS >> 6, np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def marked(table: Broadcast, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` may be repeated."""
    slot = hashes & (MARKS - 1)
    return table.value[slot >> 6] >> (slot & 63) & 1 == 1
