"""A bit table of 64-bit numbers that the driver sends out, of a bounded size.

It holds every number it was made of and, by chance, some others: what it lets
through is to be joined exactly.  No numbers give a table that holds nothing;
repeated ones count once; a null is not held.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table

BITS = 20, 28  #: address bits: the fewest, and the most (32 MB)


class Bloom:
    """Bits of (node), 16 a node or as many as fit; a filter that is full lets more through, never less."""

    def __init__(self, nodes: DataFrame):
        nodes = table(nodes, "live")
        self.bits = min(max((16 * nodes.count()).bit_length(), BITS[0]), BITS[1])
        top = (1 << self.bits) - 1
        at = F.explode(F.array(F.col("node").bitwiseAND(F.lit(top)), F.shiftrightunsigned("node", self.bits).bitwiseAND(F.lit(top))))
        bits = nodes.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)

    def holds(self, node: np.ndarray) -> np.ndarray:
        x, top = node.view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = np.ones(len(x), bool)
        for at in (x & top, (x >> np.uint64(self.bits)) & top):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out
