"""Fixed-size filter in front of a join: keeps large rows out of a shuffle.

A set of 64-bit keys becomes a bitmap of ``BITS`` bits (1 MB, whatever the
number of keys), built by a bitmap aggregate and sent to the tasks. Rows whose
bit is not set cannot match and are dropped before they are moved; the join
itself stays exact. With many keys the bitmap fills up and drops less, which
costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_PART = 32768  # bits of one bitmap of the aggregate


class Gate:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def test(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.int64).view(np.uint64) & np.uint64(BITS - 1)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gate(keys: DataFrame, col: str) -> Gate:
    """Gate of a column of longs."""
    slot = F.pmod(F.col(col), F.lit(BITS))
    rows = keys.where(F.col(col).isNotNull()).groupBy(F.floor(slot / _PART).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.pmod(slot, F.lit(_PART))).alias("bits"))
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows.collect():  # at most BITS / _PART rows of 4 KB
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[r["part"] * (_PART // 8) : r["part"] * (_PART // 8) + len(part)] = part
    return Gate(bits)


def passes(df: DataFrame, key: Column, g: Gate) -> Column:
    """Condition: the bit of the key is set."""
    shared = df.sparkSession.sparkContext.broadcast(g.bits)

    @F.pandas_udf("boolean")
    def test(k):
        return pd.Series(Gate(shared.value).test(k.to_numpy()))

    return test(key)
