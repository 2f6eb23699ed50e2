"""A filter of a fixed size over 64-bit keys: rows it lets go can't have a key, so only the others need a shuffle.

A key is one bit of 2^25. The bits are rows of 4 KB, 1,024 at most, so the table is broadcast whatever the number of keys;
with very many keys it lets more rows through and is never wrong about those it stops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a row (fixed by bitmap_construct_agg) and rows, as powers of two.
ROW_BITS, ROWS = 15, 10


def _place(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 64 - ROWS) + (1 << ROWS - 1), key.bitwiseAND((1 << ROW_BITS) - 1)


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """(row, bits) of the keys, a long column; null keys have no bit."""
    row, bit = _place(F.col(key))
    return keys.filter(F.col(key).isNotNull()).select(row.alias("_bits_row"), bit.alias("_bit")).distinct().groupBy("_bits_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def flagged(rows: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """The rows with a boolean column that is false only if no key of the filter equals theirs."""
    row, bit = _place(F.col(key))
    joined = rows.join(F.broadcast(bits), row == F.col("_bits_row"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(7))) % 2 == 1
    return joined.withColumn(flag, F.coalesce(held, F.lit(False))).drop("_bits_row", "_bits")


def bit_table(bits: DataFrame) -> np.ndarray:
    """The filter's bytes for tasks that use numpy; of a fixed size, whatever the number of keys."""
    table = np.zeros((1 << ROWS, 1 << ROW_BITS - 3), np.uint8)
    for row in bits.collect():
        table[row["_bits_row"]] = np.frombuffer(row["_bits"], np.uint8)
    return table.ravel()


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the keys (int64); false is certain."""
    row, bit = (keys >> (64 - ROWS)) + (1 << ROWS - 1), keys & ((1 << ROW_BITS) - 1)
    at = (row << ROW_BITS) + bit
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
