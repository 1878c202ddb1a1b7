"""Bit tables of bounded size: they thin out what is shuffled and never decide a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import U64


def bit_table(rows: DataFrame, hashed: Column, most_bits: int = 24) -> tuple[int, np.ndarray]:
    """Marks two bits for a 64-bit hash of each row: its upper bits and its lower bits name them.

    There are 256 bits for each row, but at most 2**most_bits in all, whatever the number of rows, so what reaches the driver is
    bounded; a fuller table only lets more rows pass.
    """
    n = rows.count()
    bits = min(most_bits, max(16, (256 * n).bit_length()))
    two = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    slots = rows.select(hashed.alias("h")).select(F.explode(two).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("v"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for word, v in words.collect():
        table[word] = v
    return bits, table.view(U64)


def marked(table: np.ndarray, bits: int, hashed: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the table."""
    out = np.ones(len(hashed), bool)
    for slot in (hashed >> U64(64 - bits), hashed & U64((1 << bits) - 1)):
        out &= (table[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
    return out
