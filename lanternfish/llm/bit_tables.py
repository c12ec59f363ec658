"""Bit tables of bounded size: which names may be in a set. A set too large for the table only means more false answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a name; a table has 16 bits a name, from 2^20 to 2^30 (128 MB) in all.
NAME_BITS, FEWEST_BITS = 30, 20


def name_of(hashed: Column) -> Column:
    """Name of a 64-bit hash."""
    return F.shiftrightunsigned(hashed, 64 - NAME_BITS)


def bit_table(names: DataFrame) -> tuple[bytes, int]:
    """Table of the names in `id`, and its size as a power of two."""
    bits = min(max(FEWEST_BITS, (16 * names.count()).bit_length()), NAME_BITS)
    place = F.shiftright("id", NAME_BITS - bits) + 1  # buckets and positions count from one
    chunks = names.groupBy(F.bitmap_bucket_number(place).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in chunks.collect():  # the table has a bounded size
        chunk = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["chunk"] - 1) * len(chunk) :][: len(chunk)] = chunk
    return out.tobytes(), bits


def may_be_in(table: np.ndarray, bits: int, names: np.ndarray) -> np.ndarray:
    """For each name (uint64) whether it may be in the set; table: bytes."""
    place = names >> np.uint64(NAME_BITS - bits)
    return ((table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1) == 1
