"""64-bit image hashes kept as two 32-bit halves in BIGINT columns ``hash_hi`` and ``hash_lo``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Bits that differ between two hashes; null when either is missing."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def packed(hi: Column, lo: Column) -> Column:
    """Both halves in one BIGINT; plain numbers keep grouped steps in hash tables, where structs would make them sort."""
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def unpacked(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def median_bits(values: Column) -> Column:
    """Hash of 64 numbers as a struct of both halves: bit i is set when number i exceeds the 32nd smallest."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def half(start: int, cut: Column) -> Column:
        bits = F.transform(F.slice(values, start, 32), lambda x, i: F.when(x > cut, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, b: a + b)

    # the cut is bound once per row, not looked up again for each number
    cut = F.array(F.element_at(F.sort_array(values), 32))
    return F.get(F.transform(cut, lambda c: F.struct(half(1, c).alias("hash_hi"), half(33, c).alias("hash_lo"))), F.lit(0))
