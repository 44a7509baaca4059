"""Deterministic hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the multipliers of MurmurHash3's 32-bit finaliser
M1, M2 = 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _times(h: Column, m: int) -> Column:
    """h * m modulo 2**32 without overflowing 64 bits: the factor is taken in halves."""
    low, high = h * F.lit(m & 0xFFFF), (h * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + high * F.lit(65_536)).bitwiseAND(F.lit(MASK).cast("long"))


def mix(c: Column) -> Column:
    """Spreads the bits of a whole number below 2**32 (MurmurHash3's last step)."""
    h = c.cast("long").bitwiseAND(F.lit(MASK).cast("long"))
    h = _times(h.bitwiseXOR(F.shiftright(h, 16)), M1)
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)), M2)
    return h.bitwiseXOR(F.shiftright(h, 16))
