"""A bitmap of hashed ids: a bounded filter that lets a scan skip rows which no later join wants.

It has at most 2**MOST_BITS bits (8 MB) however many ids there are; when it fills up it lets more rows through, and the
join that follows is exact either way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26
FEW_BITS = 21  # up to here (256 KB) an id gets 1,024 bits in place of 64, so that few ids let hardly any other row through
BUCKET = 1 << 15  # bits of one bitmap value


def build(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of all values of a BIGINT column, as a boolean array of a power of two."""
    n = ids.agg(F.approx_count_distinct(column)).first()[0]
    bits = max(15, min(FEW_BITS, int(1024 * max(n, 1)).bit_length()), min(MOST_BITS, int(64 * max(n, 1)).bit_length()))
    at = F.pmod(_hash(F.col(column)), F.lit(1 << bits))
    parts = ids.groupBy(F.floor(at / BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BUCKET))).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():  # 2**MOST_BITS / BUCKET rows of 4 KB at most
        out[r["b"] * BUCKET // 8 : (r["b"] + 1) * BUCKET // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _hash(c):
    """Bits 20 to 61 of the id times a constant, in unsigned arithmetic that SQL can do without overflow."""
    low = c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(c, 32).bitwiseAND(F.lit(0xFFFFFFFF))
    mixed = low * F.lit(0x1E3779B1) + high * F.lit(0x05EBCA6B)
    return F.shiftright(mixed, 7).bitwiseXOR(mixed)


def contains(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the bitmap."""
    low, high = ids & 0xFFFFFFFF, (ids >> 32) & 0xFFFFFFFF
    mixed = low * 0x1E3779B1 + high * 0x05EBCA6B
    at = ((mixed >> 7) ^ mixed) % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
