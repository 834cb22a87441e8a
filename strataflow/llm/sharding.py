"""Jump consistent hashing of stable keys to shards [native].

``jump_hash`` unrolls the jump loop as one Catalyst ``aggregate`` over 64-bit linear congruential
steps. ANSI mode forbids wrapping multiplication, so the state is kept as two 32-bit limbs, and no
intermediate value passes 2**50. Rows with one key always meet in one shard; with one more shard a
row either stays or moves into the new one.

Nulls: a null key counts as key 0, a null text has 0 bytes. Repeated rows get one shard and slots of
their own. An empty table gives an empty result. Columns of the input other than the key and the
text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The generator's multiplier, as 32-bit halves (high; low in 16-bit halves).
MULTIPLIER = 2862933555777941757
M_HIGH, M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
M_LOW_1, M_LOW_0 = M_LOW >> 16, M_LOW & 0xFFFF
LOW32 = 0xFFFFFFFF


def _low32(product_high: Column) -> Column:
    return product_high.bitwiseAND(F.lit(LOW32).cast("long"))


def _times16(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, for x below 2**32."""
    high, low = factor >> 16, factor & 0xFFFF
    return _low32(x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16))


def _step(s: Column) -> Column:
    hi, lo = s["hi"], s["lo"]
    a, b = lo * F.lit(M_LOW_0), lo * F.lit(M_LOW_1)
    low = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(b, 16) + _times16(hi, M_LOW) + _times16(lo, M_HIGH)
    return F.struct(_low32(high).alias("hi"), _low32(low).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a BIGINT key, 0 to ``shards`` - 1 (int)."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        zero.alias("j"),
        _low32(F.shiftright(k, 32)).alias("hi"),
        _low32(k).alias("lo"),
    )

    def jump(s: Column, _: Column) -> Column:
        # transform over one element names the next state, so that it is computed once
        moved = F.transform(F.array(_step(s)), lambda n: F.struct(
            s["j"].alias("b"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(n["hi"], 1) + 1).cast("double"))).cast("long").alias("j"),
            n["hi"].alias("hi"),
            n["lo"].alias("lo"),
        ))[0]
        return F.when(s["j"] < shards, moved).otherwise(s)

    # every jump moves at least one shard ahead, so ``shards`` rounds always suffice
    rounds = F.sequence(F.lit(1), F.lit(int(shards)))
    return F.aggregate(rounds, start, jump, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", chunks: int = 1024) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots number the rows of a shard from 0 without gaps. They come from counts by (shard, chunk of
    the key's hash), at most (shards x chunks) rows whatever the input, and a row number within the
    chunk, so no task sees a whole shard. Only narrow rows are shuffled, never the text.
    """
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(utf8) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int").alias("_chunk"),
    )
    places = docs.select(jump_hash(F.col(key), shards).alias("shard"), F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int").alias("_chunk"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = places.groupBy("shard", "_chunk").count().select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_chunk").orderBy(key, "size", "text_crc32")
    return (
        rows.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_chunk"])  # at most shards x chunks rows
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard")
    )
