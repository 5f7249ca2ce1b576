"""Shards by jump consistent hashing, in DataFrame functions only.

The published algorithm: a 64-bit linear congruential generator seeded with the
key gives the jumps ``j = floor((b + 1) * 2^31 / (state >> 33 + 1))`` until the
jump leaves the number of shards; the last ``b`` is the shard. No ring table is
kept, and with one more shard a key either stays or moves into the new one.

The generator works modulo 2^64. ANSI arithmetic raises on overflow, so the state
is held as two 32-bit halves in longs and multiplied by 16-bit digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import materialise

#: Multiplier of the generator in the published algorithm (a fixed value).
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF


def _times(value: Column, constant: int) -> tuple[Column, Column]:
    """A 32-bit ``value`` times a 32-bit constant: low 32 bits, and what carries above them."""
    low, high = constant & 0xFFFF, constant >> 16
    by_high = value * F.lit(high)
    total = value * F.lit(low) + F.shiftleft(by_high.bitwiseAND(F.lit(0xFFFF)), 16)
    return total.bitwiseAND(F.lit(LOW32)), F.shiftright(total, 32) + F.shiftright(by_high, 16)


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, on 32-bit halves."""
    low, carry = _times(lo, MULTIPLIER & LOW32)
    low = low + F.lit(1)
    high = (
        carry
        + F.shiftright(low, 32)
        + _times(hi, MULTIPLIER & LOW32)[0]
        + _times(lo, MULTIPLIER >> 32)[0]
    )
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(state: Column, _: Column) -> Column:
        # the state is advanced in two steps, so that each part is worked out once
        hi, lo = _step(state["hi"], state["lo"])
        bound = F.shiftright(hi, 1) + F.lit(1)  # the state's upper 31 bits, plus 1
        ahead = F.floor((state["j"] + F.lit(1)).cast("double") * F.lit(float(1 << 31)) / bound.cast("double"))
        return F.when(
            state["j"] < F.lit(shards),
            F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), ahead.cast("long").alias("j")),
        ).otherwise(state)

    # j grows with each jump, by about a factor of e: few keys go on after these, none beyond one step a shard
    few = min(shards, 8 + 3 * math.ceil(math.log(shards + 1)))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, jump)
    if few == shards:
        return state["b"].cast("int")
    rest = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(shards - few)), s, jump)
    done = F.transform(F.array(state), lambda s: F.when(s["j"] < shards, rest(s)).otherwise(s))
    return F.get(done, F.lit(0))["b"].cast("int")


def assign_shards(
    df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns ``keep``.

    size is the text's UTF-8 bytes plus 1 and text_crc32 the unsigned CRC-32 of
    them; a null text counts as empty. shard depends on doc_id and the number
    of shards only (law ``key``); grown_shard is the shard among one more. A
    null doc_id counts as 0. slot numbers the rows of a shard from 0 without
    gaps, in input order: repeated rows get slots of their own. An empty table
    gives no rows. Other columns are ignored.

    Slots need no gathering of a shard: rows are numbered inside (input split,
    shard) groups, and each group starts where the shard's earlier groups end.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.col(f"`{doc_id}`")
    rows = df.select(
        key.alias("doc_id"),
        (F.octet_length(content).cast("long") + F.lit(1)).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("__at"),
        *[F.col(f"`{c}`") for c in keep],
    )
    # written, so that the order of rows is fixed before it is counted
    rows = materialise(rows, "shards").withColumn("__split", F.shiftright("__at", 33))
    counts = rows.groupBy("shard", "__split").agg(F.count("*").alias("n"))
    starts = materialise(
        counts.selectExpr(
            "shard",
            "__split",
            """coalesce(sum(n) over (partition by shard order by __split
               rows between unbounded preceding and 1 preceding), 0) as start""",
        ),
        "shard-starts",
    )
    numbered = rows.selectExpr("*", "row_number() over (partition by shard, __split order by __at) - 1 as __nth")
    return numbered.join(starts.hint("merge"), ["shard", "__split"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("__nth")).cast("long").alias("slot"),
        "grown_shard",
        *[F.col(f"`{c}`") for c in keep],
    )
