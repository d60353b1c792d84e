"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard is the last jump of a 64-bit linear congruential sequence below the number of shards; there is no ring
table, and with one more shard a key either stays or goes to the new one.

Defined cases: a null key counts as key 0; keys are taken as unsigned 64-bit numbers, other types by xxhash64; repeated
rows share a shard and get slots of their own; a null text weighs nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import settle

# Fixed values of the published method: the multiplier of its generator, the modulus, and the span of a draw.
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64
DRAW = 1 << 31


def _state(key: str, shards: int, steps: int) -> str:
    """SQL for the state after at most `steps` jumps: s (generator), b (last shard), j (next jump)."""
    grown = f"cast((cast(z.s as decimal(20,0)) * {MULTIPLIER}BD + 1BD) % {MODULUS}BD as decimal(20,0))"
    jump = f"cast(floor((z.j + 1) * ({float(DRAW)}D / cast((z.g div {1 << 33}BD) + 1 as double))) as bigint)"
    # The jump needs the new generator state, so each step is two lets: grow, then jump.
    step = (
        f"if(a.j >= {shards}L, a, transform(transform(array(a), z -> named_struct('j', z.j, 'g', {grown})), z -> "
        f"named_struct('s', z.g, 'b', z.j, 'j', {jump}))[0])"
    )
    first = f"named_struct('s', {key}, 'b', -1L, 'j', 0L)"
    return f"aggregate(sequence(1, {steps}), {first}, (a, i) -> {step})"


def jump_shard(key: str, shards: int) -> str:
    """SQL for the shard of the decimal(20,0) column `key`.

    Nearly all keys end within a few jumps; the rare others go on to the bound that holds for every key.
    """
    steps = min(shards, int(3 * math.log(shards + 1)) + 8)
    short, whole = _state(key, shards, steps), _state(key, shards, shards)
    return f"transform(array({short}), r -> if(r.j >= {shards}L, r.b, {whole}.b))[0]"


def with_shards(docs: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    kind = dict(docs.dtypes)[key]
    number = F.col(key).cast("decimal(20,0)") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key).cast("decimal(20,0)")
    number = F.coalesce(number, F.lit(0).cast("decimal(20,0)"))
    number = F.when(number < 0, number + F.expr(f"{MODULUS}BD")).otherwise(number).cast("decimal(20,0)")
    return docs.withColumn("_jump_key", number).withColumn(out, F.expr(jump_shard("_jump_key", shards)).cast("int")).drop("_jump_key")


def with_slots(rows: DataFrame, shard: str, order: tuple[str, ...], key: str, per_bucket: int = 200_000) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard.

    A shard is numbered in hash buckets of about per_bucket rows: inside a bucket by `order`, and shifted by the counts
    of the buckets before, so no task holds a whole shard.
    """
    total = rows.count()
    shards = 1 + (rows.agg(F.max(shard)).first()[0] or 0)
    buckets = max(1, min(100_000, math.ceil(total / shards / per_bucket)))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), *[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(shifts, [shard, "_bucket"]).withColumn("slot", (F.col("_in") + F.col("_shift")).cast("long")).drop("_bucket", "_in", "_shift")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    sized = slim.select("doc_id", (F.col("bytes") + overhead).alias("size"), "text_crc32")
    dealt = settle(with_shards(with_shards(sized, "doc_id", shards), "doc_id", shards + 1, "grown_shard"), "shards")
    out = with_slots(dealt, "shard", ("doc_id", "text_crc32", "size"), "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
