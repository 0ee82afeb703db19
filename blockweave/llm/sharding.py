"""Placement by a permutation-filled lookup table (operator 10), DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 2039
PROBE = 32
SHARDS = tuple(f"shard-{i:02d}" for i in range(20))


def _hash(text: str, first: int) -> str:
    """32 bits of an md5 as SQL: hex digits first to first + 7."""
    return f"CAST(conv(substr(md5({text}), {first}, 8), 16, 10) AS BIGINT)"


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row a slot.

    Shard i prefers the slots (offset_i + j * skip_i) mod slots, j = 0, 1, ...; the number of slots is
    prime, so each preference order is a permutation of all slots. Shards claim in turn, each the first
    slot of its order that is free, until none is. No row of data is read. An empty shard list is an error.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards: at least one, without repeats")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots: a prime that is not below the number of shards")
    names = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in shards)
    n = len(shards)
    at = f"CAST((o[i % {n}] + j * k[i % {n}]) % {slots} AS INT)"
    free = f"get(filter(sequence(s.next[i % {n}], {{last}}), j -> s.t[{at}] = -1), 0)"
    # A short stretch of the preference order nearly always holds a free slot; else the whole rest is read.
    claim = f"coalesce({free.format(last=f'least({slots - 1}, s.next[i % {n}] + {PROBE})')}, {free.format(last=slots - 1)})"
    turn = f"""
        aggregate(sequence(0, {slots - 1}), named_struct('t', array_repeat(-1, {slots}), 'next', array_repeat(0, {n})), (s, i) ->
          aggregate(array({claim}), s, (z, j) -> named_struct(
            't', concat(slice(z.t, 1, {at}), array(i % {n}), slice(z.t, {at} + 2, {slots})),
            'next', transform(z.next, (x, p) -> IF(p = i % {n}, least(j + 1, {slots - 1}), x)))), s -> s.t)"""
    return spark.sql(f"""
        WITH names AS (SELECT array({names}) AS shards),
        orders AS (SELECT shards, transform(shards, x -> {_hash("x", 1)} % {slots}) AS o, transform(shards, x -> {_hash("x", 9)} % {slots - 1} + 1) AS k FROM names),
        filled AS (SELECT shards, {turn} AS t FROM orders)
        SELECT CAST(p AS BIGINT) AS slot, shards[i] AS shard FROM filled LATERAL VIEW posexplode(t) x AS p, i""")


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`rows` with slot and shard of their key: one hash and one look-up in the broadcast table, whose size
    is `slots` rows whatever the data. Equal keys share a shard; a null key counts as the empty string.
    Columns of `rows` named slot or shard are replaced."""
    table = lookup_table(rows.sparkSession, shards, slots)
    text = f"coalesce(CAST(`{key}` AS STRING), '')"
    keyed = rows.drop("slot", "shard").withColumn("slot", F.expr(f"{_hash(text, 1)} % {slots}"))
    return keyed.join(F.broadcast(table), "slot", "left")


def moved(spark: SparkSession, before: tuple[str, ...], after: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """slot, was, now of the slots whose shard differs between two shard lists."""
    a, b = lookup_table(spark, before, slots), lookup_table(spark, after, slots)
    return a.withColumnRenamed("shard", "was").join(b.withColumnRenamed("shard", "now"), "slot").where("was <> now")
