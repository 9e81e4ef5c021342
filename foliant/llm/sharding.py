"""Placement of keys in shards by a permutation-filled lookup table (Maglev hashing).

Every shard has a permutation of the slots of a prime-sized table, given by an offset
and a step. The shards take turns; each claims the first slot of its permutation that
is still free. A key's digest picks a slot, so placement is one look-up in a broadcast
table, which has as many rows as slots whatever the data. When shards come or go, few
keys move. Only DataFrame functions touch the data.

Defined cases: a null key is a key of its own; equal keys share a shard, so ties and
repeated rows stay together; an empty table gives no rows. Columns named like the added
ones are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that owns it. ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("distinct shard names are needed")
    if not _is_prime(slots) or slots < len(shards) or slots > 1 << 22:
        raise ValueError("the number of slots must be a prime from the number of shards to 4 million")
    number = lambda salt, name: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number("offset", s) % slots for s in shards]
    step = [number("step", s) % (slots - 1) + 1 for s in shards]
    owner, claimed = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % slots
            owner[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            claimed += 1
            if claimed == slots:
                return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard``, a row for each slot, decoded from one packed literal."""
    packed = b"".join(owner.to_bytes(4, "big") for owner in fill_table(shards, slots))
    owner = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int")
    return spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("slot"), owner.alias("shard"))


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of its MD5, modulo the number of slots."""
    parts = [F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("null")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(",", *parts)), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (an index into ``shards``)."""
    table = lookup_table(df.sparkSession, shards, slots)
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    rows = df.withColumn("__slot", slot_of(*(F.col(k) for k in keys), slots=slots)).select(*kept, "__slot")
    joined = rows.join(F.broadcast(table), rows["__slot"] == table["slot"])
    return joined.select(*kept, "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Write one folder for each shard, each dealt over ``files_per_shard`` tasks by a second digest."""
    placed = assign_shards(df, keys, shards, slots)
    file = F.pmod(F.xxhash64(*keys), F.lit(files_per_shard))
    placed.withColumn("__file", file).repartition(len(shards) * files_per_shard, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
