"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, placed


def shard_score(keys: Sequence[str], shard: int, weight: float) -> Column:
    """Score of one shard for a record: ``-weight / ln(u)``, ``u`` uniform in (0, 1) by key and shard."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard).cast("long")), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return F.lit(float(weight)) / -F.ln(uniform)


def rendezvous(keys: Sequence[str], shards: Mapping[int, float]) -> Column:
    """The shard whose score is highest for the record.

    A record moves only when its highest score changes hands: a new shard takes
    records into itself and from nowhere to elsewhere, a dropped one hands out
    only its own, a raised weight only attracts.  Equal scores: the smaller shard
    number.  Null keys hash as a key of their own; repeated keys go together.
    """
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need positive weights")
    scored = [F.struct(shard_score(keys, s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in shards.items()]
    return (-F.array_max(F.array(*scored))["minus"]).cast("int")


def assign_shards(rows: DataFrame, keys: Sequence[str], shards: Mapping[int, float], out: str = "shard") -> DataFrame:
    """``rows`` with the shard of each; a column named ``out`` is replaced, an empty table stays empty."""
    return rows.withColumn(out, rendezvous(keys, shards))


def slot_rows(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Gapless positions from 0 in each shard; no shard is gathered in one task."""
    return numbered(placed(rows), [shard], out)


def write_shards(rows: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8) -> None:
    """Write one folder per shard, each shard dealt over ``files_per_shard`` tasks."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    rows.withColumn("_part", spread).repartition(shard, "_part").drop("_part").write.partitionBy(shard).parquet(path)
