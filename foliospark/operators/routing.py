"""Routing of keys to shards, and what follows from it: grouping, topology, candidates."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import hashes

Algorithm = Literal["murmur3", "crc32", "sha256"]


def key_hash(key: Column, algorithm: Algorithm = "murmur3") -> Column:
    return {"murmur3": hashes.murmur3_positive, "crc32": hashes.crc32_positive, "sha256": hashes.sha256_int}[algorithm](key)


def shard_id(key: Column, shards: int, algorithm: Algorithm = "murmur3") -> Column:
    """The shard of a key; null and empty keys go to shard 0."""
    return F.when(F.coalesce(key, F.lit("")) == "", 0).otherwise(F.pmod(key_hash(key, algorithm), F.lit(shards))).cast("int")


def with_shard(rows: DataFrame, shards: int, key: str = "id", algorithm: Algorithm = "murmur3") -> DataFrame:
    return rows.withColumn("shard", shard_id(F.col(key), shards, algorithm))


def keys_by_shard(keys: DataFrame, shards: int, key: str = "id", algorithm: Algorithm = "murmur3") -> DataFrame:
    """``shard, n_keys``: how many different keys go to each shard. The keys themselves stay rows of :func:`with_shard`."""
    return with_shard(keys.select(key).distinct(), shards, key, algorithm).groupBy("shard").agg(F.count("*").alias("n_keys"))


def group_by_shards(keys: DataFrame, shards: int, key: str = "id", algorithm: Algorithm = "murmur3", block: int = 10_000) -> DataFrame:
    """``shard, block, keys``: the different keys of each shard as sorted lists of about ``block`` keys.

    A shard has as many lists as its keys need; keys go to lists by a hash, so no list grows with the collection.
    """
    placed = with_shard(keys.select(key).distinct(), shards, key, algorithm)
    sizes = placed.groupBy("shard").agg(F.count("*").alias("_n"))
    spread = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / block)).cast("int")
    return placed.join(F.broadcast(sizes), "shard").groupBy("shard", spread.alias("block")).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def topology_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """``key, change``: what was added and what removed."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.union(before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def topology(endpoints: DataFrame) -> DataFrame:
    """``shard, primary, replicas`` from ``shard, url, position``: the first endpoint is the primary, the rest replicas."""
    each = endpoints.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("_e"))
    urls = F.transform("_e", lambda e: e["url"])
    return each.select("shard", urls[0].alias("primary"), F.slice(urls, F.lit(2), F.size(urls)).alias("replicas"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The one with the highest ``seq``, among equals the lowest ``replica_index``."""
    return candidates.orderBy(F.desc("seq"), F.asc("replica_index")).limit(1)
