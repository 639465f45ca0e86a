"""A cache of computed values with a time to live, kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_SECONDS = 31 * 24 * 3600


def alive(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def split(requests: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """Requests with ``hit``: whether a live entry answers them."""
    live = alive(cache, now).select(key).distinct().withColumn("hit", F.lit(True))
    return requests.join(live, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def put(cache: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    from inkwell.operators.store import upsert

    return upsert(cache, entries, key)


def renew(cache: DataFrame, keys: DataFrame, key: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Sets the expiry of live entries with these keys anew."""
    named = keys.select(key).distinct().withColumn("_named", F.lit(True))
    fresh = now + F.make_dt_interval(secs=F.lit(ttl))
    return cache.join(named, key, "left").withColumn("expires_at", F.when(F.col("_named") & (F.col("expires_at") > now), fresh).otherwise(F.col("expires_at"))).drop("_named")


def evict(cache: DataFrame, group: list[str], used_at: str, size: str, room: int, key: str) -> DataFrame:
    """Least recently used entries of each group leave until the rest fits into ``room``."""
    order = Window.partitionBy(*group).orderBy(F.desc(used_at), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cache.withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= room).drop("_sum")
