"""Resuming: what is already done, by content hash or by count, and the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_done(todo: DataFrame, done: DataFrame, key: Callable[[], Column] | Column) -> DataFrame:
    """Rows of todo whose key no row of done has; `key` is an expression over either table's columns."""
    name = "resume_key"
    left, right = todo.withColumn(name, key), done.select(key.alias(name)).where(F.col(name).isNotNull()).distinct()
    return left.join(right, name, "left_anti").select(*todo.columns)


def after(rows: DataFrame, n: int, index_col: str = "line_idx") -> DataFrame:
    """Rows after the first n by their own zero-based index."""
    return rows.where(F.col(index_col) >= n)


def with_cached(requests: DataFrame, cache: DataFrame, key_col: str = "key", now: Column | None = None) -> DataFrame:
    """Adds cached, the value of the newest entry if that has not expired, or null. A deleted key's newest entry has no
    value."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now))
    if "written_at" in cache.columns:
        entry = F.max_by(F.struct("value", "expires_at"), F.coalesce("written_at", F.timestamp_seconds(F.lit(0)))).alias("x")
        newest = cache.groupBy(key_col).agg(entry).select(key_col, "x.*").where(live).select(key_col, F.col("value").alias("cached"))
    else:
        newest = cache.where(live).groupBy(key_col).agg(F.max("value").alias("cached"))
    return requests.join(newest, key_col, "left")


def cache_counters(probed: DataFrame) -> DataFrame:
    return probed.agg(F.count_if(F.col("cached").isNotNull()).alias("cached_count"), F.count_if(F.col("cached").isNull()).alias("generated_count"))
