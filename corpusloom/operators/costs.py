"""Cost log: spend by day and model, limits, and where a budget stops a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAILY_LIMIT, WARN_ABOVE = 50.0, 30.0


def spend_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("cost_usd").alias("spend"))


def spend_by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.sum("cost_usd").alias("spend"))


def total_spend(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend"))


def limit_state(days: DataFrame, limit: float = DAILY_LIMIT, warn: float = WARN_ABOVE) -> DataFrame:
    return days.withColumn("state", F.when(F.col("spend") >= limit, "exceeded").when(F.col("spend") >= warn, "warn").otherwise("ok"))


def within_budget(log: DataFrame, most: float, order: list[str], group: str) -> DataFrame:
    """Rows of each group in order up to the one that takes its spend over the budget, which is the last to run.

    `group` is a run; its rows are ordered in one task, as a run is bounded by the budget it tests."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("spent_before", F.coalesce(F.sum("cost_usd").over(w), F.lit(0.0))).where(F.col("spent_before") <= most)
