"""Incremental batches: rows appended as files arrive, nothing done twice, and a stop when the budget is spent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, out_schema: str, key: Column, checkpoint: str, files_per_batch: int = 8, compression: str | None = None) -> StreamingQuery:
    """Runs `work` on rows of new JSON files whose key no earlier batch had, and appends the result, file batch by file
    batch. Each batch writes folders of its own, results and the keys of its rows, so a batch that is repeated after a
    failure replaces what it had written, and what is done is known from the keys alone (`<checkpoint>/keys`): results
    are not read again. `out_schema` is what `work` gives; `compression` is a codec of its files."""
    keys = f"{checkpoint.rstrip('/')}/keys"

    def batch(rows: DataFrame, number: int) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(keys)
        known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        named = rows.dropDuplicates().withColumn("resume_key", key)
        todo = named
        if known:
            done = spark.read.schema("resume_key string, batch long").parquet(keys).where(F.col("batch") < number).select("resume_key").distinct()
            todo = named.join(done, "resume_key", "left_anti")
        todo.persist()
        try:
            made = work(todo.drop("resume_key"))
            made.select([F.col(f.name) for f in StructType.fromDDL(out_schema).fields]).write.mode("overwrite").json(f"{target}/batch={number}", compression=compression)
            todo.select(F.col("resume_key").cast("string")).write.mode("overwrite").parquet(f"{keys}/batch={number}")
        finally:
            todo.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_with_budget(spark: SparkSession, todo: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, most: float, batches: int, key: Column, cost_col: str = "cost_usd") -> float:
    """Hash-dealt batches one after another until the spend is over the budget; every finished batch is on disk."""
    spent = 0.0
    for k in range(batches):
        if spent > most:
            break
        out = f"{target}/batch={k}"
        work(todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)).write.mode("overwrite").json(out)
        spent += spark.read.schema(f"{cost_col} double").json(out).agg(F.coalesce(F.sum(cost_col), F.lit(0.0))).first()[0]
    return spent
