import time

import pytest

from corpusloom.llm.common import BATCH_ROWS, FILE_CLEANUP, cut, shared_folder, small_batches


class Session:
    """As much of a session as a folder is chosen by."""

    def __init__(self, master, folder):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, type("C", (), {"master": master})


def test_a_cluster_must_name_its_folder():
    assert shared_folder(Session("spark://a:7077", "hdfs://x/y")) == shared_folder(Session("local[2]", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(Session("local[2]", None))
    with pytest.raises(RuntimeError):
        shared_folder(Session("spark://a:7077", None))


def test_smaller_batches_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for now, want in (("100", "100"), ("99999", str(BATCH_ROWS)), ("0", str(BATCH_ROWS))):
            spark.conf.set(name, now)
            small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, old)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle_")}


def left_over(spark, before, most=0):
    """The shuffle files that are new; they are deleted in the background."""
    for _ in range(50):
        if len(left := shuffle_files(spark) - before) <= most:
            break
        time.sleep(0.2)
    return left


def test_shuffle_files_go_with_the_cut(spark):
    before, now = shuffle_files(spark), spark.conf.get(FILE_CLEANUP)
    rows = spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count()
    out = cut(rows)
    assert not left_over(spark, before) and spark.conf.get(FILE_CLEANUP) == now
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect())) == [(k, 100) for k in range(10)]
