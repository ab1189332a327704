"""The corpus pipeline: language ID, near-duplicate join, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes every stage's rows as
Parquet into a fresh folder under spark.checkpoint.dir and rereads them, so a lost executor costs one stage at most.
Nulls, empty tables and columns with clashing names are as each operator's docstring says; all stages but the last
return the columns of their documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import shared_folder
from corpusloom.llm.decontaminate import drop_contaminated
from corpusloom.llm.language import drop_unidentified
from corpusloom.llm.neighbours import drop_near_duplicates
from corpusloom.llm.packing import pack_stage
from corpusloom.llm.pii import redact_stage

STAGES = [
    ("language_id", drop_unidentified),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_stage),
    ("best_fit_packing", pack_stage),
]

#: A trained field, a MinHash forest and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's input is deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
