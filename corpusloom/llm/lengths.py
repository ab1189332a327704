"""Token counts: the exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded once and only their lengths leave the encoder; the histogram has one row for each length that
occurs and is written out (a checkpoint), as the report reads it more than once. Sums from above (in two levels: inside blocks of lengths, then over blocks) give for every limit the documents
and tokens that fit, those that are cut, the tokens kept when each document is truncated, and the quantile reached.

Defined results: null text has length 0, as the empty text; repeated rows count each; an empty table has an empty
histogram; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, pieces, small_batches, table

#: Lengths that share a block of the suffix sums.
BLOCK = 256
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    """Byte-level BPE from a file of ranks, with no special tokens; one for each process, which outlives a task."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): counted in each task before the shuffle, so a row leaves a task for each length at most."""

    def run(batches):
        encode, counts = encoder(vocabulary).encode_ordinary, np.zeros(1 << 12, np.int64)
        for batch, _, _ in pieces(batches, "t"):
            sizes = np.array([len(encode(t)) if t else 0 for t in column(batch, "t").to_pylist()])
            own = np.bincount(sizes, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(counts[some])], names=["length", "n"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def limit_report(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each length as context limit. Between two lengths L < M a limit x keeps `truncated_tokens` of L plus
    (x - L) times `docs_longer` of L tokens, so the rows answer every limit."""
    h = cut(histogram).select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.expr(f"length div {block}").alias("b"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))  # longest text / block rows
    whole = blocks.agg(F.sum("bn").alias("all_docs"), F.sum("bt").alias("all_tokens"))
    sums = blocks.select("b", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("at"))
    inside = Window.partitionBy("b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    joined = h.join(sums, "b").crossJoin(F.broadcast(whole))  # one row
    longer = F.col("an") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    cut_tokens = F.col("at") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return joined.select("length", "n_docs", "all_docs", "all_tokens", longer.alias("docs_longer"), cut_tokens.alias("tokens_longer")).select(
        F.col("length").alias("context_limit"),
        "n_docs",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
        "docs_longer",
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        "all_docs",
        "all_tokens",
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, truncated_tokens) for any limits, from the histogram alone."""
    rows = histogram.withColumn("context_limit", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
    return rows.groupBy("context_limit").agg(F.sum(F.when(F.col("length") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"), F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_tokens"))


def length_quantile(report: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents does not exceed."""
    return report.where(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, for every context limit."""
    return limit_report(length_histogram(table(spark, sf_dir, "documents")))
