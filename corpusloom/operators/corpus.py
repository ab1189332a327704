"""Corpus operators: filters, first-wins dedupe, merge with statistics, ordered limits, splits."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_hash

#: Files that are not training code (fixed values).
EXCLUDED = ["test_*.py", "*_test.py", "tests/*.py", "test/*.py", "**/tests/**/*.py", "**/test/**/*.py", "conftest.py", "setup.py", "setup.cfg"]


def in_window(x: Column, low: int, high: int) -> Column:
    return F.length(x).between(low, high)


def looks_like_code(x: Column) -> Column:
    return x.contains("def ") | x.contains("class ") | x.contains("async def ")


def few_fences(x: Column, most: int = 2) -> Column:
    return F.regexp_count(x, F.lit("```")) <= most


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def path_excluded(relative: Column, patterns: list[str] = EXCLUDED) -> Column:
    """Whether a pattern matches the file name or the whole relative path; `*` crosses slashes."""
    name = F.regexp_extract(relative, r"([^/]*)\z", 1)
    out = F.lit(False)
    for p in patterns:
        java = "^" + fnmatch.translate(p).replace(r"\Z", "").replace(r"\z", "") + "$"
        out = out | name.rlike(java) | relative.rlike(java)
    return out


def first_of_each(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in the given order, nulls first. Rows meet a partial aggregate before the shuffle, so a
    hot key brings a row from each task, not all its rows. Rows that tie in the order are as good as each other."""
    named = [F.expr(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(keys)]
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)))
    rows = df.select(*named, place.alias("place"), F.struct(*df.columns).alias("whole"))
    return rows.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.min_by("whole", "place").alias("whole")).select("whole.*")


def merge(df: DataFrame, domain: str, low: int = 100, high: int = 2500, dedupe: bool = True) -> DataFrame:
    """Adds domain, body (first of text, content, code) and status (filtered, duplicate or kept) to rows that carry
    file_idx and line_idx, which together name one row; duplicates are later rows of one body among those in the length
    window.

    Bodies stay out of the join by hash: places and hashes alone meet the first place of each body, so a hot body is a
    few bytes a row there, and whole rows are joined by their place, which is never hot. Filtered rows are not shuffled."""
    body = first_filled(*(F.col(c) for c in ("text", "content", "code") if c in df.columns))
    rows = df.withColumns({"body": body, "domain": F.lit(domain)}).withColumn("fits", F.coalesce(in_window(F.col("body"), low, high), F.lit(False)))
    if not dedupe:
        return rows.withColumn("status", F.when(F.col("fits"), "kept").otherwise("filtered")).drop("fits")
    place = ["file_idx", "line_idx"]
    keys = rows.where("fits").select(*place, text_hash(F.col("body")).alias("h"))
    firsts = keys.groupBy("h").agg(F.min(F.struct(*place)).alias("first"))
    status = keys.join(firsts, "h").select(*place, F.when(F.col("first") == F.struct(*place), "kept").otherwise("duplicate").alias("status"))
    named = status.withColumnsRenamed({c: f"at_{c}" for c in place})
    fitting = rows.where("fits").join(named, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in place]).select(*rows.columns, "status")
    return fitting.unionByName(rows.where("not fits").withColumn("status", F.lit("filtered"))).drop("fits")


def merged_rows(merged: DataFrame) -> DataFrame:
    """Kept rows as (text, domain, source, language, category)."""
    optional = [F.col(c) if c in merged.columns else F.lit(None).cast("string").alias(c) for c in ("language", "category")]
    source = F.coalesce("source", "file_stem") if "file_stem" in merged.columns else F.col("source")
    return merged.where("status = 'kept'").select(F.col("body").alias("text"), "domain", source.alias("source"), *optional)


def merge_stats(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return merged.groupBy(*(by or [])).agg(F.count("*").alias("total_read"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("duplicate", "duplicates"), ("filtered", "filtered"), ("kept", "kept"))))


def ordered_limit(df: DataFrame, n: int | None, order: list[str], zero_is_all: bool = False) -> DataFrame:
    """The first n rows in order; none is all, and so is 0 on request."""
    if n is None or (zero_is_all and n == 0):
        return df
    return df.orderBy(*order).limit(n)


def split(df: DataFrame, key: Column, strata: list[str] | None = None, values: list | None = None, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Adds split: in hash order, the first int(n * train) rows of each stratum train, the next int(n * valid) validate,
    the rest test. With `values`, other values of the first stratum column get null. Ranks are taken in two levels (hash
    buckets, then inside a bucket), so a stratum of any size spreads over tasks."""
    strata = strata or []
    order = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    rows = df.withColumn("s_order", order).withColumn("s_bucket", F.substring("s_order", 1, 3))
    inside = Window.partitionBy(*strata, "s_bucket").orderBy("s_order")
    rows = rows.withColumn("s_rank", F.row_number().over(inside))
    counts = df.select(*strata, F.substring(order, 1, 3).alias("s_bucket")).groupBy(*strata, "s_bucket").agg(F.count("*").alias("s_count"))
    group = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("s_count").over(group.orderBy("s_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(s).alias(f"r_{s}") for s in strata), F.col("s_bucket").alias("r_bucket"), before.alias("s_before"), F.sum("s_count").over(group).alias("s_total"))
    on = F.col("s_bucket") == F.col("r_bucket")
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"r_{s}"))
    rows = rows.join(F.broadcast(offsets) if not strata else offsets, on)  # at most 4,096 rows without strata
    rank, cut = F.col("s_before") + F.col("s_rank"), F.floor(F.col("s_total") * train)
    name = F.when(rank <= cut, "train").when(rank <= cut + F.floor(F.col("s_total") * valid), "valid").otherwise("test")
    if values is not None:
        name = F.when(F.col(strata[0]).isin(values), name)
    return rows.withColumn("split", name).select(*df.columns, "split")


def split_stats(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """total counts every row; nl_count and code_count by domain."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")), *(F.count_if(F.col(domain_col) == d).alias(f"{d}_count") for d in ("nl", "code")))


def code_corpus_summary(df: DataFrame) -> DataFrame:
    lines = F.col("end_line") - F.col("start_line") + 1
    return df.agg(
        *(F.count_if(F.col("unit_type") == u).alias(f"n_{u}") for u in ("function", "class", "method")),
        F.coalesce(F.sum(F.length("code")), F.lit(0)).alias("total_chars"), F.expr("coalesce(sum(length(code)) div count(*), 0)").alias("avg_chars"),
        F.coalesce(F.floor(F.sum(lines) / F.count("*")), F.lit(0)).alias("avg_lines"), F.count_distinct("file_path").alias("files"),
    )


def chunk_summary(df: DataFrame, text_col: str = "text", file_col: str = "source_file") -> DataFrame:
    n = F.length(text_col)
    return df.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.count_distinct(file_col).alias("files"), F.count_if(n < 200).alias("short"), F.count_if((n >= 200) & (n < 1000)).alias("medium"), F.count_if(n >= 1000).alias("long"))
