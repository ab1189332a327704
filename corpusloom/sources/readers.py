"""Sources: JSON lines with declared schemas, text, Markdown and Python files, chat data, logs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import pair_hash, strip
from ..operators.corpus import few_fences, first_filled, first_of_each, in_window, looks_like_code, ordered_limit, path_excluded


#: A line's place in its file: where its split begins, and its row in the task that reads the split.
PLACE = "struct<block:bigint,row:bigint>"


def text_lines(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> DataFrame:
    """(file, line_idx, value) of non-blank lines. A file is read in splits, by as many tasks as it has; line_idx is a
    place that orders the lines of a file and names each, not a number without gaps."""
    reader = spark.read.format("text").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return reader.load(paths).select(F.col("_metadata.file_path").alias("file"), place.alias("line_idx"), "value").where("trim(value) <> ''")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """strict: a malformed line fails the read. skip: it is left out. keep: it is a row of nulls with bad = true."""
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    if mode == "skip":
        return parsed.where("bad_line is null").drop("bad_line")
    return parsed.withColumn("bad", F.col("bad_line").isNotNull()).drop("bad_line")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict read, or no rows if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def read_prose(spark: SparkSession, directory: str, patterns: tuple[str, ...] = ("*.jsonl",), field: str = "text", low: int = 50, high: int = 2000) -> DataFrame:
    """Texts of a field in the length window, all folders below; a file that meets two patterns is read twice."""
    reads = [spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(directory) for p in patterns]
    texts = reduce(DataFrame.unionByName, reads).select(F.get_json_object("value", f"$.{field}").alias("text"))
    return texts.where(in_window(F.col("text"), low, high))


def read_field(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    return spark.read.text(path).select(F.get_json_object("value", f"$.{field}").alias("text")).where("text is not null")


def read_generation_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Texts of more than 50 characters in file order."""
    rows = text_lines(spark, path).select("file", "line_idx", F.from_json("value", schemas.CORPUS_ROW).alias("x"))
    texts = rows.select("file", "line_idx", first_filled(F.col("x.text"), F.col("x.content"), F.col("x.code")).alias("text")).where(F.length("text") > 50)
    return ordered_limit(texts, limit, ["file", "line_idx"]).select("text")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a plain text if it has more than one, else its lines."""
    whole = spark.read.text(path, wholetext=True)
    cut = lambda p: F.filter(F.transform(F.split("value", p), strip), lambda s: s != "")
    return whole.select(F.explode(F.when(F.size(cut("\n\n")) > 1, cut("\n\n")).otherwise(cut("\n"))).alias("text"))


def read_files(spark: SparkSession, directory: str, patterns: tuple[str, ...]) -> DataFrame:
    """(path, relative, source) of UTF-8 files of all folders below; other files are left out."""
    one = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(directory)
    files = reduce(DataFrame.unionByName, map(one, patterns)).where(F.is_valid_utf8(F.col("content").cast("string")))
    base = re.sub("^[a-z]+:/+", "/", directory.rstrip("/")) + "/"
    return files.select("path", F.substring_index("path", base, -1).alias("relative"), F.col("content").cast("string").alias("source"))


def read_python(spark: SparkSession, directory: str, exclude: list[str] | None = None) -> DataFrame:
    files = read_files(spark, directory, ("*.py",))
    return files.where(~(path_excluded(F.col("relative")) if exclude is None else path_excluded(F.col("relative"), exclude)))


def read_markdown_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, relative, source) of one Markdown file; relative is its name."""
    file = spark.read.format("binaryFile").load(path).where(F.is_valid_utf8(F.col("content").cast("string")))
    return file.select("path", F.substring_index("path", "/", -1).alias("relative"), F.col("content").cast("string").alias("source"))


def read_markdown(spark: SparkSession, directory: str, patterns: tuple[str, ...] = ("*.md", "*.markdown")) -> DataFrame:
    return read_files(spark, directory, patterns)


def read_corpus_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several JSON-line files with file_idx, line_idx, file_stem and bad; files that are not there are skipped."""
    jvm, out = spark.sparkContext._jvm, []
    for k, path in enumerate(paths):
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            x = F.from_json("value", f"{schemas.CORPUS_ROW}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"})
            stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
            out.append(text_lines(spark, path).select(F.lit(k).alias("file_idx"), "line_idx", F.lit(stem).alias("file_stem"), x.alias("x")).select("file_idx", "line_idx", "file_stem", "x.*"))
    rows = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"file_idx int, line_idx {PLACE}, file_stem string, {schemas.CORPUS_ROW}, bad_line string")
    return rows.withColumn("bad", F.col("bad_line").isNotNull()).drop("bad_line")


def remote_code(df: DataFrame, content_col: str, source: str, limit: int = 2000, low: int = 150, high: int = 2000) -> DataFrame:
    """Code rows of a dataset in the order of idx: length, a keyword, first of each 500-character head; 0 is no limit."""
    x = F.col(content_col)
    kept = df.where(in_window(x, low, high) & looks_like_code(x))
    firsts = first_of_each(kept, [F.substring(F.md5(F.substring(x, 1, 500)), 1, 16)], ["idx"])
    return ordered_limit(firsts, limit, ["idx"], zero_is_all=True).select(x.alias("text"), F.lit("python").alias("language"), F.lit(source).alias("source"))


def instructions(df: DataFrame, limit: int = 2000, low: int = 100, high: int = 2000) -> DataFrame:
    """Context, a blank line and the instruction; at most two fences."""
    text = F.concat_ws("\n\n", F.nullif(F.col("context"), F.lit("")), F.nullif(F.col("instruction"), F.lit("")))
    rows = df.withColumn("text", text).where(in_window(F.col("text"), low, high) & few_fences(F.col("text")))
    return ordered_limit(rows, limit, ["idx"]).select("text", "category")


def assistant_trees(df: DataFrame, limit: int = 2000, low: int = 100, high: int = 2000) -> DataFrame:
    """English prompts, first of each 200-character head."""
    rows = df.where((F.col("role") == "prompter") & (F.col("lang") == "en") & in_window(F.col("text"), low, high))
    return ordered_limit(first_of_each(rows, [F.substring("text", 1, 200)], ["idx"]), limit, ["idx"]).select("text", "message_id")


def user_text(messages: Column, prompt: Column) -> Column:
    """User turns joined by blank lines, or the prompt if there are none."""
    said = F.array_join(F.transform(F.filter(messages, lambda m: (m.role == "user") & (m.content != "")), lambda m: m.content), "\n\n")
    return F.coalesce(F.nullif(said, F.lit("")), prompt)


def multi_turn(df: DataFrame, limit: int = 2000, low: int = 100, high: int = 2000) -> DataFrame:
    rows = df.withColumn("text", user_text(F.col("messages"), F.col("prompt"))).where(in_window(F.col("text"), low, high) & few_fences(F.col("text")))
    return ordered_limit(first_of_each(rows, [F.substring("text", 1, 200)], ["idx"]), limit, ["idx"]).select("text")


def multi_turn_rows(turns: DataFrame, limit: int | None = 2000, low: int = 100, high: int = 2000, id_col: str = "conv_id") -> DataFrame:
    """As multi_turn, from rows (id, turn, role, text). A conversation's length is an aggregate first, so only those in
    the window are gathered into a row, and no row is longer than the window."""
    own = turns.where((F.col("role") == "user") & (F.col("text") != ""))
    fits = own.groupBy(F.col(id_col).alias("idx")).agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n")).where(F.col("n").between(low, high)).select("idx")
    kept = own.join(fits, own[id_col] == fits["idx"], "left_semi")
    rows = long_turns_to_user_text(kept, id_col).withColumnRenamed(id_col, "idx").where(few_fences(F.col("text")))
    return ordered_limit(first_of_each(rows, [F.substring("text", 1, 200)], ["idx"]), limit, ["idx"]).select("text")


def questions(df: DataFrame, limit: int = 2000, low: int = 100, high: int = 2000) -> DataFrame:
    """System prompt, a blank line and the question."""
    rows = df.withColumn("text", F.concat_ws("\n\n", F.nullif(F.col("system_prompt"), F.lit("")), F.col("question"))).where(in_window(F.col("text"), low, high) & few_fences(F.col("text")))
    return ordered_limit(first_of_each(rows, [F.substring("text", 1, 200)], ["idx"]), limit, ["idx"]).select("text")


def long_turns_to_user_text(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, text) from rows (id, turn, role, text): user turns of each conversation in order."""
    own = turns.where((F.col("role") == "user") & (F.col("text") != ""))
    return own.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("xs")).select(id_col, F.array_join("xs.text", "\n\n").alias("text"))


def read_pairs(spark: SparkSession, path: str, schema: str = schemas.PAIR) -> DataFrame:
    return read_jsonl(spark, path, schema)


def read_validated_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """nl_pairs.jsonl and code_pairs.jsonl, each optional; pairs that passed or were never judged."""
    both = [read_optional(spark, f"{directory}/{n}_pairs.jsonl", schemas.VALIDATED_PAIR) for n in ("nl", "code")]
    return both[0].unionByName(both[1]).where(F.coalesce("validation.passed", F.lit(True)))


def read_done_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(pair_hash) of the pairs in a file of validated lines, each once; lines that can't be read or lack a part are
    skipped, and no file is no hashes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "pair_hash string")
    known = read_jsonl(spark, path, schemas.PAIR, "skip").where("verbose is not null and compressed is not null and domain is not null")
    return known.select(pair_hash(F.col("domain"), F.col("verbose"), F.col("compressed")).alias("pair_hash")).distinct()


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, schemas.CALL_RECORD)


def count_lines(spark: SparkSession, path: str, blank: bool = False) -> int:
    lines = spark.read.text(path)
    return (lines if blank else lines.where("trim(value) <> ''")).count()


def read_logs(spark: SparkSession, directory: str, name: str = "train.log") -> DataFrame:
    """(run, path, content) of the log of every run directory named by a timestamp."""
    from ..operators.runs import run_name

    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).load(directory)
    path = F.col("_metadata.file_path")
    return files.select(run_name(F.regexp_replace(path, "/[^/]*$", "")).alias("run"), path.alias("path"), F.col("value").alias("content")).where("run is not null")

