"""Sinks: JSON lines and text, one file or many; null fields are left out and non-ASCII text is kept."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.training import chat_rows, completion_rows, text_rows


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None, compression: str | None = None) -> int:
    """Rows written, counted as they pass; with a codec the files are compressed."""
    count = Observation()
    out = df if files is None else df.coalesce(files)
    out.observe(count, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path, compression=compression)
    return count.get["n"]


def write_code_corpus(units: DataFrame, path: str) -> int:
    """code is called text on disk; an empty metadata map is left out."""
    return write_jsonl(units.withColumnRenamed("code", "text").withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata"))), path)


def write_chunks(chunks: DataFrame, path: str) -> int:
    return write_jsonl(chunks.select("text", "source_file"), path)


def write_pairs(pairs: DataFrame, path: str, append: bool = False) -> int:
    return write_jsonl(pairs, path, "append" if append else "overwrite")


def write_chat(pairs: DataFrame, path: str, **texts) -> int:
    return write_jsonl(chat_rows(pairs, **texts), path)


def write_completions(pairs: DataFrame, path: str) -> int:
    return write_jsonl(completion_rows(pairs), path)


def write_text(pairs: DataFrame, path: str, **texts) -> int:
    return write_jsonl(text_rows(pairs, **texts), path)


def write_splits(rows: DataFrame, directory: str) -> None:
    """train, valid and test, a folder each; no rows at all is an error."""
    if rows.isEmpty():
        raise ValueError("no validated pairs")
    rows.where("split is not null").write.mode("overwrite").partitionBy("split").json(directory)


def append_jsonl(df: DataFrame, path: str) -> int:
    """Evaluation rows, cost records and cache entries are appended; a reader takes the newest entry of a key."""
    return write_jsonl(df, path, "append")


def cache_entries(df: DataFrame, key_col: str, value_col: str, seconds: int | None = None) -> DataFrame:
    """Cache rows of results, which expire after some seconds or never."""
    now = F.current_timestamp()
    ends = F.lit(None).cast("timestamp") if seconds is None else now + F.make_dt_interval(secs=F.lit(seconds))
    return df.select(F.col(key_col).alias("key"), F.col(value_col).cast("string").alias("value"), ends.alias("expires_at"), now.alias("written_at"))


def delete_cached(keys: DataFrame, path: str, key_col: str = "key") -> int:
    """Deletes keys of the cache: an entry without a value, newer than any other, is appended for each."""
    entries = keys.select(key_col).distinct().withColumn("none", F.lit(None).cast("string"))
    return append_jsonl(cache_entries(entries, key_col, "none"), path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Leaves a cache without entries."""
    spark.createDataFrame([], "key string, value string, expires_at timestamp, written_at timestamp").write.mode("overwrite").json(path)


def sample_path(directory: str, dataset: str, split: str = "train") -> str:
    """Where samples of a remote dataset go by default: its name with slashes as underscores, and the split."""
    return f"{directory.rstrip('/')}/{dataset.replace('/', '_')}_{split}.jsonl"


def git_sha(directory: str = ".") -> str:
    """The commit of a working directory, or `unknown`."""
    try:
        said = subprocess.run(["git", "rev-parse", "HEAD"], cwd=directory, capture_output=True, text=True)
    except OSError:
        return "unknown"
    return said.stdout.strip() or "unknown" if said.returncode == 0 else "unknown"


def lora_config(model: str, data: str, adapter_path: str, rank: int = 8, alpha: int = 16, **options) -> dict:
    """A trainer's settings as they are written for it."""
    return {"model": model, "data": data, "adapter_path": adapter_path} | options | {"lora_parameters": {"rank": rank, "alpha": alpha, "dropout": 0.0, "scale": alpha / rank}}


def write_yaml(values: dict, path: str) -> None:
    """Nested settings as YAML; scalars are written as JSON, which YAML reads alike."""

    def lines(x: dict, indent: str) -> list[str]:
        out = []
        for k, v in sorted(x.items()):
            out += [f"{indent}{k}:", *lines(v, indent + "  ")] if isinstance(v, dict) and v else [f"{indent}{k}: {json.dumps(v)}"]
        return out

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines(values, "")) + "\n", encoding="utf-8")


def new_run(root: str, metadata: dict, when: datetime | None = None) -> Path:
    """A run directory named by the time, its metadata, and a `latest` link; a real directory called latest is an error."""
    when = when or datetime.now(UTC)
    run, latest = Path(root) / when.strftime("%Y-%m-%d_%H-%M-%S"), Path(root) / "latest"
    if latest.exists() and not latest.is_symlink():
        raise ValueError(f"{latest} is not a link")
    run.mkdir(parents=True)
    (run / "run.json").write_text(json.dumps({"started_at": when.isoformat().replace("+00:00", "Z")} | metadata, indent=2))
    latest.unlink(missing_ok=True)
    latest.symlink_to(run.name)
    return run
