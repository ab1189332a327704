"""Training runs: log lines to metrics, run status, summaries, the latest run, perplexity from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strip

#: Values of a metric line (fixed values).
METRICS = {
    "train_loss": r"Train loss ([\d.]+)", "val_loss": r"Val loss ([\d.]+)", "learning_rate": r"Learning Rate ([\d.e+-]+)",
    "it_sec": r"It/sec ([\d.]+)", "tokens_sec": r"Tokens/sec ([\d.]+)", "trained_tokens": r"Trained Tokens (\d+)",
    "peak_mem": r"Peak mem ([\d.]+) GB",
}
#: Signs of failure in this order, and what they are called (fixed values).
FAILURES = [
    (r"Error:(.+)", "Error"), (r"Exception:(.+)", "Exception"), (r"Traceback \(most recent call last\)", "Exception/Traceback"),
    ("CUDA out of memory", "Out of Memory"), ("killed", "Process Killed"), ("Failed", "Training Failed"),
]
RUN_NAME = r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without one."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def log_lines(logs: DataFrame) -> DataFrame:
    """(run, line_idx, line) of logs (run, content)."""
    return logs.select("run", F.posexplode(F.split(strip(F.col("content")), "\n")).alias("line_idx", "line"))


def metric_lines(lines: DataFrame) -> DataFrame:
    """(run, line_idx, iteration, kind, values): train lines carry all values, lines with a validation loss alone theirs."""
    line = F.col("line")
    out = lines.select("run", "line_idx", line, extract(line, r"Iter (\d+)").cast("long").alias("iteration"), *(extract(line, p).cast("double").alias(n) for n, p in METRICS.items())).where("iteration is not null")
    train = line.contains("Train loss")
    kind = F.when(F.col("val_loss").isNotNull() & ~train, "val").when(F.col("train_loss").isNotNull(), "train")
    out = out.withColumn("kind", kind).where("kind is not null").drop("line")
    return out.withColumns({n: F.when((F.col("kind") == "val") == (n == "val_loss"), F.col(n)) for n in METRICS}).withColumn("trained_tokens", F.col("trained_tokens").cast("long"))


def header(lines: DataFrame) -> DataFrame:
    """Total iterations and trainable parameters of each run, from its first ten lines; the last match holds."""
    top = lines.where("line_idx < 10")
    params = r"Trainable parameters: ([\d.]+)% \(([\d.]+[KMB])/([\d.]+[KMB])\)"
    line = F.col("line")
    values = top.select("run", "line_idx", extract(line, r"iters: (\d+)").cast("long").alias("it"), extract(line, params, 1).cast("double").alias("pct"), F.concat(extract(line, params, 2), F.lit("/"), extract(line, params, 3)).alias("par"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_idx")))
    return values.groupBy("run").agg(last("it").alias("total_iters"), last("pct").alias("trainable_percentage"), last("par").alias("trainable_params"))


def size_number(x: Column) -> Column:
    """7.340M as a number."""
    unit = F.right(x, F.lit(1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.regexp_replace(x, "[KMB]$", "").cast("double") * factor


def run_status(content: Column) -> Column:
    """complete, or what went wrong; success counts first, then the signs of failure in order, in any case."""
    out = F.when(content.contains("Saved final weights"), "complete")
    for pattern, name in FAILURES:
        p = f"(?id){pattern}"
        said = F.concat(F.lit(f"{name}: "), strip(F.regexp_extract(content, p, 1))) if "(.+)" in pattern else F.lit(name)
        out = out.when(content.rlike(p), said)
    return out.when(content.contains("Starting training"), "Training incomplete (no final weights saved)").otherwise("Unknown status (log may be empty or corrupted)")


def run_name(path: Column) -> Column:
    """A run directory's name if it starts with a timestamp."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(name.rlike(f"^{RUN_NAME}"), name)


def latest_run(runs: DataFrame, name_col: str = "name") -> DataFrame:
    return runs.orderBy(F.desc(name_col)).limit(1)


def run_summary(metrics: DataFrame) -> DataFrame:
    """First, last and least losses, reduction, speeds, memory and tokens of each run, in line order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_idx")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_idx")))
    out = metrics.groupBy("run").agg(
        *(f(c).alias(f"{n}_{c}") for c in ("train_loss", "val_loss") for n, f in (("first", first), ("last", last), ("min", F.min))),
        *(f(c).alias(f"{n}_{c}") for c in ("it_sec", "tokens_sec") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))),
        F.max("peak_mem").alias("max_peak_mem"), last("peak_mem").alias("last_peak_mem"), last("trained_tokens").alias("last_trained_tokens"),
    )
    return out.withColumn("train_reduction_percent", F.when(F.col("first_train_loss") != 0, (1.0 - F.col("last_train_loss") / F.col("first_train_loss")) * 100.0))


def perplexity(output: Column) -> Column:
    """From the first line that names it with a number after it; the colon may be missing."""
    hits = F.filter(F.split(output, "\n"), lambda s: s.rlike(r"(?i)ppl\s*:?\s*[0-9]+(?:\.[0-9]+)?"))
    return F.when(F.size(hits) > 0, F.regexp_extract(F.element_at(hits, 1), r"(?i)ppl\s*:?\s*([0-9]+(?:\.[0-9]+)?)", 1).cast("double"))
