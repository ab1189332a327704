"""Validation of pairs: tasks, prompts, scores by model and task, the gate, statistics, cost projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combined_score, compression_ratio, task_score
from ..functions.scoring import PRICES

#: Prompts of the tasks (fixed values); other tasks use that of qa.
PROMPTS = {
    "qa": "Based on the following context, answer the question concisely.\n\nContext:\n{context}\n\nQuestion: What are the key points mentioned?\nAnswer:",
    "reasoning": "Analyze the following information and explain the main implications.\n\nInformation:\n{context}\n\nAnalysis:",
    "code_generation": "Based on the following specification, write the corresponding code.\n\nSpecification:\n{context}\n\nCode:",
}
MODELS = {"claude": "claude-sonnet-4-20250514", "gpt": "gpt-4o-mini", "gemini": "gemini-2.0-flash"}
#: Least equivalence of a pair that passes, by caller (fixed values).
THRESHOLDS = {"harness": 0.72, "batch": 0.72, "evaluation": 0.72, "is_equivalent": 0.75, "synthetic": 0.80, "config": 0.85, "run_evaluation": 0.0}


def tasks_of(domain: Column) -> Column:
    return F.when(domain == "code", F.array(F.lit("code_generation"), F.lit("reasoning"))).otherwise(F.array(F.lit("qa"), F.lit("reasoning")))


def prompt(task: Column, context: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    table = F.create_map(*(F.lit(x) for pair in prompts.items() for x in pair))
    return F.replace(F.coalesce(F.element_at(table, task), F.lit(prompts["qa"])), F.lit("{context}"), context)


def model_name(alias: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in MODELS.items() for x in pair)), alias)


def requests(pairs: DataFrame, models: list[str], tasks: list[str] | None = None, prompts: dict[str, str] = PROMPTS) -> DataFrame:
    """One row for each pair, model and task with both prompts; models and tasks are short fixed lists."""
    chosen = F.array(*map(F.lit, tasks)) if tasks else tasks_of(F.col("domain"))
    rows = pairs.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("task", F.explode(chosen))
    return rows.withColumns({"verbose_prompt": prompt(F.col("task"), F.col("verbose"), prompts), "compressed_prompt": prompt(F.col("task"), F.col("compressed"), prompts)})


def validate(scored: DataFrame, threshold: float = THRESHOLDS["harness"]) -> DataFrame:
    """From (pair_id, model, task, semantic, ast_similarity, judge_score, verbose_tokens, compressed_tokens): a row for
    each pair with the mean over tasks of each model, the least of the models and the gate."""
    score = F.when(F.col("judge_score").isNotNull(), combined_score(F.col("semantic"), F.lit(0.0), F.col("judge_score"))).otherwise(task_score(F.col("task"), F.col("semantic"), F.col("ast_similarity")))
    by_model = scored.groupBy("pair_id", "model").agg(F.avg(score).alias("score"), F.avg("judge_score").alias("judge"), F.max("verbose_tokens").alias("vt"), F.max("compressed_tokens").alias("ct"))
    out = by_model.groupBy("pair_id").agg(
        F.max("vt").alias("verbose_tokens"), F.max("ct").alias("compressed_tokens"), F.min("score").alias("min_equivalence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("equivalence_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("judge").isNotNull(), F.struct("model", "judge"))))).alias("llm_judge_scores"),
    )
    return out.withColumns({"compression_ratio": compression_ratio(F.col("verbose_tokens"), F.col("compressed_tokens")), "llm_judge_used": F.size("llm_judge_scores") > 0, "passed": F.col("min_equivalence") >= threshold})


def batch_stats(results: DataFrame) -> DataFrame:
    """Counts, means and the pass rate; zeros for an empty batch."""
    passed = F.count_if("passed")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(
        F.count("*").alias("total_pairs"), passed.alias("passed_pairs"), (F.count("*") - passed).alias("failed_pairs"),
        zero(F.avg("compression_ratio")).alias("avg_compression_ratio"), zero(F.avg("min_equivalence")).alias("avg_equivalence"),
        zero(F.min("min_equivalence")).alias("min_equivalence"), (passed / F.greatest(F.count("*"), F.lit(1))).alias("pass_rate"),
        zero((1.0 - F.avg("compression_ratio")) * 100.0).alias("token_reduction_percent"),
    )


def per_model(results: DataFrame, scores_col: str = "equivalence_scores") -> DataFrame:
    return results.select(F.explode(scores_col).alias("model", "score")).groupBy("model").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("examples"), F.avg("compression_ratio").alias("avg_ratio"), F.avg("min_equivalence").alias("avg_equivalence"), F.min("min_equivalence").alias("min_equivalence"), F.avg("duration_ms").alias("avg_duration_ms"))


def validation_cost(pairs: Column, models: int, tasks: int = 2, tokens: int = 500) -> Column:
    """Two calls for each task and model; the mean price of all three models, whatever was chosen."""
    calls = pairs * 2 * tasks * models
    price = [sum(PRICES[m][side] for m in MODELS.values()) / len(MODELS) for side in (0, 1)]
    return calls * tokens / 1_000_000 * price[0] + calls * (tokens // 2) / 1_000_000 * price[1]


def training_cost(examples: Column, epochs: int, rate: float = 0.40, tokens: int = 500) -> Column:
    return examples * tokens * epochs / 1_000_000 * rate


def validation_lines(results: DataFrame, save_all: bool = False) -> DataFrame:
    """Rows as they are saved: the pair and a nested verdict; failing ones on request."""
    kept = results if save_all else results.where("passed")
    nested = F.struct("passed", "min_equivalence", "compression_ratio", "equivalence_scores", "llm_judge_used", F.when(F.size("llm_judge_scores") > 0, F.col("llm_judge_scores")).alias("llm_judge_scores"))
    return kept.select("verbose", "compressed", "domain", "metadata", nested.alias("validation"))
