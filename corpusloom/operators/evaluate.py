"""Evaluation of a generator on test examples, detailed comparison of two texts, previews and projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import atomic_facts, compression_ratio, lexical_overlap, normalize_for_comparison, regex_token_count
from ..functions.classify import score_and_domain
from ..seams import map_texts, pair_equivalence
from .training import test_examples


def detailed_equivalence(a: Column, b: Column, semantic: Column, facts: bool = False, overlap: Column | None = None) -> Column:
    """struct of the scores of two texts and of what they are computed from."""
    parts = [
        semantic.alias("semantic_similarity"), lexical_overlap(a, b).alias("lexical_overlap_raw"),
        normalize_for_comparison(a).alias("verbose_normalized"), normalize_for_comparison(b).alias("compressed_normalized"),
    ]
    if facts:
        parts += [atomic_facts(a).alias("verbose_facts"), atomic_facts(b).alias("compressed_facts"), (F.lit(None).cast("double") if overlap is None else overlap).alias("fact_overlap")]
    return F.struct(*parts)


def quick_equivalence(pairs: DataFrame, make: Callable, a: str, b: str) -> DataFrame:
    """Adds semantic, the clipped cosine of two texts' vectors from an encoder."""
    return pair_equivalence(pairs, make, a, b).drop("equivalence")


def evaluate(chat_rows: DataFrame, make_generator: Callable, score: Callable[[Column, Column], Column] | dict[str, Callable[[Column, Column], Column]], count: Callable[[Column], Column] = regex_token_count, min_equivalence: float = 0.0, limit: int | None = None) -> DataFrame:
    """Test examples through the generator, scored and gated by this call's own threshold: input_text, domain,
    compressed_text, compression_ratio, min_equivalence, equivalence_scores, passed, duration_ms.

    `score` gives the equivalence of input and output columns, or one for each model by name; the least counts. A limit
    takes the first rows by `idx`, or by input text where there is none."""
    examples = test_examples(chat_rows)
    if limit is not None:
        examples = examples.orderBy("idx" if "idx" in examples.columns else "input_text").limit(limit)
    names = [*examples.columns, "compressed_text", "duration_ms"]
    out = map_texts(examples.drop("domain"), "input_text", "compressed_text", make_generator, ms_col="duration_ms")
    out = out.withColumn("domain", score_and_domain(F.col("input_text"))["domain"]).select(*names)
    a, b = F.col("input_text"), F.col("compressed_text")
    models = score if isinstance(score, dict) else {"model": score}
    out = out.withColumn("equivalence_scores", F.create_map(*(x for k, f in sorted(models.items()) for x in (F.lit(k), f(a, b).cast("double")))))
    out = out.withColumns({"compression_ratio": compression_ratio(count(a), count(b)), "min_equivalence": F.array_min(F.map_values("equivalence_scores"))})
    return out.withColumn("passed", F.col("min_equivalence") >= min_equivalence)


def preview(df: DataFrame, text_col: str, n: int = 5, width: int = 100, order: list[str] | None = None) -> DataFrame:
    """The first rows in order (by the text itself unless given) with texts cut to a width, as shown before a run."""
    return df.orderBy(*(order or [text_col])).limit(n).withColumn(text_col, F.when(F.length(text_col) > width, F.concat(F.substring(text_col, 1, width), F.lit("..."))).otherwise(F.col(text_col)))


def split_preview(total: Column, train: float = 0.8, valid: float = 0.1) -> Column:
    """struct(train, valid, test) of an unstratified split."""
    a, b = F.floor(total * train), F.floor(total * valid)
    return F.struct(a.alias("train"), b.alias("valid"), (total - a - b).alias("test"))
