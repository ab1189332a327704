"""Scores of pairs: ratios, vector similarity, combined and fact scores, verdicts, prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import atomic_facts, let, strip, token_set
from ..schemas import JUDGE_REPLY

#: Score of each verdict of a judge at full confidence (fixed values).
VERDICTS = {"equivalent": 1.0, "partial": 0.65, "not_equivalent": 0.25}
#: US dollars for a million input and output tokens (fixed values); other models cost the default.
PRICES = {
    "claude-sonnet-4-20250514": (3.0, 15.0), "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-haiku-20240307": (0.25, 1.25),
    "gpt-4o": (2.50, 10.0), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.0, 30.0),
    "gemini-2.0-flash": (0.075, 0.30), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.30),
}
DEFAULT_PRICE = (1.0, 1.0)


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Compressed tokens for each original one; 1 where there were none."""
    counts = F.struct(original.alias("before"), compressed.alias("after"))
    return let(counts, lambda n: F.when(n.before > 0, n.after / n.before).otherwise(1.0))


def reduction_percent(ratio: Column) -> Column:
    return (1.0 - ratio) * 100.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clip: bool = True) -> Column:
    """Cosine of two vectors; 0 where one is null or zero; clipped to [0, 1] on request."""
    dots = lambda v: F.struct(dot(v.a, v.b).alias("ab"), (F.sqrt(dot(v.a, v.a)) * F.sqrt(dot(v.b, v.b))).alias("norm"))
    parts = let(F.struct(a.alias("a"), b.alias("b")), dots)

    def value(p: Column) -> Column:
        x = p.ab / p.norm
        return F.when(p.norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if clip else x).otherwise(0.0)

    return let(parts, value)


def hashed_vector(x: Column, size: int = 64) -> Column:
    """Offline stand-in for a sentence encoder: how many distinct tokens fall in each hash bucket. An approximation that
    says nothing about meaning; real encoders are passed in as vector columns."""
    buckets = F.transform(token_set(F.coalesce(x, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(buckets, zeros, lambda v, b: F.transform(v, lambda y, i: F.when(i == b, y + 1.0).otherwise(y)))


def combined_score(semantic: Column, lexical: Column, judge: Column | None = None, semantic_weight: float = 1.0, lexical_weight: float = 0.0) -> Column:
    """0.6 judge + 0.4 semantic where there is a judge's score, else the weighted mean."""
    if semantic_weight + lexical_weight == 0:
        raise ValueError("one weight must be above 0")
    mean = (semantic_weight * semantic + lexical_weight * lexical) / (semantic_weight + lexical_weight)
    return mean if judge is None else F.when(judge.isNotNull(), 0.6 * judge + 0.4 * semantic).otherwise(mean)


def task_score(task: Column, semantic: Column, ast_similarity: Column) -> Column:
    """Code generation: half structure, half meaning where the code could be parsed; other tasks: meaning."""
    return F.when((task == "code_generation") & (ast_similarity > 0), 0.5 * ast_similarity + 0.5 * semantic).otherwise(semantic)


def is_equivalent(score: Column, threshold: float = 0.75) -> Column:
    return score >= threshold


def fact_overlap(a: Column, b: Column, above: float = 0.8) -> Column:
    """Mean share of the facts (arrays of vectors) of each side that have one above the threshold on the other; a fact
    that is there twice counts once."""
    share = lambda x, y: F.size(F.filter(x, lambda u: F.exists(y, lambda v: cosine(u, v) > above))) / F.size(x)
    sets = F.struct(F.array_distinct(a).alias("x"), F.array_distinct(b).alias("y"))
    return let(sets, lambda s: F.when((F.size(s.x) > 0) & (F.size(s.y) > 0), (share(s.x, s.y) + share(s.y, s.x)) / 2.0).otherwise(0.0))


def text_fact_overlap(a: Column, b: Column, encode: Callable[[Column], Column] | None = None, above: float = 0.8) -> Column:
    """Overlap of the facts of two texts, as sets; `encode` makes a fact's vector."""
    vectors = lambda x: F.transform(F.array_distinct(atomic_facts(F.coalesce(x, F.lit("")))), encode or hashed_vector)
    return let(F.struct(vectors(a).alias("x"), vectors(b).alias("y")), lambda v: fact_overlap(v.x, v.y, above))


def parse_judge(reply: Column) -> Column:
    """struct of a judge's JSON reply, fences removed and confidence clamped; null where it can't be read."""
    return let(let(strip(reply), _reply_data), _reply_struct)


def _reply_data(x: Column) -> Column:
    lines = F.split(x, "\n")
    from_end = F.array_position(F.reverse(F.transform(lines, strip)), "```").cast("int")
    stop = F.when(from_end > 0, F.size(lines) - from_end).otherwise(F.size(lines))
    body = F.when(F.startswith(x, F.lit("```")), F.array_join(F.slice(lines, F.lit(2), F.greatest(stop - 1, F.lit(0))), "\n")).otherwise(x)
    body = F.when(F.startswith(body, F.lit("json")), strip(F.substring(body, 5, 1 << 30))).otherwise(body)
    return F.from_json(body, JUDGE_REPLY)


def _reply_struct(data: Column) -> Column:
    verdict = F.lower(data["verdict"])
    empty = F.expr("cast(array() as array<string>)")
    out = F.struct(
        verdict.alias("verdict"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), data["confidence"])).alias("confidence"),
        F.coalesce(data["reasoning"], F.lit("")).alias("reasoning"),
        F.coalesce(data["missing_from_compressed"], empty).alias("missing_from_compressed"),
        F.coalesce(data["missing_from_verbose"], empty).alias("missing_from_verbose"),
    )
    return F.when(verdict.isin(*VERDICTS) & data["confidence"].isNotNull(), out)


def judge_or_partial(judged: Column) -> Column:
    """The parsed reply, or a partial verdict of half confidence."""
    empty = F.expr("cast(array() as array<string>)")
    return F.coalesce(judged, F.struct(F.lit("partial").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("no readable reply").alias("reasoning"), empty.alias("missing_from_compressed"), empty.alias("missing_from_verbose")))


def verdict_score(verdict: Column, confidence: Column) -> Column:
    base = F.element_at(F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair)), verdict)
    return base * confidence + 0.5 * (1.0 - confidence)


def rate(model: Column, side: int, prices: dict = PRICES) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in prices.items() for x in (k, float(v[side]))))
    return F.coalesce(F.element_at(table, model), F.lit(DEFAULT_PRICE[side]))


def call_cost(model: Column, input_tokens: Column, output_tokens: Column, prices: dict = PRICES) -> Column:
    return input_tokens / 1_000_000 * rate(model, 0, prices) + output_tokens / 1_000_000 * rate(model, 1, prices)


def text_cost(model: Column, tokens: Column, is_input: bool = True) -> Column:
    """Price of a text for one of three models (fixed choice), else of the default rate."""
    few = {k: PRICES[k] for k in ("claude-sonnet-4-20250514", "gpt-4o-mini", "gemini-2.0-flash")}
    return tokens / 1_000_000 * rate(model, 0 if is_input else 1, few)
