"""Seams for models: callables over batches of texts become DataFrame operators.

Each callable maps a list of texts to a list of results; `make` builds it once for each task, so a model loads once.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .functions import cache_key, cosine, judge_or_partial, parse_judge, strip, task_score, verdict_score
from .functions.scoring import VERDICTS, call_cost
from .operators.code_units import ast_similarity
from .operators.resume import with_cached

#: Parts of an error message that make a call worth repeating (fixed values).
RETRYABLE = ("rate", "429", "500", "502", "503", "520", "overloaded", "internal server error", "server error", "temporarily unavailable", "capacity")


def with_retries(call: Callable, times: int = 3, base: float = 2.0, most: float = 60.0, sleep: Callable = time.sleep) -> Callable:
    """The call, repeated after retryable errors with doubling pauses and jitter."""

    def run(*args):
        for k in range(times + 1):
            try:
                return call(*args)
            except Exception as error:
                if k == times or not any(s in str(error).lower() for s in RETRYABLE):
                    raise
                sleep(min(most, base * 2**k + random.random()))

    return run


def map_texts(df: DataFrame, text_col: str, out_col: str, make: Callable[[], Callable[[list], list]], kind: str = "string", batch: int = 32, ms_col: str | None = None, at_most: int | None = None) -> DataFrame:
    """Adds out_col, what the callable gives for each text, and on request ms_col, a text's part of its call's time. No more
    than at_most calls go on at once, if given: as many tasks share the rows."""
    small_batches(df.sparkSession)
    df = df if at_most is None else df.coalesce(at_most)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out_col}` {kind}" + (f", `{ms_col}` double" if ms_col else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for pdf in batches:
            values, took = [], []
            for a in range(0, len(pdf), batch):
                texts, began = pdf[text_col].iloc[a : a + batch].tolist(), time.perf_counter()
                values += call(texts)
                took += [(time.perf_counter() - began) * 1000 / len(texts)] * len(texts)
            yield pdf.assign(**{out_col: values} | ({ms_col: took} if ms_col else {}))

    return df.mapInPandas(run, schema)


def map_distinct_texts(df: DataFrame, text_col: str, out_col: str, make, kind: str = "string", batch: int = 32) -> DataFrame:
    """As map_texts, with one call for each distinct text."""
    once = map_texts(df.select(F.col(text_col).alias("seam_text")).distinct(), "seam_text", out_col, make, kind, batch)
    return df.join(once, df[text_col].eqNullSafe(F.col("seam_text")), "left").drop("seam_text")


def count_tokens(df: DataFrame, text_col: str, encoders: dict[str, Callable[[], Callable[[list], list]]], prefix: str = "tokens_") -> DataFrame:
    """Adds a column of counts for each named encoder; an encoder maps a list of texts to a list of id lists, null being
    empty. One encoder under several names is called once."""
    names: dict[int, str] = {}
    for name, make in encoders.items():
        col = f"{prefix}{name}"
        if id(make) in names:
            df = df.withColumn(col, F.col(names[id(make)]))
        else:
            df, names[id(make)] = map_texts(df, text_col, col, _lengths(make), "long"), col
    return df


def _lengths(make: Callable) -> Callable:
    def made() -> Callable[[list], list]:
        call = make()
        return lambda texts: [len(ids) for ids in call([t if isinstance(t, str) else None for t in texts])]

    return made


def encode_texts(df: DataFrame, text_cols: list[str], make: Callable[[], Callable[[list], list]], batch: int = 32) -> DataFrame:
    """Adds `<column>_vector` for each text column; every distinct text of all of them is encoded once. Vectors come back
    by the texts' SHA-256, so rows are not sorted by whole texts."""
    digest = lambda c: F.sha2(F.col(c), 256)
    every = df.select(F.explode(F.array(*text_cols)).alias("seam_text")).where("seam_text is not null").distinct()
    known = map_texts(every, "seam_text", "seam_vector", make, "array<double>", batch).select(digest("seam_text").alias("seam_key"), "seam_vector")
    df = df.withColumns({f"{c}_digest": digest(c) for c in text_cols})
    for c in text_cols:
        df = df.join(known.withColumnsRenamed({"seam_vector": f"{c}_vector"}), F.col(f"{c}_digest") == F.col("seam_key"), "left").drop("seam_key", f"{c}_digest")
    return df


def pair_equivalence(pairs: DataFrame, make: Callable, a: str = "verbose_output", b: str = "compressed_output", task_col: str | None = None) -> DataFrame:
    """Adds semantic (cosine of the texts' vectors, clipped; 0 where a text is null or empty) and equivalence (for code
    generation half of it and half the likeness of the syntax trees, where both can be parsed)."""
    filled = (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    out = encode_texts(pairs.withColumn("seam_filled", filled), [a, b], make)
    out = out.withColumn("semantic", F.when(F.col("seam_filled"), cosine(F.col(f"{a}_vector"), F.col(f"{b}_vector"))).otherwise(0.0)).drop(f"{a}_vector", f"{b}_vector", "seam_filled")
    if task_col is None:
        return out.withColumn("equivalence", F.col("semantic"))
    small_batches(pairs.sparkSession)
    likeness = ast_similarity(F.when(F.col(task_col) == "code_generation", F.col(a)), F.when(F.col(task_col) == "code_generation", F.col(b)))
    return out.withColumn("seam_ast", likeness).withColumn("equivalence", task_score(F.col(task_col), F.col("semantic"), F.col("seam_ast"))).drop("seam_ast")


def readable_verdict(reply: str | None) -> bool:
    """Whether `parse_judge` can read a reply, for retries where replies arrive."""
    try:
        text = reply.strip()
        if text.startswith("```"):
            rows = text.split("\n")
            stop = max((i for i, r in enumerate(rows) if r.strip() == "```"), default=len(rows))
            text = "\n".join(rows[1:stop])
        data = json.loads(text.removeprefix("json"))
        float(data["confidence"])
        return data["verdict"].lower() in VERDICTS
    except (AttributeError, KeyError, TypeError, ValueError):
        return False


def with_fallback(primary: Callable[[str], str], fallback: Callable[[str], str] | None = None, retries: int = 2, readable: Callable[[str], bool] = readable_verdict) -> Callable[[list], list]:
    """For the seams: asks the first model up to retries + 1 times while it fails or can't be read, then the second model
    once; null where neither gives a readable reply."""

    def ask(prompt: str) -> str | None:
        for model in [primary] * (retries + 1) + ([fallback] if fallback else []):
            try:
                reply = model(prompt)
            except Exception:  # any error of a model's client is a failed attempt
                continue
            if readable(reply):
                return reply
        return None

    return lambda prompts: [None if p is None else ask(p) for p in prompts]


def judge(df: DataFrame, prompt_col: str, primary: Callable[[], Callable[[str], str]], fallback: Callable[[], Callable[[str], str]] | None = None, retries: int = 2) -> DataFrame:
    """Adds judged (the reply as a struct, or a partial verdict of half confidence where no model could be read) and
    judge_score."""
    replies = map_texts(df, prompt_col, "seam_reply", lambda: with_fallback(primary(), fallback() if fallback else None, retries))
    out = replies.withColumn("judged", judge_or_partial(parse_judge(F.col("seam_reply")))).drop("seam_reply")
    return out.withColumn("judge_score", verdict_score(F.col("judged.verdict"), F.col("judged.confidence")))


def call_records(df: DataFrame, text_col: str, reply_col: str, model: str, operation: str, count: Callable[[Column], Column], now: Column | None = None) -> DataFrame:
    """Cost records of answered texts: token counts, price, model and operation, for the cost log."""
    rows = df.select((F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("timestamp"), F.lit(model).alias("model"), count(F.col(text_col)).cast("long").alias("input_tokens"), count(F.col(reply_col)).cast("long").alias("output_tokens"))
    return rows.withColumns({"cost_usd": call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")), "operation": F.lit(operation)})


def generate_pairs(texts: DataFrame, cache: DataFrame, make, prefix: str, domain: str, language: str | None = None, template: str = "{input}", metadata: dict[str, str] | None = None, **params) -> DataFrame:
    """(verbose, compressed, domain, language, metadata, key, hit): cached results where there are any, for the rest calls
    with the template's `{input}` replaced, replies stripped. A cache key tells languages apart."""
    params |= {"lang": language} if language else {}
    probed = with_cached(texts.select(F.col("text").alias("verbose"), cache_key(prefix, F.col("text"), **params).alias("key")), cache)
    hits = probed.where("cached is not null").select("verbose", F.col("cached").alias("compressed"), "key", F.lit(True).alias("hit"))
    asked = probed.where("cached is null").select("verbose", "key", F.replace(F.lit(template), F.lit("{input}"), F.col("verbose")).alias("seam_prompt"))
    misses = map_texts(asked, "seam_prompt", "compressed", make).drop("seam_prompt").withColumns({"compressed": strip(F.col("compressed")), "hit": F.lit(False)})
    more = F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv)) if metadata else F.lit(None).cast("map<string,string>")
    return hits.unionByName(misses).select("verbose", "compressed", F.lit(domain).alias("domain"), F.lit(language).cast("string").alias("language"), more.alias("metadata"), "key", "hit")


def generation_counters(generated: DataFrame) -> DataFrame:
    """(cached_count, generated_count) of generated pairs."""
    return generated.agg(F.count_if("hit").alias("cached_count"), F.count_if(~F.col("hit")).alias("generated_count"))
