"""Training files: chat, completion and text rows of validated pairs, token examples, test examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masked_example, prompt_and_completion, strip
from ..functions.classify import score_and_domain

#: What a chat row says around a pair (fixed prefix; the system prompt is a parameter).
SYSTEM_PROMPT = "Rewrite the text in a compact form that keeps every fact."
USER_PREFIX = "Compress:\n"


def chat_messages(verbose: Column, compressed: Column, system: str = SYSTEM_PROMPT, prefix: str = USER_PREFIX) -> Column:
    said = (("system", F.lit(system)), ("user", F.concat(F.lit(prefix), verbose)), ("assistant", compressed))
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said))


def chat_rows(pairs: DataFrame, **texts) -> DataFrame:
    return pairs.select(chat_messages(F.col("verbose"), F.col("compressed"), **texts).alias("messages"))


def completion_rows(pairs: DataFrame, prefix: str = USER_PREFIX) -> DataFrame:
    return pairs.select(F.concat(F.lit(prefix), F.col("verbose")).alias("prompt"), F.col("compressed").alias("completion"))


def text_rows(pairs: DataFrame, template: str = "### Input:\n{verbose}\n\n### Output:\n{compressed}") -> DataFrame:
    """The template with both texts put in; texts that look like places of the template stay as they are."""
    out, rest = [], template
    while True:
        spots = sorted((rest.find(m), m) for m in ("{verbose}", "{compressed}") if m in rest)
        if not spots:
            break
        at, mark = spots[0]
        out += [F.lit(rest[:at]), F.col(mark[1:-1])]
        rest = rest[at + len(mark) :]
    return pairs.select(F.concat(*out, F.lit(rest)).alias("text"))


def passed_or_unjudged(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.coalesce(F.col("validation.passed"), F.lit(True)))


def token_examples(rows: DataFrame, encode_prompt, encode_completion) -> DataFrame:
    """Loss-masked examples of chat rows; the two encoders take a column and give an array column."""
    prompt, completion = prompt_and_completion(F.col("messages"))
    return rows.select("*", masked_example(encode_prompt(prompt), encode_completion(completion)).alias("example"))


def test_examples(rows: DataFrame, prefix: str = USER_PREFIX) -> DataFrame:
    """(input_text, domain): the first user message without the prefix, classified; rows without one are dropped."""
    said = F.filter("messages", lambda m: m.role == "user")
    text = strip(F.replace(F.when(F.size(said) > 0, F.element_at(said, 1).content), F.lit(prefix), F.lit("")))
    out = rows.withColumn("input_text", text).where("input_text <> ''")
    return out.withColumn("domain", score_and_domain(F.col("input_text"))["domain"]).drop("messages")
