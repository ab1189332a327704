"""Seams end to end: tokenizers, encoders, judges with a second model, generation and evaluation."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom import seams
from corpusloom.functions import compression_ratio, cosine, text_cost
from corpusloom.functions.tokens import rank_encoder
from corpusloom.operators import evaluate, training

TEXTS = ["plain words, and more", "", None, "é 日本語 🙂", "x" * 3000, "plain words, and more"]


def test_exact_token_counts(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    make = rank_encoder(path, public_tokenizers.PATTERN)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    names = dict.fromkeys(("openai", "claude", "gemini"), make)
    rows = seams.count_tokens(frame, "t", names).withColumn("price", text_cost(F.lit("gpt-4o-mini"), F.col("tokens_openai")))
    encode = make()([t for t in TEXTS])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={}) if hasattr(tiktoken, "load") else None
    for r in rows.collect():
        n = len(encode[r.i])
        assert r.tokens_openai == r.tokens_claude == r.tokens_gemini == n and r.price == pytest.approx(n / 1e6 * 0.15)
        assert library is None or n == len(library.encode_ordinary(TEXTS[r.i] or ""))
    half = seams.count_tokens(frame.withColumn("h", F.substring("t", 1, 5)), "h", {"short": make}).join(rows.select("i", "tokens_openai"), "i")
    ratios = half.select("i", compression_ratio(F.col("tokens_openai"), F.col("tokens_short")).alias("r")).collect()
    assert {r.r for r in ratios if not TEXTS[r.i]} == {1.0}


def vowels():
    return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]


def test_pair_equivalence(spark):
    rows = [(1, "a e", "a e", "qa"), (2, "a", "e", "qa"), (3, "", "a", "qa"), (4, None, "a", "qa"), (5, "a = 1", "a = 1", "code_generation"), (6, "a = (", "a = (", "code_generation"), (1, "a e", "a e", "qa")]
    frame = spark.createDataFrame(rows, "i int, verbose_output string, compressed_output string, task string")
    got = {r.i: (round(r.semantic, 6), round(r.equivalence, 6)) for r in seams.pair_equivalence(frame, vowels, task_col="task").collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (1, 1), 6: (1, 1)}
    assert seams.pair_equivalence(frame, vowels).count() == len(rows)
    assert evaluate.quick_equivalence(frame, vowels, "verbose_output", "compressed_output").where("i = 2").first().semantic == 0


GOOD = '{"verdict": "equivalent", "confidence": 0.8}'


def test_judge_retries_then_asks_the_second_model(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("503")
        return f"```json\n{GOOD}\n```"

    assert seams.with_fallback(flaky)(["p", None]) == [f"```json\n{GOOD}\n```", None] and len(calls) == 3
    for reply, ok in ((GOOD, True), (f"json {GOOD}", True), ("{}", False), (None, False), ('{"verdict": "maybe", "confidence": 1}', False), ('{"verdict": 3, "confidence": 1}', False)):
        assert seams.readable_verdict(reply) == ok, reply
    asked = []
    second = lambda p: asked.append(p) or GOOD
    assert seams.with_fallback(lambda p: "no json", second, retries=1)(["p"]) == [GOOD] and asked == ["p"]
    frame = spark.createDataFrame([("good",), ("bad",), (None,)], "prompt string")
    make = lambda: lambda p: '{"verdict": "equivalent", "confidence": 0.8}' if p == "good" else "?"
    rows = {r.prompt: r for r in seams.judge(frame, "prompt", make).collect()}
    assert (rows["good"].judged.verdict, round(rows["good"].judge_score, 6)) == ("equivalent", 0.9)
    assert (rows["bad"].judged.verdict, rows["bad"].judged.confidence) == ("partial", 0.5) == (rows[None].judged.verdict, rows[None].judged.confidence)
    backed = {r.prompt: r.judged.verdict for r in seams.judge(frame, "prompt", make, lambda: lambda p: '{"verdict": "not_equivalent", "confidence": 1}').collect()}
    assert backed["bad"] == "not_equivalent"


def test_generated_pairs_have_prompt_language_and_metadata(spark):
    from corpusloom.functions import cache_key

    make = lambda: lambda prompts: [f"  {p.upper()} \n" for p in prompts]
    texts = spark.createDataFrame([("def f(): {x}",), ("cached",)], "text string")
    cache = spark.createDataFrame([("cached", "was here")], "t string, value string").select(cache_key("code", F.col("t"), model="m", lang="python").alias("key"), "value", F.lit(None).cast("timestamp").alias("expires_at"))
    out = seams.generate_pairs(texts, cache, make, "code", "code", language="python", template="Short: {input}!", metadata={"by": "m"}, model="m")
    rows = {r.verbose: r for r in out.collect()}
    assert rows["def f(): {x}"].compressed == "SHORT: DEF F(): {X}!" and rows["cached"].compressed == "was here"
    assert {(r.domain, r.language, r.metadata["by"]) for r in rows.values()} == {("code", "python", "m")}
    assert tuple(seams.generation_counters(out).first()) == (1, 1)
    other = seams.generate_pairs(texts, cache, make, "code", "code", language="go", model="m")
    assert tuple(seams.generation_counters(other).first()) == (0, 2)


def test_call_records(spark):
    frame = spark.createDataFrame([("abcd", "ab")], "t string, r string")
    r = seams.call_records(frame, "t", "r", "gpt-4o-mini", "judge", F.length).first()
    assert (r.model, r.input_tokens, r.output_tokens, r.operation) == ("gpt-4o-mini", 4, 2, "judge") and r.cost_usd == pytest.approx((4 * 0.15 + 2 * 0.6) / 1e6)


def test_evaluation_by_model_appended(spark, tmp_path):
    from corpusloom import schemas
    from corpusloom.sources import sinks

    pairs = spark.createDataFrame([("a long text here", "short"), ("another one", "one")], "verbose string, compressed string")
    scores = {"m1": lambda a, b: F.length(b) / F.length(a), "m2": lambda a, b: cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0)))}
    out = evaluate.evaluate(training.chat_rows(pairs), lambda: lambda ts: [t[: len(t) // 2] for t in ts], scores, min_equivalence=0.48)
    for _ in range(2):
        sinks.append_jsonl(out, str(tmp_path / "evaluation"))
    rows = spark.read.schema(schemas.EVALUATION).json(str(tmp_path / "evaluation")).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.equivalence_scores == {"m1": pytest.approx(r.min_equivalence), "m2": 1.0} and r.passed == (r.min_equivalence >= 0.48) and r.duration_ms >= 0
    assert evaluate.evaluate(training.chat_rows(pairs), lambda: lambda ts: ts, scores, limit=1).first().input_text == "a long text here"


def test_calls_at_once_are_bounded(spark):
    frame = spark.range(40).selectExpr("cast(id as string) as t").repartition(8)
    out = seams.map_texts(frame, "t", "n", lambda: lambda ts: [len(t) for t in ts], "int", at_most=2)
    assert out.rdd.getNumPartitions() == 2 and out.agg(F.sum("n")).first()[0] == 70
