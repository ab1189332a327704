
import pytest
from pyspark.sql import functions as F

from corpusloom import functions as C
from corpusloom.functions.scoring import parse_judge
from corpusloom.operators import costs, training, validate


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_cosine(spark):
    assert value(spark, C.cosine(arr(1, 2), arr(2, 4))) == pytest.approx(1)
    assert value(spark, C.cosine(arr(1, 0), arr(-1, 0))) == 0 and value(spark, C.cosine(arr(1, 0), arr(-1, 0), clip=False)) == -1
    assert value(spark, C.cosine(arr(0, 0), arr(1, 0))) == 0 and value(spark, C.cosine(F.lit(None).cast("array<double>"), arr(1, 0))) == 0
    v = value(spark, C.hashed_vector(F.lit("a b a c"), 16))
    assert sum(v) == 3 and len(v) == 16


def test_scores(spark):
    lit = F.lit
    assert value(spark, C.combined_score(lit(0.5), lit(0.2), None, 1, 1)) == pytest.approx(0.35)
    assert value(spark, C.combined_score(lit(0.5), lit(0.2), lit(1.0))) == pytest.approx(0.8)
    with pytest.raises(ValueError):
        C.combined_score(lit(1.0), lit(1.0), None, 0, 0)
    assert value(spark, C.task_score(lit("code_generation"), lit(0.4), lit(0.8))) == pytest.approx(0.6)
    assert value(spark, C.task_score(lit("code_generation"), lit(0.4), lit(0.0))) == 0.4 and value(spark, C.task_score(lit("qa"), lit(0.4), lit(0.8))) == 0.4
    assert value(spark, C.compression_ratio(lit(0), lit(5))) == 1 and value(spark, C.reduction_percent(C.compression_ratio(lit(100), lit(40)))) == pytest.approx(60)
    assert value(spark, C.is_equivalent(lit(0.75))) and not value(spark, C.is_equivalent(lit(0.7499)))
    facts = F.array(arr(1, 0), arr(0, 1)), F.array(arr(1, 0.1))
    assert value(spark, C.fact_overlap(*facts)) == pytest.approx((0.5 + 1) / 2)
    assert value(spark, C.fact_overlap(F.array(arr(1, 0), arr(1, 0), arr(0, 1)), facts[1])) == pytest.approx((0.5 + 1) / 2)
    a, b = "The price went up. The price went up! But the shop was closed", "the price went up and it rained all day long"
    exact = lambda x: F.array((x == "the price went up").cast("double"), (x == "it rained all day long").cast("double"), (x == "the shop was closed").cast("double"))
    assert value(spark, C.text_fact_overlap(F.lit(a), F.lit(b), exact)) == pytest.approx(0.5) and value(spark, C.text_fact_overlap(F.lit(a), F.lit(None).cast("string"), exact)) == 0
    assert value(spark, C.fact_overlap(facts[0], F.expr("cast(array() as array<array<double>>)"))) == 0


def test_judge(spark):
    good = '{"verdict": "Partial", "confidence": 1.5, "missing_from_verbose": ["a"]}'
    cases = [(good, "partial"), (f"```json\n{good}\n```", "partial"), (f"json {good}", "partial"), (f"```\n{good}\n```\ntrailing", "partial"), ('{"verdict": "maybe", "confidence": 1}', None), ("not json", None), ('{"verdict": "partial"}', None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, w string").select("w", parse_judge(F.col("t")).alias("x"), C.judge_or_partial(parse_judge(F.col("t"))).alias("y")).collect()
    for r in rows:
        assert (r.x and r.x.verdict) == r.w and r.y.verdict == "partial"
        if r.x:
            assert r.x.confidence == 1.0 and r.x.missing_from_verbose == ["a"] and r.x.missing_from_compressed == [] and r.x.reasoning == ""
    assert value(spark, C.verdict_score(F.lit("partial"), F.lit(0.5))) == pytest.approx(0.575)
    assert value(spark, C.verdict_score(F.lit("equivalent"), F.lit(0.0))) == 0.5


def test_validation(spark):
    pairs = spark.createDataFrame([(1, "long text {context}", "short", "code"), (2, "prose", "p", "nl")], "pair_id int, verbose string, compressed string, domain string")
    asked = validate.requests(pairs, ["claude", "gpt"]).collect()
    assert len(asked) == 8 and {(r.pair_id, r.task) for r in asked} == {(1, "code_generation"), (1, "reasoning"), (2, "qa"), (2, "reasoning")}
    assert all(r.verbose in r.verbose_prompt for r in asked)
    assert value(spark, validate.prompt(F.lit("summarization"), F.lit("X"))) == validate.PROMPTS["qa"].replace("{context}", "X")
    rows = [(1, "claude", "qa", 0.9, 0.0, None, 100, 40), (1, "claude", "reasoning", 0.7, 0.0, None, 100, 40), (1, "gpt", "qa", 0.75, 0.0, None, 100, 40), (2, "claude", "code_generation", 0.5, 0.5, 1.0, 0, 3)]
    scored = spark.createDataFrame(rows, "pair_id int, model string, task string, semantic double, ast_similarity double, judge_score double, verbose_tokens long, compressed_tokens long")
    out = {r.pair_id: r for r in validate.validate(scored).collect()}
    assert out[1].equivalence_scores == {"claude": pytest.approx(0.8), "gpt": 0.75} and out[1].min_equivalence == 0.75 and out[1].passed and not out[1].llm_judge_used
    assert out[2].min_equivalence == pytest.approx(0.8) and out[2].compression_ratio == 1.0 and out[2].llm_judge_scores == {"claude": 1.0}
    stats = validate.batch_stats(validate.validate(scored)).first()
    assert (stats.total_pairs, stats.passed_pairs, stats.failed_pairs, stats.pass_rate) == (2, 2, 0, 1.0)
    empty = validate.batch_stats(validate.validate(scored.limit(0))).first()
    assert (empty.total_pairs, empty.pass_rate, empty.avg_equivalence) == (0, 0.0, 0.0)
    saved = validate.validation_lines(validate.validate(scored, 0.78).join(pairs.withColumn("metadata", F.lit(None).cast("map<string,string>")), "pair_id"))
    assert [r.validation.passed for r in saved.collect()] == [True]


def test_costs(spark):
    log = spark.createDataFrame([("2026-01-01 10:00:00", "a", 1.0), ("2026-01-01 11:00:00", "b", 2.0), ("2026-01-02 00:00:00", "a", 40.0)], "t string, model string, cost_usd double").withColumn("timestamp", F.to_timestamp_ntz("t"))
    days = {str(r.day): (r.spend, r.state) for r in costs.limit_state(costs.spend_by_day(log), 40, 3).collect()}
    assert days == {"2026-01-01": (3.0, "warn"), "2026-01-02": (40.0, "exceeded")}
    assert {r.model: r.spend for r in costs.spend_by_model(log).collect()} == {"a": 41.0, "b": 2.0}
    assert costs.total_spend(log.limit(0)).first().spend == 0.0
    kept = costs.within_budget(log.withColumn("run", F.lit(1)), 2.5, ["timestamp"], "run")
    assert kept.count() == 2 and costs.within_budget(log.withColumn("run", F.lit(1)), 0.5, ["timestamp"], "run").count() == 1
    assert value(spark, C.call_cost(F.lit("gpt-4o-mini"), F.lit(1_000_000), F.lit(2_000_000))) == pytest.approx(1.35)
    assert value(spark, C.call_cost(F.lit("unknown"), F.lit(1_000_000), F.lit(1_000_000))) == 2.0
    assert value(spark, validate.training_cost(F.lit(2200), 3)) == pytest.approx(1.32)


def test_token_examples(spark):
    pairs = spark.createDataFrame([("verbose", "ab")], "verbose string, compressed string")
    rows = training.token_examples(training.chat_rows(pairs, system="s", prefix="p:"), C.char_codes, C.char_codes).first()
    ids = [ord(c) for c in "s\np:verboseab"]
    assert rows.example.tokens == ids[:-1] and rows.example.target_tokens == ids[1:] and rows.example.weights == [0] * (len(ids) - 3) + [1, 1]
    with pytest.raises(Exception, match="must not be empty"):
        spark.createDataFrame([([],)], "messages array<struct<role:string,content:string>>").select(C.prompt_and_completion(F.col("messages"))[0]).collect()
    assert training.text_rows(spark.createDataFrame([("{compressed}", "c")], "verbose string, compressed string"), "<{verbose}|{compressed}>").first().text == "<{compressed}|c>"


def test_test_examples(spark):
    chat = [([("system", "s"), ("user", "Compress:\n The text. "), ("user", "later")],), ([("system", "s")],), ([("user", "Compress:\n")],), ([("user", "def f(x):\n    return x;")],)]
    rows = training.test_examples(spark.createDataFrame(chat, "messages array<struct<role:string,content:string>>")).collect()
    assert sorted((r.input_text, r.domain) for r in rows) == [("The text.", "nl"), ("def f(x):\n    return x;", "code")]


def test_prompts_have_the_fixed_text(spark):
    want = {
        "qa": "Based on the following context, answer the question concisely.|@|Context:|X|@|Question: What are the key points mentioned?|Answer:",
        "reasoning": "Analyze the following information and explain the main implications.|@|Information:|X|@|Analysis:",
        "code_generation": "Based on the following specification, write the corresponding code.|@|Specification:|X|@|Code:",
    }
    for task, text in want.items():
        assert value(spark, validate.prompt(F.lit(task), F.lit("X"))).split("\n") == ["" if x == "@" else x for x in text.split("|")]


def test_pair_hash_keeps_places(spark):
    none = F.lit(None).cast("string")
    assert value(spark, C.pair_hash(none, F.lit("a"), F.lit("b"))) != value(spark, C.pair_hash(F.lit("a"), F.lit("b"), none))


def test_evaluation_summary(spark):
    rows = spark.createDataFrame([(0.5, 0.9, 10.0), (0.7, 0.7, 30.0)], "compression_ratio double, min_equivalence double, duration_ms double")
    s = validate.evaluation_summary(rows).first()
    assert (s.examples, s.avg_ratio, s.avg_equivalence, s.min_equivalence, s.avg_duration_ms) == (2, pytest.approx(0.6), pytest.approx(0.8), 0.7, 20.0)
