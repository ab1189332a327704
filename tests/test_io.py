import json

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas, seams
from corpusloom.operators import chunks, code_units, corpus, runs
from corpusloom.sources import readers, sinks
from corpusloom.streaming.incremental import append_new, run_with_budget


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_modes(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"text": "é"}, "", "{bad", {"other": 1})
    assert sorted((r.text or "") for r in readers.read_jsonl(spark, p, "text string", "skip").collect()) == ["", "é"]
    assert readers.read_jsonl(spark, p, "text string", "keep").where("bad").count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p, "text string").collect()
    assert readers.read_optional(spark, str(tmp_path / "none.jsonl"), "text string").count() == 0
    assert readers.count_lines(spark, p) == 3 and readers.count_lines(spark, p, blank=True) == 4
    assert [r.text for r in readers.read_field(spark, p).collect()] == ["é"]


def test_prose_and_corpus(spark, tmp_path):
    lines(tmp_path / "d/x/a.jsonl", {"text": "t" * 50}, {"text": "t" * 49}, "{bad", {"body": "b" * 60})
    assert readers.read_prose(spark, str(tmp_path / "d")).count() == 1
    assert readers.read_prose(spark, str(tmp_path / "d"), ("*.jsonl", "a.*")).count() == 2
    assert readers.read_prose(spark, str(tmp_path / "d"), field="body").count() == 1
    a = lines(tmp_path / "one.jsonl", {"text": "x" * 120, "source": "s"}, {"content": "y" * 120}, {"text": "short"}, "{bad", "")
    b = lines(tmp_path / "two.jsonl", {"code": "x" * 120, "language": "python"})
    merged = corpus.merge(readers.read_corpus_files(spark, [a, str(tmp_path / "missing.jsonl"), b]).where("not bad"), "nl")
    got = {(r.text[0], r.source) for r in corpus.merged_rows(merged).collect()}
    assert got == {("x", "s"), ("y", "one")} and corpus.merge_stats(merged).first().duplicates == 1
    g = lines(tmp_path / "gen.jsonl", {"text": "a" * 50}, {"code": "b" * 51}, {"text": "", "content": "c" * 60}, {"text": "d" * 70})
    assert [r.text[0] for r in readers.read_generation_corpus(spark, g, 2).collect()] == ["b", "c"]


def test_paragraphs(spark, tmp_path):
    p = lines(tmp_path / "p.txt", "one\ntwo\n\n  three  \n\n")
    assert [r.text for r in readers.read_paragraphs(spark, p).collect()] == ["one\ntwo", "three"]
    q = lines(tmp_path / "q.txt", "one\n two ")
    assert [r.text for r in readers.read_paragraphs(spark, q).collect()] == ["one", "two"]


def test_files(spark, tmp_path):
    code = "def f(x):\n    y = x + 1\n    z = y * 2\n    label = 'some text that makes it long enough to keep here'\n    return y, z, label\n"
    for name in ("src/a.py", "src/tests/deep/b.py", "src/test_c.py"):
        lines(tmp_path / name, code)
    (tmp_path / "src/bad.py").write_bytes(b"x = '\xff\xfe'")
    lines(tmp_path / "src/broken.py", "def (")
    files = readers.read_python(spark, str(tmp_path / "src"))
    assert sorted(r.relative for r in files.collect()) == ["a.py", "broken.py"]
    found = code_units.code_units(files)
    assert [(r.name, r.unit_type, r.metadata) for r in found.collect()] == [("f", "function", None)]
    assert corpus.code_corpus_summary(found).first().n_function == 1
    assert sinks.write_code_corpus(found, str(tmp_path / "out")) == 1
    row = json.loads(next(x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()))
    assert row["text"].startswith("def f") and "metadata" not in row and "code" not in row
    lines(tmp_path / "md/a.md", "# T\n\n" + "A paragraph that is long enough to be kept by the window.")
    lines(tmp_path / "md/x/b.markdown", "tiny")
    md = chunks.markdown_chunks(readers.read_markdown(spark, str(tmp_path / "md")).withColumnRenamed("path", "source_file"), "source", ["source_file"])
    assert md.count() == 1 and sinks.write_chunks(md, str(tmp_path / "chunks")) == 1


def test_pairs_and_training_files(spark, tmp_path):
    ok, bad = {"passed": True, "min_equivalence": 0.9}, {"passed": False}
    lines(tmp_path / "v/nl_pairs.jsonl", {"verbose": "v1 é", "compressed": "c1", "domain": "nl", "validation": ok}, {"verbose": "v2", "compressed": "c2", "domain": "nl", "validation": bad}, {"verbose": "v3", "compressed": "c3", "domain": "nl"})
    pairs = readers.read_validated_pairs(spark, str(tmp_path / "v"))
    assert sorted(r.verbose for r in pairs.collect()) == ["v1 é", "v3"]
    for write in (sinks.write_chat, sinks.write_completions, sinks.write_text):
        assert write(pairs, str(tmp_path / write.__name__)) == 2
    assert "v1 é" in "".join(p.read_text() for p in (tmp_path / "write_chat").glob("*.json"))
    assert sinks.write_pairs(pairs, str(tmp_path / "w")) == 2 and sinks.write_pairs(pairs, str(tmp_path / "w"), append=True) == 2
    assert spark.read.json(str(tmp_path / "w")).count() == 4
    split = corpus.split(pairs.select("verbose", "domain"), F.col("verbose"), ["domain"], ["nl", "code"])
    sinks.write_splits(split, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_splits(split.limit(0), str(tmp_path / "s2"))


def test_runs(spark, tmp_path):
    log = "Loading\nTrainable parameters: 0.183% (7.340M/4022.468M)\nStarting training..., iters: 50\nIter 1: Val loss 2.5, Val took 1s\nIter 10: Train loss 2.0, Learning Rate 1.000e-05, It/sec 0.5, Tokens/sec 150.0, Trained Tokens 900, Peak mem 7.3 GB\nIter 20: Train loss 1.0, It/sec 1.5\nIter 20: Val loss 1.5\nSaved final weights to x\n"
    lines(tmp_path / "r/2026-02-01_01-28-37/train.log", log)
    lines(tmp_path / "r/2026-02-02_00-00-00_b/train.log", "Starting training\nValueError: bad thing ")
    lines(tmp_path / "r/notes/train.log", "x")
    logs = readers.read_logs(spark, str(tmp_path / "r"))
    status = {r.run: r.s for r in logs.select("run", runs.run_status(F.col("content")).alias("s")).collect()}
    assert status == {"2026-02-01_01-28-37": "complete", "2026-02-02_00-00-00_b": "Error: bad thing"}
    numbered = runs.log_lines(logs)
    m = runs.metric_lines(numbered).where("run like '%37'").orderBy("line_idx").collect()
    assert [(r.iteration, r.kind, r.train_loss, r.val_loss, r.tokens_sec) for r in m] == [(1, "val", None, 2.5, None), (10, "train", 2.0, None, 150.0), (20, "train", 1.0, None, None), (20, "val", None, 1.5, None)]
    s = runs.run_summary(runs.metric_lines(numbered)).first()
    assert (s.first_train_loss, s.last_train_loss, s.first_val_loss, s.min_val_loss, s.mean_it_sec, s.last_trained_tokens, s.train_reduction_percent) == (2.0, 1.0, 2.5, 1.5, 1.0, 900, 50.0)
    h = runs.header(numbered).where("run like '%37'").select("*", runs.size_number(F.substring_index("trainable_params", "/", 1)).alias("n")).first()
    assert (h.total_iters, h.trainable_percentage, h.n) == (50, 0.183, 7_340_000.0)
    assert runs.latest_run(logs, "run").first().run == "2026-02-02_00-00-00_b"
    out = spark.createDataFrame([("x\nTest loss 2.2, Test ppl 9.290.",), ("PPL: 3",), ("ppl none",)], "t string").select(runs.perplexity(F.col("t")).alias("x")).collect()
    assert [r.x for r in out] == [9.29, 3.0, None]


def test_cost_log(spark, tmp_path):
    p = lines(tmp_path / "c.jsonl", {"timestamp": "2026-01-01T10:00:00.5", "model": "m", "input_tokens": 1, "output_tokens": 2, "cost_usd": 0.5, "operation": "o"})
    assert readers.read_cost_log(spark, p).first().cost_usd == 0.5 and readers.read_cost_log(spark, str(tmp_path / "no")).count() == 0


def test_adapters(spark):
    chat = spark.createDataFrame([(1, [("user", "q" * 60), ("assistant", "a"), ("user", "r" * 60)], "p"), (2, [("assistant", "a")], "s" * 150), (3, [], None)], "idx int, messages array<struct<role:string,content:string>>, prompt string")
    assert [r.text for r in readers.multi_turn(chat, limit=None).collect()] == ["q" * 60 + "\n\n" + "r" * 60, "s" * 150]
    assert sorted(r.text[0] for r in readers.multi_turn(chat, limit=5).collect()) == ["q", "s"]
    code = spark.createDataFrame([(i, t) for i, t in enumerate(["def a(): pass\n" * 20, "def a(): pass\n" * 20, "no keyword " * 20, "class"])], "idx int, content string")
    assert [(r.language, r.source) for r in readers.remote_code(code, "content", "src").collect()] == [("python", "src")]
    inst = spark.createDataFrame([(1, "i" * 120, "", "c"), (2, "i" * 120 + "```" * 3, None, "c"), (3, "x", "y", "c"), (4, "z" * 60, "k" * 60, "c")], "idx int, instruction string, context string, category string")
    assert sorted(r.text[0] for r in readers.instructions(inst).collect()) == ["i", "k"]


def test_seams(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("503 overloaded")
        return x

    assert seams.with_retries(flaky, sleep=lambda _: None)(1) == 1 and len(calls) == 3
    with pytest.raises(RuntimeError):
        seams.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("no")), sleep=lambda _: None)()
    frame = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    make = lambda: lambda xs: [None if x is None else x.upper() for x in xs]
    assert sorted((r.out or "") for r in seams.map_texts(frame, "text", "out", make).collect()) == ["", "A", "A"]
    assert sorted((r.out or "") for r in seams.map_distinct_texts(frame, "text", "out", make).collect()) == ["", "A", "A"]
    from corpusloom.functions import cache_key

    cache = spark.createDataFrame([("b", "cached b")], "t string, value string").select(cache_key("p", F.col("t"), temp=1).alias("key"), "value", F.lit(None).cast("timestamp").alias("expires_at"))
    out = seams.generate_pairs(spark.createDataFrame([("a",), ("b",)], "text string"), cache, make, "p", "nl", temp=1)
    assert sorted((r.verbose, r.compressed, r.hit) for r in out.collect()) == [("a", "A", False), ("b", "cached b", True)]


def test_incremental(spark, tmp_path):
    schema, out_schema = "verbose string", "verbose string, compressed string"
    target, source = str(tmp_path / "out"), tmp_path / "in"
    lines(source / "1.json", {"verbose": "a"}, {"verbose": "b"})

    def work(rows):
        return rows.withColumn("compressed", F.upper("verbose"))

    run = lambda: append_new(spark, str(source), schema, work, target, out_schema, F.md5("verbose"), str(tmp_path / "ck")).awaitTermination()
    run()
    lines(source / "2.json", {"verbose": "b"}, {"verbose": "c"})
    run()
    assert sorted(r.verbose for r in spark.read.schema(out_schema).json(target).collect()) == ["a", "b", "c"]
    # a batch that failed after its results were written replaces them, and finds its own rows not done
    import shutil

    shutil.rmtree(tmp_path / "ck/commits")
    shutil.rmtree(tmp_path / "ck/keys/batch=1")
    run()
    assert sorted(r.verbose for r in spark.read.schema(out_schema).json(target).collect()) == ["a", "b", "c"]
    todo = spark.createDataFrame([(str(i), 1.0) for i in range(40)], "verbose string, cost_usd double")
    spent = run_with_budget(spark, todo, lambda d: d, str(tmp_path / "b"), 12.0, 8, F.col("verbose"))
    assert 12.0 < spent < 40 and spark.read.schema("verbose string").json(str(tmp_path / "b")).count() == spent


def test_schemas_parse(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper():
            spark.createDataFrame([], ddl)


def test_run_directories_and_cache(spark, tmp_path):
    from datetime import UTC, datetime

    run = sinks.new_run(str(tmp_path / "runs"), {"iters": 5}, datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC))
    assert run.name == "2026-01-02_03-04-05" and (tmp_path / "runs/latest").resolve() == run.resolve()
    assert json.loads((run / "run.json").read_text()) == {"started_at": "2026-01-02T03:04:05Z", "iters": 5}
    again = sinks.new_run(str(tmp_path / "runs"), {}, datetime(2026, 1, 3, tzinfo=UTC))
    assert (tmp_path / "runs/latest").resolve() == again.resolve()
    (tmp_path / "other/latest").mkdir(parents=True)
    with pytest.raises(ValueError):
        sinks.new_run(str(tmp_path / "other"), {})
    entries = sinks.cache_entries(spark.createDataFrame([("k", "v")], "k string, v string"), "k", "v", 60)
    assert sinks.append_jsonl(entries, str(tmp_path / "cache")) == 1 and entries.where("expires_at > written_at").count() == 1


def test_settings():
    from corpusloom.settings import Settings

    s = Settings.from_env({"SEED": "7", "COST_LIMIT_DAILY_USD": "1.5", "OTHER": "x"})
    assert (s.seed, s.cost_limit_daily_usd, s.harness_threshold) == (7, 1.5, 0.72)
    with pytest.raises(ValueError):
        Settings().updated({"nope": 1})


def test_preview(spark):
    from corpusloom.operators.evaluate import preview

    rows = preview(spark.createDataFrame([("x" * 200,), ("y",)], "t string"), "t", width=5).collect()
    assert sorted(r.t for r in rows) == ["xxxxx...", "y"]


def test_lines_of_a_file_are_read_in_splits(spark, tmp_path):
    """Many tasks for one file, in the order of its lines all the same."""
    path = lines(tmp_path / "big.jsonl", *({"text": f"{k} " + "w" * 90, "source": "s"} for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        frame = readers.text_lines(spark, path)
        assert frame.rdd.getNumPartitions() > 4
        assert [json.loads(r.value)["text"].split()[0] for r in frame.orderBy("file", "line_idx").collect()] == [str(k) for k in range(3000)]
        assert [r.text.split()[0] for r in readers.read_generation_corpus(spark, path, 700).collect()] == [str(k) for k in range(700)]
        merged = corpus.merge(readers.read_corpus_files(spark, [path, path]).where("not bad"), "nl", low=10)
        assert {(r.file_idx, r.status): r["count"] for r in merged.groupBy("file_idx", "status").count().collect()} == {(0, "kept"): 3000, (1, "duplicate"): 3000}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_done_hashes_and_pairs(spark, tmp_path):
    from corpusloom.functions import pair_hash
    from corpusloom.operators.resume import not_done

    p = lines(tmp_path / "done.jsonl", {"verbose": "v", "compressed": "c", "domain": "nl", "validation": {"passed": False}}, "{broken", {"verbose": "only"}, "", {"verbose": "v", "compressed": "c", "domain": "nl"})
    done = readers.read_done_hashes(spark, p)
    assert done.count() == 1 and readers.read_done_hashes(spark, str(tmp_path / "no.jsonl")).count() == 0
    q = lines(tmp_path / "pairs.jsonl", {"verbose": "v", "compressed": "c", "domain": "nl"}, {"verbose": "w", "compressed": "c", "domain": "nl"})
    pairs = readers.read_pairs(spark, q)
    assert [r.verbose for r in pairs.join(done, pair_hash(F.col("domain"), F.col("verbose"), F.col("compressed")) == F.col("pair_hash"), "left_anti").collect()] == ["w"]


def test_one_markdown_file(spark, tmp_path):
    lines(tmp_path / "md/a.md", "# T\n\ntext")
    lines(tmp_path / "md/b.md", "other")
    assert [(r.relative, r.source) for r in readers.read_markdown_file(spark, str(tmp_path / "md/a.md")).collect()] == [("a.md", "# T\n\ntext\n")]


def test_cache_delete_and_clear(spark, tmp_path):
    from corpusloom.operators.resume import with_cached

    path, schema = str(tmp_path / "cache"), "key string, value string, expires_at timestamp, written_at timestamp"
    entries = spark.createDataFrame([("k", "v"), ("l", "w")], "k string, v string")
    sinks.append_jsonl(sinks.cache_entries(entries, "k", "v"), path)
    asked = spark.createDataFrame([("k",), ("l",), ("m",)], "key string")
    found = lambda: {r.key: r.cached for r in with_cached(asked, spark.read.schema(schema).json(path)).collect()}
    assert found() == {"k": "v", "l": "w", "m": None}
    sinks.delete_cached(asked.where("key = 'k'"), path)
    assert found() == {"k": None, "l": "w", "m": None}
    sinks.append_jsonl(sinks.cache_entries(entries.where("k = 'k'"), "k", "v"), path)
    assert found()["k"] == "v"
    sinks.clear_cache(spark, path)
    assert set(found().values()) == {None}


def test_run_files(tmp_path):
    config = sinks.lora_config("m", "d", "a", rank=8, alpha=16, iters=5, grad_checkpoint=True)
    assert config["lora_parameters"]["scale"] == 2.0
    sinks.write_yaml(config, str(tmp_path / "x/lora.yaml"))
    assert (tmp_path / "x/lora.yaml").read_text().splitlines() == ['adapter_path: "a"', 'data: "d"', "grad_checkpoint: true", "iters: 5", "lora_parameters:", "  alpha: 16", "  dropout: 0.0", "  rank: 8", "  scale: 2.0", 'model: "m"']
    assert sinks.git_sha(str(tmp_path)) == "unknown" and sinks.sample_path("data/", "org/set") == "data/org_set_train.jsonl"


def test_settings_groups(tmp_path):
    from corpusloom.settings import Generation, Training, load_yaml

    (tmp_path / "t.yaml").write_text('{"cloud": {"model": "m", "training": {"epochs": "5", "learning_rate": 0.1}}}')
    t = Training().with_cloud(load_yaml(str(tmp_path / "t.yaml")))
    assert (t.cloud_model, t.cloud_epochs, t.cloud_lr, t.cloud_batch_size) == ("m", 5, 0.1, 4) and Training().with_cloud(None) == Training()
    assert Generation().updated({"temperature": "0.1"}).temperature == 0.1
