"""Queries through files: what a sink has written is read again by a source, and the result is held against the tables.

Each query writes into a fresh folder: under spark.checkpoint.dir, which a cluster's machines share, or a temporary one
where that is unset and driver and executors are one process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas, seams
from ..functions import cache_key, pair_hash
from ..operators import corpus, resume, training, validate
from ..sources import readers, sinks
from ..streaming.incremental import append_new
from .queries import SQL_COUNT, corpus_inputs, cost_log, pairs, query, r6, split_documents, sql_strip, squeezed, table


def scratch(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='loom-')}/files-{uuid.uuid4().hex}"


@query("SELECT text, count(*) AS n FROM documents WHERE length(text) BETWEEN 50 AND 2000 GROUP BY 1")
def prose_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("text", "lang"), path)
    return readers.read_prose(spark, path, ("*.json",)).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def field_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, sf_dir, "documents").select(F.col("text").alias("body")), path)
    return readers.read_field(spark, path, "body").groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT text, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) WHERE length(text) > 50 GROUP BY 1")
def generation_corpus_files(spark, sf_dir):
    path, b = scratch(spark), table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("text", F.lit(None).cast("string").alias("content"))
    sinks.write_jsonl(d.unionByName(b.select(F.lit("").alias("text"), F.col("text").alias("content"))), path)
    return readers.read_generation_corpus(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT text AS body, 0 AS f FROM documents UNION ALL SELECT text, 1 FROM benchmark UNION ALL SELECT text, 2 FROM conversations)
SELECT body AS text, 'nl' AS domain, CASE min(f) WHEN 0 THEN 'documents' WHEN 1 THEN 'benchmark' ELSE 'conversations' END AS source FROM i WHERE length(body) BETWEEN 100 AND 2500 GROUP BY 1""")
def corpus_files(spark, sf_dir):
    """Three corpora as files, one of which is not there, merged, written and read again."""
    path = scratch(spark)
    rows = corpus_inputs(spark, sf_dir)
    paths = [f"{path}/documents.jsonl", f"{path}/missing.jsonl", f"{path}/benchmark.jsonl", f"{path}/conversations.jsonl"]
    for k, name in enumerate(("documents", "benchmark", "conversations")):
        sinks.write_jsonl(rows.where(F.col("file_idx") == k).select("text", "content", "code"), f"{path}/{name}.jsonl")
    merged = corpus.merged_rows(corpus.merge(readers.read_corpus_files(spark, paths).where("not bad"), "nl"))
    sinks.write_jsonl(merged, f"{path}/merged")
    return readers.read_jsonl(spark, f"{path}/merged", schemas.MERGED_ROW).select("text", "domain", "source")


@query("SELECT text AS verbose, replace(text, ' ', '') AS compressed, count(*) AS n FROM documents WHERE lang = 'en' OR lang <> 'fr' AND doc_id % 3 <> 0 GROUP BY 1, 2")
def validated_pair_files(spark, sf_dir):
    """Pairs judged by language, saved with their verdicts or without any; failing ones are saved and left out on reading."""
    path, d = scratch(spark), table(spark, sf_dir, "documents")
    judged = d.select(
        F.col("text").alias("verbose"), squeezed("text").alias("compressed"), F.lit("nl").alias("domain"), F.lit(None).cast("map<string,string>").alias("metadata"), "lang", "doc_id",
        (F.col("lang") != "fr").alias("passed"), F.lit(0.9).alias("min_equivalence"), F.lit(0.5).alias("compression_ratio"), F.create_map(F.lit("m"), F.lit(0.9)).alias("equivalence_scores"),
        F.lit(False).alias("llm_judge_used"), F.expr("cast(map() as map<string,double>)").alias("llm_judge_scores"),
    )
    known = judged.where("lang = 'fr' or lang = 'en'")
    sinks.append_jsonl(validate.validation_lines(known, save_all=True), f"{path}/nl_pairs.jsonl")
    bare = judged.where("lang not in ('en', 'fr') and doc_id % 3 <> 0").select("verbose", "compressed", "domain", "metadata")
    sinks.write_pairs(bare, f"{path}/code_pairs.jsonl", append=True)
    return readers.read_validated_pairs(spark, path).groupBy("verbose", "compressed").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT substr(sha256(lang || ':' || text || ':' || source), 1, 16) AS pair_hash FROM documents")
def done_hash_files(spark, sf_dir):
    """Hashes of saved pairs, with lines between them that can't be read or lack a part."""
    path, d = scratch(spark), table(spark, sf_dir, "documents")
    sinks.write_pairs(d.select(F.col("text").alias("verbose"), F.col("source").alias("compressed"), F.col("lang").alias("domain")), path)
    d.select(F.lit('{"verbose": "only"}').alias("value")).union(d.select(F.lit("{broken"))).write.mode("append").text(path)
    return readers.read_done_hashes(spark, path)


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def resume_from_files(spark, sf_dir):
    """Documents that no saved pair holds."""
    path, none = scratch(spark), F.lit("")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("verbose"))
    sinks.write_pairs(d.where("lang = 'en'").select("verbose", none.alias("compressed"), F.lit("nl").alias("domain")), path)
    done = readers.read_done_hashes(spark, path)
    todo = d.withColumn("pair_hash", pair_hash(F.lit("nl"), F.col("verbose"), none))
    return todo.join(done, "pair_hash", "left_anti").select("doc_id")


@query("SELECT 'Compress:' || chr(10) || text AS prompt, replace(text, ' ', '') AS reply, count(*) AS n FROM documents GROUP BY 1, 2")
def chat_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_chat(pairs(spark, sf_dir), path)
    rows = readers.read_jsonl(spark, path, schemas.MESSAGES)
    return rows.groupBy(F.col("messages")[1]["content"].alias("prompt"), F.col("messages")[2]["content"].alias("reply")).agg(F.count("*").alias("n"))


@query("SELECT 'Compress:' || chr(10) || text AS prompt, replace(text, ' ', '') AS completion, count(*) AS n FROM documents GROUP BY 1, 2")
def completion_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_completions(pairs(spark, sf_dir), path)
    return readers.read_jsonl(spark, path, "prompt string, completion string").groupBy("prompt", "completion").agg(F.count("*").alias("n"))


@query("SELECT '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Output:' || chr(10) || replace(text, ' ', '') AS text, count(*) AS n FROM documents GROUP BY 1")
def text_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_text(pairs(spark, sf_dir), path)
    return readers.read_jsonl(spark, path, "text string").groupBy("text").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('en', 'fr'))
SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split, lang, count(*) AS n FROM o GROUP BY 1, 2""")
def split_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_splits(split_documents(spark, sf_dir), path)
    return spark.read.schema("doc_id long, lang string, split string").json(path).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT CASE event_id % 3 WHEN 0 THEN 'claude-sonnet-4-20250514' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model, CAST(floor(value * 100) AS BIGINT) AS n, event_id FROM events),
c AS (SELECT model, n / 1000000.0 * CASE event_id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 0.15 ELSE 1.0 END + (n // 2) / 1000000.0 * CASE event_id % 3 WHEN 0 THEN 15.0 WHEN 1 THEN 0.60 ELSE 1.0 END AS cost FROM l)
SELECT model, 2 * count(*) AS calls, round(2 * sum(cost), 6) AS spend FROM c GROUP BY 1""")
def cost_log_files(spark, sf_dir):
    """The log appended to twice and read again."""
    path = scratch(spark)
    for _ in range(2):
        sinks.append_jsonl(cost_log(spark, sf_dir).select("timestamp", "model", "cost_usd"), path)
    return readers.read_cost_log(spark, path).groupBy("model").agg(F.count("*").alias("calls"), r6(F.sum("cost_usd")).alias("spend"))


@query("SELECT count(*) FILTER (toxic = 0) AS cached_count, count(*) FILTER (toxic IS NULL OR toxic <> 0) AS generated_count FROM documents LEFT JOIN labels USING (doc_id)")
def cache_files(spark, sf_dir):
    """Entries set, some of them deleted again, and probed."""
    path, labels = scratch(spark), table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic")
    sinks.append_jsonl(sinks.cache_entries(labels, "key", "quality"), path)
    sinks.delete_cached(labels.where("toxic <> 0"), path)
    cache = spark.read.schema("key string, value string, expires_at timestamp, written_at timestamp").json(path)
    return resume.cache_counters(resume.with_cached(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key")), cache))


@query("SELECT count(*) AS n_lines, count(*) FILTER (conv_id % 2 = 0) AS n_filled FROM conversations")
def line_counts(spark, sf_dir):
    """Lines of a file, half of them blank, by both counters."""
    path = scratch(spark)
    table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 2 == 0, "{}").otherwise("  ").alias("value")).write.text(path)
    return spark.createDataFrame([(readers.count_lines(spark, path, blank=True), readers.count_lines(spark, path))], "n_lines long, n_filled long")


@query("SELECT DISTINCT text AS verbose, replace(text, ' ', '') AS compressed FROM documents WHERE text IS NOT NULL")
def incremental_files(spark, sf_dir):
    """A stream over two batches of files with texts in common; each text is worked on once."""
    path, d = scratch(spark), table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").alias("verbose"), "doc_id")
    run = lambda: append_new(spark, f"{path}/in", "verbose string", lambda x: x.withColumn("compressed", squeezed("verbose")), f"{path}/out", "verbose string, compressed string", F.sha2("verbose", 256), f"{path}/state", compression="gzip").awaitTermination()
    for part in (d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1")):
        sinks.write_jsonl(part.select("verbose"), f"{path}/in", mode="append", compression="gzip")
        run()
    return spark.read.schema("verbose string, compressed string").json(f"{path}/out").select("verbose", "compressed")


@query("SELECT text AS input_text, 2 * count(*) AS n, round(CASE WHEN max(length(text)) > 0 THEN max(length(text) // 2) / max(length(text)) END, 6) AS score FROM (SELECT regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS text FROM documents) WHERE text <> '' GROUP BY 1")
def evaluation_files(spark, sf_dir):
    """Evaluation rows appended, read and appended once more, with a score for each of two models."""
    from ..operators import evaluate

    path = scratch(spark)
    half = lambda: lambda texts: [t[: len(t) // 2] for t in texts]
    scores = {"length": lambda a, b: F.length(b) / F.length(a), "always": lambda a, b: F.lit(1.0)}
    sinks.append_jsonl(evaluate.evaluate(training.chat_rows(pairs(spark, sf_dir)), half, scores), path)
    sinks.append_jsonl(readers.read_jsonl(spark, path, schemas.EVALUATION), path)
    rows = readers.read_jsonl(spark, path, schemas.EVALUATION)
    return rows.groupBy("input_text").agg(F.count("*").alias("n"), r6(F.min(F.col("equivalence_scores")["length"])).alias("score"))


@query(f"""SELECT coalesce(d.text, '') AS verbose, CASE WHEN l.doc_id IS NULL THEN {sql_strip("'short: ' || replace(coalesce(d.text, ''), ' ', '_')")} ELSE 'cached ' || l.quality END AS compressed, 'code' AS domain, 'python' AS language, l.doc_id IS NOT NULL AS hit, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)""")
def generated_pairs(spark, sf_dir):
    """Short forms from a generator that is passed in, with a prompt, a language and a cache that knows some of them. A
    text is told from its copies by its id, which goes in with it and out again."""
    named = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))).alias("text"), "doc_id")
    known = named.join(table(spark, sf_dir, "labels"), "doc_id")
    cache = known.select(cache_key("code", F.col("text"), model="m", lang="python").alias("key"), F.concat(F.lit("cached "), F.col("quality").cast("string")).alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    short = lambda: lambda prompts: [" short: " + p.split("|", 1)[1].replace(" ", "_") + "\n" for p in prompts]
    out = seams.generate_pairs(named.select("text"), cache, short, "code", "code", language="python", template="Shorten: {input}", model="m")
    return out.select(F.regexp_replace("verbose", r"^[0-9]+\|", "").alias("verbose"), "compressed", "domain", "language", "hit", F.substring_index("verbose", "|", 1).cast("long").alias("doc_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'partial' WHEN doc_id % 4 = 2 THEN 'not_equivalent' ELSE 'equivalent' END AS verdict,
round(CAST(CASE WHEN doc_id % 4 = 3 THEN 0.65 * 0.5 + 0.5 * 0.5 WHEN doc_id % 4 = 2 THEN 0.25 * 0.9 + 0.5 * 0.1 ELSE 1.0 * 0.8 + 0.5 * 0.2 END AS DOUBLE), 6) AS judge_score FROM labels""")
def judge_with_fallback(spark, sf_dir):
    """A judge whose replies can be read for half of the prompts, a second one for half of the rest."""
    first = lambda: lambda p: '{"verdict": "Equivalent", "confidence": 0.8}' if int(p) % 4 < 2 else "I can't say"
    second = lambda: lambda p: '```json\n{"verdict": "not_equivalent", "confidence": 0.9}\n```' if int(p) % 4 == 2 else "{}"
    d = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    return seams.judge(d, "prompt", first, second).select("doc_id", "judged.verdict", r6("judge_score").alias("judge_score"))


@query(f"SELECT sum({SQL_COUNT.format('text')}) AS input_tokens, sum({SQL_COUNT.format("replace(text, ' ', '')")}) AS output_tokens, round(sum({SQL_COUNT.format('text')}) / 1000000.0 * 0.15 + sum({SQL_COUNT.format("replace(text, ' ', '')")}) / 1000000.0 * 0.6, 6) AS cost FROM benchmark")
def call_record_totals(spark, sf_dir):
    """Cost records of answered texts, with the counter that is passed in."""
    from ..functions import regex_token_count

    d = table(spark, sf_dir, "benchmark").select("text", squeezed("text").alias("reply"))
    r = seams.call_records(d, "text", "reply", "gpt-4o-mini", "generation", regex_token_count)
    return r.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), r6(F.sum("cost_usd")).alias("cost"))
