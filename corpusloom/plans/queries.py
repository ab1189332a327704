"""Queries over the supplied tables, each with the SQL that gives the same rows where SQL can.

The tables hold plain prose, so operators on marked-up text, code or logs get a column that the query makes from it;
the SQL makes the same one. All queries read whole tables. Every result is flat and its columns are named alike.

Texts go in whole; where a pair of texts is asked for and the tables have none, the second is made from the whole first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions import (
    atomic_facts, call_cost, char_codes, clean_generated, clean_marks, combined_score, compression_ratio, cosine,
    judge_or_partial, lexical_overlap, logical_lines, masked_example, normalize_for_comparison, normalize_space, pair_hash,
    parse_judge, prompt_and_completion, reduction_percent, regex_token_count, strip_code, strip_frontmatter, strip_tags,
    text_cost, text_fact_overlap, text_hash, token_counts, verdict_score, classify, cache_key, fact_overlap,
)
from ..functions.classify import CODE, score_and_domain
from ..functions.text import ABBREVIATIONS, SYMBOLS
from ..operators import chunks, code_units, corpus, costs, evaluate, resume, runs, training, validate
from ..sources import readers
from .. import seams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For costly expressions over one small file, which a scan gives to one task: dealt out over as many tasks as the
    session's `spark.corpusloom.spread` says. Unset, as for tables of many files, the scan is left alone."""
    tasks = df.sparkSession.conf.get("spark.corpusloom.spread", None)
    return df.repartition(int(tasks)) if tasks else df


def squeezed(c: str):
    """A short form of a whole text: its spaces left out."""
    return F.replace(F.col(c), F.lit(" "), F.lit(""))


def r6(c):
    return F.round(c, 6)


# --- corpus: filters, dedupe, merge, splits -------------------------------------------------------------------------


@query("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) BETWEEN 100 AND 2500")
def corpus_length_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(corpus.in_window(F.col("text"), 100, 2500)).select("doc_id", "lang", F.length("text").cast("long").alias("n"))


def corpus_inputs(spark, sf_dir):
    """Three tables as corpus files: documents by text, benchmark by content, conversations by code."""
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("file_idx"), F.col("doc_id").alias("line_idx"), "text", none.alias("content"), none.alias("code"), "source", F.col("lang").alias("language"), F.lit("documents").alias("file_stem"))
    b = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("file_idx"), F.col("item_id").alias("line_idx"), F.lit("").alias("text"), F.col("text").alias("content"), none.alias("code"), none.alias("source"), none.alias("language"), F.lit("benchmark").alias("file_stem"))
    c = table(spark, sf_dir, "conversations").select(F.lit(2).alias("file_idx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_idx"), none.alias("text"), F.lit("").alias("content"), F.col("text").alias("code"), none.alias("source"), none.alias("language"), F.lit("conversations").alias("file_stem"))
    return d.unionByName(b).unionByName(c)


INPUTS = """i AS (SELECT 0 AS file_idx, doc_id AS line_idx, text AS body, source, lang AS language, 'documents' AS file_stem FROM documents
UNION ALL SELECT 1, item_id, text, NULL, NULL, 'benchmark' FROM benchmark UNION ALL SELECT 2, conv_id * 1000 + turn, text, NULL, NULL, 'conversations' FROM conversations),
s AS (SELECT *, coalesce(length(body) BETWEEN 100 AND 2500, false) AS fits FROM i),
m AS (SELECT *, CASE WHEN NOT fits THEN 'filtered' WHEN row_number() OVER (PARTITION BY fits, body ORDER BY file_idx, line_idx) = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM s)"""


@query(f"WITH {INPUTS} SELECT body AS text, 'nl' AS domain, coalesce(source, file_stem) AS source, language, CAST(NULL AS VARCHAR) AS category FROM m WHERE status = 'kept'")
def corpus_merge_dedupe(spark, sf_dir):
    return corpus.merged_rows(corpus.merge(corpus_inputs(spark, sf_dir), "nl"))


@query(f"WITH {INPUTS} SELECT file_stem, count(*) AS total_read, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'kept') AS kept FROM m GROUP BY 1")
def corpus_merge_stats(spark, sf_dir):
    return corpus.merge_stats(corpus.merge(corpus_inputs(spark, sf_dir), "nl"), ["file_stem"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS n FROM documents WHERE length(text) BETWEEN 100 AND 2000) WHERE n = 1")
def prefix_dedupe_200(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(corpus.in_window(F.col("text"), 100, 2000))
    return corpus.first_of_each(d.select("doc_id", F.substring("text", 1, 200).alias("head")), ["head"], ["doc_id"]).select("doc_id")


@query("SELECT doc_id, h FROM (SELECT doc_id, substr(md5(substr(text, 1, 500)), 1, 16) AS h, row_number() OVER (PARTITION BY substr(text, 1, 500) ORDER BY doc_id) AS n FROM documents WHERE length(text) BETWEEN 150 AND 2000) WHERE n = 1")
def prefix_dedupe_md5_500(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(corpus.in_window(F.col("text"), 150, 2000))
    rows = d.select("doc_id", text_hash(F.substring("text", 1, 500)).alias("h"))
    return corpus.first_of_each(rows, ["h"], ["doc_id"])


CODE_TEXT = "CASE doc_id % 3 WHEN 0 THEN 'def ' || source || '():' || chr(10) || text WHEN 1 THEN 'class X:' || chr(10) || text ELSE text END"


def code_text():
    k = F.col("doc_id") % 3
    return F.when(k == 0, F.concat(F.lit("def "), "source", F.lit("():\n"), "text")).when(k == 1, F.concat(F.lit("class X:\n"), "text")).otherwise(F.col("text"))


@query(f"SELECT text, 'python' AS language, 'documents' AS source FROM (SELECT t AS text, doc_id, row_number() OVER (PARTITION BY substr(t, 1, 500) ORDER BY doc_id) AS n FROM (SELECT doc_id, {CODE_TEXT} AS t FROM documents) WHERE length(t) BETWEEN 150 AND 2000 AND (contains(t, 'def ') OR contains(t, 'class '))) WHERE n = 1")
def remote_code_adapter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), code_text().alias("content"))
    return readers.remote_code(d, "content", "documents", limit=0)


@query("SELECT count(*) AS n FROM documents WHERE (length(text || repeat('```', CAST(doc_id % 5 AS INT))) - length(replace(text || repeat('```', CAST(doc_id % 5 AS INT)), '```', ''))) / 3 <= 2")
def fence_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat("text", F.expr("repeat('```', cast(doc_id % 5 as int))")))
    return d.where(corpus.few_fences(F.col("t"))).agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1")
def conversation_user_text(spark, sf_dir):
    return readers.long_turns_to_user_text(table(spark, sf_dir, "conversations"))


@query("""WITH u AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1)
SELECT text FROM (SELECT text, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY conv_id) AS n FROM u WHERE length(text) BETWEEN 100 AND 2000) WHERE n = 1""")
def multi_turn_adapter(spark, sf_dir):
    return readers.multi_turn_rows(table(spark, sf_dir, "conversations"), limit=None)


@query("SELECT text, conv_id FROM (SELECT text, conv_id, turn, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY conv_id, turn) AS n FROM conversations WHERE role = 'user' AND length(text) BETWEEN 100 AND 2000) WHERE n = 1")
def conversation_role_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & corpus.in_window(F.col("text"), 100, 2000))
    return corpus.first_of_each(c.select("conv_id", "turn", "text"), ["substring(text, 1, 200)"], ["conv_id", "turn"]).select("text", "conv_id")


@query("""WITH p AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'system' AND turn = 0 THEN text END), '') AS s, min_by(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY 1),
t AS (SELECT conv_id, CASE WHEN s <> '' THEN s || chr(10) || chr(10) || q ELSE q END AS text FROM p)
SELECT text FROM (SELECT text, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY conv_id) AS n FROM t WHERE length(text) BETWEEN 100 AND 2000) WHERE n = 1""")
def system_plus_question(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy(F.col("conv_id").alias("idx")).agg(F.max(F.when((F.col("role") == "system") & (F.col("turn") == 0), F.col("text"))).alias("system_prompt"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    return readers.questions(rows, limit=None)


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS text, lang AS category FROM documents WHERE length(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END) BETWEEN 100 AND 2000")
def instruction_adapter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return readers.instructions(d.select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("context"), F.col("text").alias("instruction"), F.col("lang").alias("category")), limit=None)


@query("SELECT text, doc_id AS message_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0 AND lang = 'en' AND length(text) BETWEEN 100 AND 2000) WHERE n = 1")
def assistant_tree_adapter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("message_id"), "lang", "text", F.when(F.col("doc_id") % 2 == 0, "prompter").otherwise("assistant").alias("role"))
    return readers.assistant_trees(rows, limit=None)


@query("SELECT source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(DISTINCT lang) AS files, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (length(text) BETWEEN 200 AND 999) AS medium, count(*) FILTER (length(text) >= 1000) AS long FROM documents GROUP BY 1")
def source_stats(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.length("text")
    return d.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(n).alias("total_chars"), F.count_distinct("lang").alias("files"), F.count_if(n < 200).alias("short"), F.count_if((n >= 200) & (n < 1000)).alias("medium"), F.count_if(n >= 1000).alias("long"))


@query("SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(DISTINCT source) AS files, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (length(text) BETWEEN 200 AND 999) AS medium, count(*) FILTER (length(text) >= 1000) AS long FROM documents")
def length_buckets(spark, sf_dir):
    return corpus.chunk_summary(table(spark, sf_dir, "documents"), "text", "source")


SPLIT = """o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT doc_id, lang, CASE WHEN lang NOT IN ('en', 'fr') THEN NULL WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM o)"""


def split_documents(spark, sf_dir):
    return corpus.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("doc_id"), ["lang"], ["en", "fr"])


@query(f"WITH {SPLIT} SELECT * FROM s")
def stratified_split(spark, sf_dir):
    return split_documents(spark, sf_dir)


@query(f"WITH {SPLIT} SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test, count(*) FILTER (lang = 'en') AS nl_count, count(*) FILTER (lang = 'fr') AS code_count FROM s")
def split_stats(spark, sf_dir):
    named = F.when(F.col("lang") == "en", "nl").when(F.col("lang") == "fr", "code").otherwise(F.col("lang"))
    return corpus.split_stats(split_documents(spark, sf_dir).withColumn("domain", named))


@query("SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id)) AS r, count(*) OVER () AS n FROM documents)")
def plain_split(spark, sf_dir):
    return corpus.split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), seed=7)


@query("SELECT path, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^(test_.*\\.py|.*_test\\.py|conftest\\.py|setup\\.py|setup\\.cfg)$') OR regexp_matches(path, '^(tests?/.*\\.py|.*/tests?/.*/.*\\.py)$') AS excluded FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'pkg/tests/a' WHEN 1 THEN 'tests/x/a' WHEN 2 THEN 'a/test_' WHEN 3 THEN 'a/b/tests/c/' WHEN 4 THEN 'src/m_test' WHEN 5 THEN 'test/' ELSE 'src/main' END || CASE WHEN doc_id % 7 IN (2, 3, 5) THEN source ELSE '' END || '.py' AS path FROM documents)")
def path_exclusion(spark, sf_dir):
    k = F.col("doc_id") % 7
    path = F.concat(F.element_at(F.array(*map(F.lit, ["pkg/tests/a", "tests/x/a", "a/test_", "a/b/tests/c/", "src/m_test", "test/", "src/main"])), (k + 1).cast("int")), F.when(k.isin(2, 3, 5), F.col("source")).otherwise(""), F.lit(".py"))
    return table(spark, sf_dir, "documents").select(path.alias("path")).select("path", corpus.path_excluded(F.col("path")).alias("excluded"))


# --- text -----------------------------------------------------------------------------------------------------------

MARKED = """'---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# Head ' || source || chr(10) || chr(10) || '**bold** and *it* with [a link](http://x.y) and ![pic](z.png), `code` here' || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '> quote' || chr(10) || '- item one' || chr(10) || '1. first' || chr(10) || '---' || chr(10) || '<b>tag</b>  two   spaces' || chr(10) || chr(10) || chr(10) || chr(10) || text"""


def marked():
    head = "**bold** and *it* with [a link](http://x.y) and ![pic](z.png), `code` here\n```py\nx = 1\n```\n> quote\n- item one\n1. first\n---\n<b>tag</b>  two   spaces\n\n\n\n"
    return F.concat(F.lit("---\ntitle: x\n---\n# Head "), "source", F.lit("\n\n" + head), "text")


SQL_FRONT = "regexp_replace({}, '\\A---\\s*\\n.*?\\n---\\s*\\n', '', 's')"
SQL_CODE = "regexp_replace(regexp_replace({}, '```.*?```', '', 'gs'), '`[^`]+`', '', 'g')"
SQL_TAGS = "regexp_replace({}, '<[^>]+>', '', 'g')"


def sql_marks(x: str) -> str:
    pairs = [(r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"(?m)^>\s*", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^[-*_]{3,}\s*$", "")]
    for p, r in pairs:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


SQL_CLEAN = sql_strip("regexp_replace(regexp_replace(" + sql_marks(SQL_TAGS.format(SQL_CODE.format(SQL_FRONT.format("t")))) + ", ' +', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {SQL_FRONT.format('t')} AS front, {SQL_CODE.format('t')} AS code, {SQL_TAGS.format('t')} AS tags FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def markdown_strip(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t"))
    return d.select("doc_id", strip_frontmatter(F.col("t")).alias("front"), strip_code(F.col("t")).alias("code"), strip_tags(F.col("t")).alias("tags"))


@query(f"SELECT doc_id, {sql_marks('t')} AS marks FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def markdown_marks(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t")).select("doc_id", clean_marks(F.col("t")).alias("marks"))


@query(f"SELECT doc_id, {SQL_CLEAN} AS cleaned FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def markdown_clean(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t"))
    return d.select("doc_id", normalize_space(clean_marks(strip_tags(strip_code(strip_frontmatter(F.col("t")))))).alias("cleaned"))


PARAGRAPHS = "regexp_split_to_array({}, '\\n\\s*\\n')"


@query(f"""WITH c AS (SELECT doc_id, {SQL_CLEAN} AS x FROM (SELECT doc_id, {MARKED} AS t FROM documents)),
p AS (SELECT doc_id, unnest(list_filter(list_transform({PARAGRAPHS.format('x')}, lambda s: {sql_strip('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '\\A#{{1,6}}\\s+'))) AS para, generate_subscripts(list_filter(list_transform({PARAGRAPHS.format('x')}, lambda s: {sql_strip('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '\\A#{{1,6}}\\s+')), 1) AS k FROM c)
SELECT doc_id, CAST(sum(CASE WHEN length(para) BETWEEN 50 AND 2000 THEN 1 ELSE 0 END) AS BIGINT) AS n_whole, CAST(sum(CASE WHEN length(para) > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long FROM p GROUP BY 1""")
def paragraph_split(spark, sf_dir):
    o = chunks.ChunkOptions()
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t")).select("doc_id", chunks.cleaned(F.col("t"), o).alias("x"))
    paras = F.filter(F.transform(F.split("x", r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", "")), lambda p: (p != "") & ~p.rlike(r"\A#{1,6}\s+"))
    p = d.select("doc_id", F.explode(paras).alias("p"))
    n = F.length("p")
    return p.groupBy("doc_id").agg(F.count_if(n.between(50, 2000)).alias("n_whole"), F.count_if(n > 2000).alias("n_long"))


def long_idx(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def sql_paragraph_chunks(x: str, low: int, high: int) -> str:
    """Greedy packing as a fold over sentences whose state is a string: finished packs and the open one, divided by \\2."""
    paras = f"list_filter(list_transform({PARAGRAPHS.format(x)}, lambda pp: {sql_strip('pp')}), lambda pp: pp <> '' AND NOT regexp_matches(pp, '\\A#{{1,6}}\\s+'))"
    parts = "string_split(regexp_replace(p, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))"
    fold = f"list_reduce({parts}, lambda a, s: CASE WHEN length(string_split(a, chr(2))[-1]) + length(s) + 1 <= {high} THEN {sql_strip("a || ' ' || s")} ELSE a || chr(2) || s END)"
    return f"flatten(list_transform({paras}, lambda p: CASE WHEN length(p) BETWEEN {low} AND {high} THEN [p] WHEN length(p) > {high} THEN list_filter(string_split({fold}, chr(2)), lambda c: length(c) >= {low}) ELSE CAST([] AS VARCHAR[]) END))"


def sql_section_chunks(x: str, low: int, high: int) -> str:
    parts = f"list_transform(string_split(regexp_replace({x}, '(?m)^(#{{1,6}}\\s+)', concat(chr(1), '\\1'), 'g'), chr(1)), lambda q: {sql_strip(sql_strip("regexp_replace(" + sql_strip('q') + ", '(?m)^#{1,6}\\s+(.+)$', '', 'g')"))})"
    return f"flatten(list_transform(list_filter({parts}, lambda q: q <> ''), lambda q: CASE WHEN length(q) BETWEEN {low} AND {high} THEN [q] WHEN length(q) > {high} THEN {sql_paragraph_chunks('q', low, high)} ELSE CAST([] AS VARCHAR[]) END))"


def sql_chunk_rows(chunked: str) -> str:
    return f"WITH c AS (SELECT doc_id, {SQL_CLEAN} AS x FROM (SELECT doc_id, {MARKED} AS t FROM documents)), l AS (SELECT doc_id, {chunked} AS cs FROM c) SELECT doc_id, unnest(range(0, len(cs))) AS chunk_idx, unnest(cs) AS text FROM l"


@query(sql_chunk_rows(sql_paragraph_chunks("x", 50, 2000)))
def markdown_paragraph_chunks(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t"))
    return long_idx(chunks.markdown_chunks(d, "t", ["doc_id"]))


@query(sql_chunk_rows(sql_section_chunks("x", 50, 1000)))
def markdown_section_chunks(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t"))
    return long_idx(chunks.markdown_chunks(d, "t", ["doc_id"], chunks.ChunkOptions(chunk_by="section", max_chars=1000)))


@query(sql_chunk_rows(f"CASE WHEN length(x) BETWEEN 50 AND 2000 THEN [x] ELSE {sql_section_chunks('x', 50, 2000)} END"))
def markdown_document_chunks(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", marked().alias("t"))
    return long_idx(chunks.markdown_chunks(d, "t", ["doc_id"], chunks.ChunkOptions(chunk_by="document")))


@query("SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))) AS BIGINT) AS n_sentences FROM documents")
def sentence_split(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(chunks.sentences(F.col("text"))).cast("long").alias("n_sentences"))


SQL_FACTS = f"list_transform(list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_split_to_array({sql_strip('s')}, '(?i)\\s+(?:and|but|however|also|additionally)\\s+'))), lambda p: {sql_strip('p')}), lambda p: length(p) > 10), lambda p: lower(p))"


@query(f"SELECT doc_id, unnest({SQL_FACTS}) AS fact FROM documents")
def atomic_fact_rows(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(atomic_facts(F.col("text"))).alias("fact"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(c, '\\A\\s+|\\s+\\z', '', 'g'), chr(10)), lambda l: trim(l) <> '' AND trim(l)[1] <> '#')) AS BIGINT) AS n FROM (SELECT doc_id, '# note' || chr(10) || chr(10) || text || chr(10) || '  # end' AS c FROM documents)")
def logical_line_count(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("# note\n\n"), "text", F.lit("\n  # end")).alias("c"))
    return d.select("doc_id", logical_lines(F.col("c")).cast("long").alias("n"))


WORDS = r"\p{L}\p{N}_"


def sql_normalize(x: str) -> str:
    """A boundary is a character here, so neighbours that share one need a second pass."""
    x = f"lower({x})"
    for symbol, words in SYMBOLS.items():
        x = f"replace({x}, '{symbol}', '{words}')"
    for short, words in ABBREVIATIONS.items():
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|[^{WORDS}]){short}([^{WORDS}]|$)', '\\1 {words}\\2', 'g')"
    for sign, words in (("\\+", " increased "), ("-", " decreased "), ("", " ")):
        x = f"regexp_replace({x}, '{sign}(\\d+(?:\\.\\d+)?)%', '{words}\\1 percent ', 'g')"
    x = sql_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    return sql_strip(f"regexp_replace(regexp_replace({x}, '[^{WORDS}\\s]', ' ', 'g'), '\\s+', ' ', 'g')")


@query(f"SELECT doc_id, {sql_normalize('t')} AS normalized FROM (SELECT doc_id, 'CEO → rev +15% YoY | 3 yrs, fn(x) -2.5% & q1: 40% ' || text AS t FROM documents)")
def normalized_text(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("CEO → rev +15% YoY | 3 yrs, fn(x) -2.5% & q1: 40% "), "text").alias("t"))
    return d.select("doc_id", normalize_for_comparison(F.col("t")).alias("normalized"))


def shifted(spark, sf_dir):
    """Every document with the one before it, by id."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\n\\t\\r\\f\\v]+'), lambda t: t <> ''))"


@query(f"""WITH p AS (SELECT a.doc_id, {TOKENS.format('a.text')} AS x, {TOKENS.format('b.text')} AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS overlap FROM p""")
def jaccard_overlap(spark, sf_dir):
    return shifted(spark, sf_dir).select("doc_id", r6(lexical_overlap(F.col("text"), F.col("other"))).alias("overlap"))


@query(f"""WITH n AS (SELECT doc_id, {sql_normalize('text')} AS t FROM documents), p AS (SELECT a.doc_id, {TOKENS.format('a.t')} AS x, {TOKENS.format('b.t')} AS y FROM n a JOIN n b ON b.doc_id = a.doc_id - 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS overlap FROM p""")
def jaccard_overlap_normalized(spark, sf_dir):
    return shifted(spark, sf_dir).select("doc_id", r6(lexical_overlap(F.col("text"), F.col("other"), normalize=True)).alias("overlap"))


W, B = r"[\p{L}\p{N}_]", r"(?:^|[^\p{L}\p{N}_])"
E = r"(?:$|[^\p{L}\p{N}_])"
SQL_SIGNS = [
    rf"{B}def\s+{W}+\s*\(", rf"{B}class\s+{W}+\s*[:\(]", rf"(?m)^\s*(import|from)\s+{W}+", rf"(?m)^\s*@{W}+", rf"{B}function\s+{W}+\s*\(",
    rf"{B}(const|let|var)\s+{W}+\s*=", r"=>\s*[{\(]?", rf"{B}async\s+(function|def|\()", r"(?s)\{\s*\n.*\n\s*\}", r"(?m);\s*$",
    rf":\s*(int|str|float|bool|list|dict|Any|None){E}", r"(?m)^\s*return\s+", r"(?m)^\s*(if|else|elif|else if)\s*[\(:]",
]
CODED = "CASE doc_id % 4 WHEN 0 THEN 'import os' || chr(10) || 'def run(x):' || chr(10) || '    return x;' || chr(10) || text WHEN 1 THEN 'class A:' || chr(10) || '  v: int = 1;' || chr(10) || 'if (a) => {' || chr(10) || text ELSE text END"


def coded():
    """Whole texts, half of them behind a few lines of code."""
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.concat(F.lit("import os\ndef run(x):\n    return x;\n"), "text")).when(k == 1, F.concat(F.lit("class A:\n  v: int = 1;\nif (a) => {\n"), "text")).otherwise(F.col("text"))


def _any(x: str) -> str:
    return " OR ".join(f"regexp_matches({x}, '{p}')" for p in SQL_SIGNS)


@query(f"""WITH c AS (SELECT doc_id, t, string_split({sql_strip('t')}, chr(10)) AS ls FROM (SELECT doc_id, {CODED} AS t FROM documents)),
s AS (SELECT doc_id, CASE WHEN {sql_strip('t')} = '' THEN 0.0 ELSE 0.7 * (len(list_filter(ls, lambda l: {_any('l')})) / len(ls)) + 0.3 * (({' + '.join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in SQL_SIGNS)}) / 13.0) END AS score FROM c)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0.7 THEN 'code' WHEN score > 0.3 THEN 'mixed' ELSE 'nl' END AS domain FROM s""")
def domain_classify(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", coded().alias("t"))
    return d.select("doc_id", score_and_domain(F.col("t")).alias("x")).select("doc_id", r6("x.score").alias("score"), F.col("x.domain").alias("domain"))


SQL_PROSE = [r"[.!?]\s+[A-Z]", r"\n\n[A-Z]", rf"(?i){B}(the|a|an)\s+{W}+", rf"(?i){B}(and|but|or|however|therefore){E}", r"(?m)\?$"]


@query(f"""WITH c AS (SELECT doc_id, t, string_split({sql_strip('t')}, chr(10)) AS ls FROM (SELECT doc_id, {CODED} AS t FROM documents)),
s AS (SELECT doc_id, t, ls, {sql_strip('t')} = '' AS blank, CASE WHEN {sql_strip('t')} = '' THEN 0.0 ELSE 0.7 * (len(list_filter(ls, lambda l: {_any('l')})) / len(ls)) + 0.3 * (({' + '.join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in SQL_SIGNS)}) / 13.0) END AS score, {' + '.join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in SQL_PROSE)} AS prose FROM c)
SELECT doc_id, CASE WHEN score > 0.7 THEN 'code' WHEN score > 0.3 THEN 'mixed' ELSE 'nl' END AS domain, CASE WHEN blank THEN 0.0 ELSE round(CASE WHEN score > 0.7 THEN least(score + 0.1, 1.0) WHEN score > 0.3 THEN 0.6 + (score - 0.3) * 0.5 WHEN prose >= 3 THEN 1.0 - score ELSE 0.7 END, 3) END AS confidence, round(score, 3) AS code_ratio,
array_to_string(list_filter([{', '.join(f"CASE WHEN len(list_filter(ls, lambda l: regexp_matches(l, '{p}'))) > 0 THEN '{n}' END" for n, p in zip(CODE, SQL_SIGNS, strict=True))}], lambda n: n IS NOT NULL)[1:5], ',') AS indicators FROM s""")
def domain_classify_detailed(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", coded().alias("t"))
    return d.select("doc_id", classify(F.col("t")).alias("x")).select("doc_id", "x.domain", "x.confidence", "x.code_ratio", F.array_join("x.indicators", ",").alias("indicators"))


@query("SELECT doc_id, text AS cleaned FROM (SELECT doc_id, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS text FROM documents)")
def generated_cleanup(spark, sf_dir):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("<think>plan\nmore</think> "), "text", F.lit(" "))).when(k == 1, F.concat(F.lit("```txt\n"), "text", F.lit("\n```"))).otherwise(F.concat("text", F.lit("</tool_call>")))
    return table(spark, sf_dir, "documents").select("doc_id", clean_generated(said).alias("cleaned"))


# --- pairs, scores, validation ----------------------------------------------------------------------------------------

SQL_COUNT = "CAST(len(regexp_extract_all({}, '[A-Za-z0-9]{{1,4}}|[^A-Za-z0-9 \\t\\n\\r\\f]')) AS BIGINT)"


@query(f"""WITH t AS (SELECT doc_id, lang, {SQL_COUNT.format('text')} AS v, {SQL_COUNT.format('substr(text, 1, length(text) // 2)')} AS c FROM documents)
SELECT doc_id, v AS verbose_tokens, c AS compressed_tokens, round(CASE WHEN v > 0 THEN c / v ELSE 1.0 END, 6) AS ratio, round((1.0 - CASE WHEN v > 0 THEN c / v ELSE 1.0 END) * 100.0, 6) AS reduction FROM t""")
def token_reduction(spark, sf_dir):
    half = F.substring("text", F.lit(1), F.expr("cast(length(text) div 2 as int)"))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", regex_token_count(F.col("text")).cast("long").alias("verbose_tokens"), regex_token_count(half).cast("long").alias("compressed_tokens"))
    ratio = compression_ratio(F.col("verbose_tokens"), F.col("compressed_tokens"))
    return d.select("*", r6(ratio).alias("ratio"), r6(reduction_percent(ratio)).alias("reduction"))


@query(f"SELECT lang, round(sum({SQL_COUNT.format("replace(text, ' ', '')")}) / sum({SQL_COUNT.format('text')}), 6) AS ratio FROM documents GROUP BY 1")
def corpus_ratio(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("lang", regex_token_count(F.col("text")).alias("v"), regex_token_count(squeezed("text")).alias("c"))
    return d.groupBy("lang").agg(r6(F.sum("c") / F.sum("v")).alias("ratio"))


@query(f"SELECT doc_id, 'openai' AS tokenizer, {SQL_COUNT.format('text')} AS tokens FROM documents UNION ALL SELECT doc_id, 'claude', {SQL_COUNT.format('text')} FROM documents UNION ALL SELECT doc_id, 'gemini', {SQL_COUNT.format('text')} FROM documents")
def token_counts_by_tokenizer(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(token_counts(F.col("text"))).alias("tokenizer", "tokens"))
    return d.withColumn("tokens", F.col("tokens").cast("long"))


@query(f"SELECT doc_id, round({SQL_COUNT.format('text')} / 1000000.0 * CASE doc_id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 0.15 ELSE 1.0 END, 9) AS cost FROM documents")
def text_price(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ["claude-sonnet-4-20250514", "gpt-4o-mini", "other"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.round(text_cost(model, regex_token_count(F.col("text"))), 9).alias("cost"))


@query("SELECT doc_id, substr(sha256(lang || ':' || text || ':' || source), 1, 16) AS pair_hash, 'claude:' || substr(sha256(text), 1, 32) || ':model=m_temp=0.4' AS cache_key, substr(md5(text), 1, 16) AS text_hash FROM documents")
def content_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", pair_hash(F.col("lang"), F.col("text"), F.col("source")).alias("pair_hash"), cache_key("claude", F.col("text"), temp=0.4, model="m").alias("cache_key"), text_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT d.text FROM documents d JOIN labels USING (doc_id) WHERE quality = 1)")
def resume_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("text")
    return resume.not_done(d, done, text_hash(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id >= 500")
def resume_offset(spark, sf_dir):
    return resume.after(table(spark, sf_dir, "documents"), 500, "doc_id").select("doc_id")


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS cached_count, count(*) FILTER (quality IS NULL) AS generated_count FROM documents LEFT JOIN labels USING (doc_id)")
def cache_probe(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    return resume.cache_counters(resume.with_cached(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), cache))


def vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


VECTORS = "v AS (SELECT a.vec_id, a.label, greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)"


@query(f"WITH {VECTORS} SELECT vec_id, round(s, 6) AS similarity, round(0.6 * 0.5 + 0.4 * s, 6) AS with_judge, s >= 0.75 AS equivalent FROM v")
def cosine_similarity(spark, sf_dir):
    s = vector_pairs(spark, sf_dir).select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("s"))
    return s.select("vec_id", r6("s").alias("similarity"), r6(combined_score(F.col("s"), F.lit(0.0), F.lit(0.5))).alias("with_judge"), (F.col("s") >= 0.75).alias("equivalent"))


def scored(spark, sf_dir):
    """Vector pairs as answers: a pair for each ten vectors, models and tasks by the vector's place in it."""
    k = F.col("vec_id") % 10
    v = vector_pairs(spark, sf_dir).select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("semantic"))
    model = F.when(k < 4, "claude").when(k < 7, "gpt").otherwise("gemini")
    return v.select(F.expr("vec_id div 10").alias("pair_id"), model.alias("model"), F.when(k % 2 == 0, "code_generation").otherwise("reasoning").alias("task"), "semantic", F.when(k % 4 == 0, 0.5).otherwise(0.0).alias("ast_similarity"), F.lit(None).cast("double").alias("judge_score"), F.lit(100).cast("long").alias("verbose_tokens"), (F.expr("vec_id div 10") % 90 + 1).alias("compressed_tokens"))


VALIDATED = f"""{VECTORS}, t AS (SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id % 10 < 4 THEN 'claude' WHEN vec_id % 10 < 7 THEN 'gpt' ELSE 'gemini' END AS model, CASE WHEN vec_id % 10 % 2 = 0 AND vec_id % 10 % 4 = 0 THEN 0.5 * 0.5 + 0.5 * s ELSE s END AS score FROM v),
m AS (SELECT pair_id, model, avg(score) AS score FROM t GROUP BY 1, 2), p AS (SELECT pair_id, min(score) AS low, (pair_id % 90 + 1) / 100.0 AS ratio FROM m GROUP BY 1)"""


@query(f"WITH {VALIDATED} SELECT pair_id, round(low, 6) AS min_equivalence, round(ratio, 6) AS compression_ratio, low >= 0.05 AS passed FROM p")
def pair_validate(spark, sf_dir):
    out = validate.validate(scored(spark, sf_dir), 0.05)
    return out.select("pair_id", r6("min_equivalence").alias("min_equivalence"), r6("compression_ratio").alias("compression_ratio"), "passed")


@query(f"WITH {VALIDATED} SELECT count(*) AS total_pairs, count(*) FILTER (low >= 0.05) AS passed_pairs, count(*) FILTER (low < 0.05) AS failed_pairs, round(avg(ratio), 6) AS avg_compression_ratio, round(avg(low), 6) AS avg_equivalence, round(min(low), 6) AS min_equivalence, round(count(*) FILTER (low >= 0.05) / count(*), 6) AS pass_rate, round((1.0 - avg(ratio)) * 100.0, 4) AS token_reduction_percent FROM p")
def batch_stats(spark, sf_dir):
    s = validate.batch_stats(validate.validate(scored(spark, sf_dir), 0.05))
    return s.select(*(c if c.endswith("pairs") else F.round(c, 4 if c.endswith("percent") else 6).alias(c) for c in s.columns))


@query(f"WITH {VALIDATED} SELECT model, count(*) AS n, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score FROM m GROUP BY 1")
def per_model_scores(spark, sf_dir):
    s = validate.per_model(validate.validate(scored(spark, sf_dir), 0.05))
    return s.select("model", "n", r6("avg_score").alias("avg_score"), r6("min_score").alias("min_score"))


def sql_prompt(task: str, context: str) -> str:
    """The prompt of a task, from the fixed values."""
    cases = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in validate.PROMPTS.items())
    return f"replace(CASE {task} {cases} END, '{{context}}', {context})"


@query(f"""SELECT d.doc_id, m.model, t.task, md5({sql_prompt('t.task', 'd.text')}) AS verbose_prompt, md5({sql_prompt('t.task', "replace(d.text, ' ', '')")}) AS compressed_prompt FROM documents d, (VALUES ('claude'), ('gpt'), ('gemini')) m(model), (VALUES ('qa'), ('reasoning'), ('code_generation')) t(task) WHERE t.task = 'reasoning' OR (t.task = 'code_generation') = (d.lang = 'fr')""")
def validation_requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("verbose"), squeezed("text").alias("compressed"), F.when(F.col("lang") == "fr", "code").otherwise("nl").alias("domain"))
    return validate.requests(d, list(validate.MODELS)).select("doc_id", "model", "task", F.md5("verbose_prompt").alias("verbose_prompt"), F.md5("compressed_prompt").alias("compressed_prompt"))


@query("SELECT round(count(*) * 12 * 500 / 1000000.0 * ((3.0 + 0.15 + 0.075) / 3) + count(*) * 12 * 250 / 1000000.0 * ((15.0 + 0.60 + 0.30) / 3), 6) AS validation, round(count(*) * 500 * 3 / 1000000.0 * 0.40, 6) AS training FROM documents")
def cost_projection(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return n.select(r6(validate.validation_cost(F.col("n"), 3)).alias("validation"), r6(validate.training_cost(F.col("n"), 3)).alias("training"))


@query("""SELECT doc_id, CASE toxic WHEN 0 THEN 'equivalent' WHEN 1 THEN 'partial' END AS verdict, CAST(CASE WHEN quality = 1 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS confidence,
round(CAST(CASE toxic WHEN 0 THEN 1.0 ELSE 0.65 END AS DOUBLE) * CASE WHEN quality = 1 THEN 1.0 ELSE 0.25 END + 0.5 * (1.0 - CASE WHEN quality = 1 THEN 1.0 ELSE 0.25 END), 6) AS score FROM labels""")
def judge_scores(spark, sf_dir):
    body = F.concat(F.lit('{"verdict": "'), F.when(F.col("toxic") == 0, "Equivalent").otherwise("PARTIAL"), F.lit('", "confidence": '), F.when(F.col("quality") == 1, "1.7").otherwise("0.25"), F.lit(', "reasoning": "r"}'))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    j = table(spark, sf_dir, "labels").select("doc_id", judge_or_partial(parse_judge(reply)).alias("j"))
    return j.select("doc_id", "j.verdict", "j.confidence", r6(verdict_score(F.col("j.verdict"), F.col("j.confidence"))).alias("score"))


def sql_share(a: str, b: str) -> str:
    """Share of the vectors of one list that have one above 0.8 in the other."""
    return f"len(list_filter({a}, lambda u: len(list_filter({b}, lambda v: list_cosine_similarity(u, v) > 0.8)) > 0)) / len({a})"


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT a.vec_id AS k, list_distinct([a.v, b.v, a.v]) AS x, list_distinct([c.v, a.v, c.v, a.v]) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)
SELECT k AS pair_id, round(({sql_share('x', 'y')} + {sql_share('y', 'x')}) / 2.0, 6) AS overlap FROM f""")
def fact_overlap_score(spark, sf_dir):
    """Facts {x, y, x} against {z, x, z, x}: x is found on both sides, y and z only if something is near; repeats count once."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    near = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("x").alias(n))
    p = e.join(near(1, "y"), "vec_id").join(near(2, "z"), "vec_id")
    return p.select(F.col("vec_id").alias("pair_id"), r6(fact_overlap(F.array("x", "y", "x"), F.array("z", "x", "z", "x"))).alias("overlap"))


LETTERS = "etaoinsr"


def letter_counts(x):
    """A toy encoder, for tests: how often each of eight letters occurs."""
    return F.array(*((F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def sql_letters(x: str) -> str:
    return "[" + ", ".join(f"CAST(length({x}) - length(replace({x}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def sql_near(a: str, b: str) -> str:
    """Cosine of two lists of counts; 0 where one has nothing but zeros."""
    return f"CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END"


def letter_encoder():
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]


@query(f"""WITH b AS (SELECT item_id, text, list_transform(list_distinct({SQL_FACTS}), lambda f: {sql_letters('f')}) AS facts FROM benchmark),
p AS (SELECT a.item_id, {sql_letters('a.text')} AS u, {sql_letters('b.text')} AS v, list_distinct(a.facts) AS x, list_distinct(b.facts) AS y FROM b a JOIN b b ON b.item_id = a.item_id + 1)
SELECT item_id, round({sql_near('u', 'v')}, 6) AS semantic, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round((len(list_filter(x, lambda f: len(list_filter(y, lambda g: list_cosine_similarity(f, g) > 0.8)) > 0)) / len(x) + len(list_filter(y, lambda f: len(list_filter(x, lambda g: list_cosine_similarity(f, g) > 0.8)) > 0)) / len(y)) / 2.0, 6) END AS fact_overlap FROM p""")
def detailed_report_facts(spark, sf_dir):
    """Whole benchmark items against the next, with an encoder passed in for the texts and their facts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    p = evaluate.quick_equivalence(p, letter_encoder, "text", "other")
    d = p.select("item_id", evaluate.detailed_equivalence(F.col("text"), F.col("other"), F.col("semantic"), facts=True, overlap=text_fact_overlap(F.col("text"), F.col("other"), letter_counts)).alias("x"))
    return d.select("item_id", r6("x.semantic_similarity").alias("semantic"), r6("x.fact_overlap").alias("fact_overlap"))


@query(f"""WITH p AS (SELECT a.doc_id, {sql_letters('a.text')} AS u, {sql_letters('b.text')} AS v FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1)
SELECT doc_id, round({sql_near('u', 'v')}, 6) AS semantic FROM p""")
def batched_similarity(spark, sf_dir):
    """Every document with the one before it, each distinct text encoded once by an encoder that is passed in."""
    return evaluate.quick_equivalence(shifted(spark, sf_dir), letter_encoder, "text", "other").select("doc_id", r6("semantic").alias("semantic"))


def counters():
    """Three encoders, as users pass them in: bytes, characters and words."""
    return {"bytes": lambda: lambda ts: [list((t or "").encode()) for t in ts], "characters": lambda: lambda ts: [list(t or "") for t in ts], "words": lambda: lambda ts: [re.findall(r"[^ \n]+", t or "") for t in ts]}


@query("""WITH c AS (SELECT doc_id, lang, strlen(text) AS tokens_bytes, CAST(length(text) AS BIGINT) AS tokens_characters, CAST(len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')) AS BIGINT) AS tokens_words FROM documents)
SELECT *, round(tokens_bytes / 1000000.0 * 3.0, 9) AS price, round(CASE WHEN tokens_bytes > 0 THEN tokens_words / tokens_bytes ELSE 1.0 END, 6) AS ratio FROM c""")
def counts_by_given_tokenizers(spark, sf_dir):
    """Token counts, price and ratio with tokenizers that are passed in as callables."""
    d = seams.count_tokens(spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text"), "text", counters()).drop("text")
    return d.select("*", F.round(text_cost(F.lit("claude-sonnet-4-20250514"), F.col("tokens_bytes")), 9).alias("price"), r6(compression_ratio(F.col("tokens_bytes"), F.col("tokens_words"))).alias("ratio"))


@query(f"""WITH p AS (SELECT a.doc_id, {TOKENS.format('a.text')} AS x, {TOKENS.format('b.text')} AS y, a.text AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS overlap, CAST(0.5 AS DOUBLE) AS semantic, CAST(len({SQL_FACTS.replace('text', 't')}) AS BIGINT) AS n_facts FROM p""")
def detailed_report(spark, sf_dir):
    d = shifted(spark, sf_dir).select("doc_id", evaluate.detailed_equivalence(F.col("text"), F.col("other"), F.lit(0.5), facts=True).alias("x"))
    return d.select("doc_id", r6("x.lexical_overlap_raw").alias("overlap"), F.col("x.semantic_similarity").alias("semantic"), F.size("x.verbose_facts").cast("long").alias("n_facts"))


@query(f"""WITH t AS (SELECT doc_id, lang, {sql_strip('text')} AS x FROM documents), u AS (SELECT doc_id, x, substr(x, 1, length(x) // 2) AS y FROM t WHERE x <> '')
SELECT x AS input_text, y AS compressed_text, round({SQL_COUNT.format('y')} / {SQL_COUNT.format('x')}, 6) AS compression_ratio, round(length(y) / length(x), 6) AS min_equivalence, length(y) / length(x) >= 0.5 AS passed FROM u""")
def evaluate_generator(spark, sf_dir):
    half = lambda: lambda texts: [t[: len(t) // 2] for t in texts]
    out = evaluate.evaluate(training.chat_rows(pairs(spark, sf_dir)), half, lambda a, b: F.length(b) / F.length(a), min_equivalence=0.5)
    return out.select("input_text", "compressed_text", r6("compression_ratio").alias("compression_ratio"), r6("min_equivalence").alias("min_equivalence"), "passed")


@query(f"""WITH t AS (SELECT {sql_strip('text')} AS x FROM documents), u AS (SELECT x, substr(x, 1, length(x) // 2) AS y FROM t WHERE x <> ''),
e AS (SELECT {SQL_COUNT.format('y')} / {SQL_COUNT.format('x')} AS ratio, least(length(y) / length(x), {sql_near(sql_letters('x'), sql_letters('y'))}) AS low FROM u)
SELECT count(*) AS examples, round(avg(ratio), 6) AS avg_ratio, round(avg(low), 6) AS avg_equivalence, round(min(low), 6) AS min_equivalence FROM e""")
def evaluation_report(spark, sf_dir):
    """The summary of an evaluation under two models' scores, the least of which counts."""
    half = lambda: lambda texts: [t[: len(t) // 2] for t in texts]
    scores = {"length": lambda a, b: F.length(b) / F.length(a), "letters": lambda a, b: cosine(letter_counts(a), letter_counts(b))}
    s = validate.evaluation_summary(evaluate.evaluate(training.chat_rows(pairs(spark, sf_dir)), half, scores))
    return s.select("examples", *(r6(c).alias(c) for c in ("avg_ratio", "avg_equivalence", "min_equivalence")))


@query("SELECT lang, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, CAST(floor(count(*) * 0.1) AS BIGINT) AS valid, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) - CAST(floor(count(*) * 0.1) AS BIGINT) AS test FROM documents GROUP BY 1")
def split_preview(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", evaluate.split_preview(F.col("n")).alias("x")).select("lang", "x.train", "x.valid", "x.test")


# --- training files ---------------------------------------------------------------------------------------------------


def pairs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("verbose"), squeezed("text").alias("compressed"))


@query("SELECT 'system' AS r1, 'user' AS r2, 'assistant' AS r3, 'Compress:' || chr(10) || text AS user_text, replace(text, ' ', '') AS reply FROM documents")
def chat_format(spark, sf_dir):
    m = training.chat_rows(pairs(spark, sf_dir))
    return m.select(*(F.col("messages")[i]["role"].alias(f"r{i + 1}") for i in range(3)), F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("reply"))


@query("SELECT 'Compress:' || chr(10) || text AS prompt, replace(text, ' ', '') AS completion FROM documents")
def completion_format(spark, sf_dir):
    return training.completion_rows(pairs(spark, sf_dir))


@query("SELECT '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Output:' || chr(10) || replace(text, ' ', '') AS text FROM documents")
def text_format(spark, sf_dir):
    return training.text_rows(pairs(spark, sf_dir))


@query("""WITH h AS (SELECT item_id, 'ab' || chr(10) || substr(text, 1, length(text) // 2) AS user_text, substr(text, length(text) // 2 + 1) AS reply FROM benchmark),
c AS (SELECT item_id, list_transform(regexp_extract_all(user_text, '(?s).'), lambda x: unicode(x)) AS p, list_transform(regexp_extract_all(reply, '(?s).'), lambda x: unicode(x)) AS c FROM h),
a AS (SELECT item_id, list_concat(p, c) AS ids, list_concat(list_transform(p, lambda x: 0), list_transform(c, lambda x: 1)) AS w FROM c)
SELECT item_id, array_to_string(ids[1 : len(ids) - 1], ',') AS tokens, array_to_string(ids[2 :], ',') AS targets, array_to_string(w[2 :], ',') AS weights FROM a""")
def loss_mask_tokens(spark, sf_dir):
    """The first half of each whole text is the user turn, all the rest the assistant turn."""
    half = F.floor(F.length("text") / 2).cast("int")
    said = [("system", F.lit("ab")), ("user", F.substring("text", 1, half)), ("assistant", F.substring("text", half + 1, F.length("text")))]
    b = table(spark, sf_dir, "benchmark").withColumn("messages", F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said)))
    p, c = prompt_and_completion(F.col("messages"))
    x = b.select("item_id", masked_example(char_codes(p), char_codes(c)).alias("x"))
    join = lambda a: F.array_join(F.transform(a, lambda y: y.cast("string")), ",")
    return x.select("item_id", join("x.tokens").alias("tokens"), join("x.target_tokens").alias("targets"), join("x.weights").alias("weights"))


@query("SELECT regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS input_text FROM documents WHERE regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') <> ''")
def evaluation_examples(spark, sf_dir):
    return training.test_examples(training.chat_rows(pairs(spark, sf_dir))).select("input_text")


# --- costs and runs -----------------------------------------------------------------------------------------------------


def cost_log(spark, sf_dir):
    """Events as calls: the value as tokens, the event type as the model."""
    e = table(spark, sf_dir, "events")
    model = F.element_at(F.array(*map(F.lit, ["claude-sonnet-4-20250514", "gpt-4o-mini", "other"])), (F.col("event_id") % 3 + 1).cast("int"))
    tokens = F.floor(F.col("value") * 100).cast("long")
    return e.select("event_id", "user_id", F.col("ts").alias("timestamp"), model.alias("model"), call_cost(model, tokens, F.expr("cast(floor(value * 100) as bigint) div 2")).alias("cost_usd"))


LOG = """l AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE event_id % 3 WHEN 0 THEN 'claude-sonnet-4-20250514' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model, CAST(floor(value * 100) AS BIGINT) AS n FROM events),
c AS (SELECT *, n / 1000000.0 * CASE event_id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 0.15 ELSE 1.0 END + (n // 2) / 1000000.0 * CASE event_id % 3 WHEN 0 THEN 15.0 WHEN 1 THEN 0.60 ELSE 1.0 END AS cost FROM l)"""


@query(f"WITH {LOG}, d AS (SELECT day, sum(cost) AS spend FROM c GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(spend, 6) AS spend, CASE WHEN spend >= 1.5 THEN 'exceeded' WHEN spend >= 1.0 THEN 'warn' ELSE 'ok' END AS state FROM d")
def cost_by_day(spark, sf_dir):
    d = costs.limit_state(costs.spend_by_day(cost_log(spark, sf_dir)), 1.5, 1.0)
    return d.select(F.col("day").cast("string").alias("day"), r6("spend").alias("spend"), "state")


@query(f"WITH {LOG} SELECT model, round(sum(cost), 6) AS spend FROM c GROUP BY 1")
def cost_by_model(spark, sf_dir):
    return costs.spend_by_model(cost_log(spark, sf_dir)).select("model", r6("spend").alias("spend"))


@query(f"WITH {LOG} SELECT round(sum(cost), 6) AS spend FROM c")
def cost_total(spark, sf_dir):
    return costs.total_spend(cost_log(spark, sf_dir)).select(r6("spend").alias("spend"))


@query(f"WITH {LOG}, s AS (SELECT event_id, user_id, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM c) SELECT user_id, count(*) AS n FROM s WHERE before <= 0.0305 GROUP BY 1")
def budget_stop(spark, sf_dir):
    return costs.within_budget(cost_log(spark, sf_dir), 0.0305, ["event_id"], "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


def training_logs(spark, sf_dir):
    """A log for each user: a header, then a line for each event in order, every tenth a validation line."""
    e = table(spark, sf_dir, "events")
    v = F.format_string("%.3f", F.col("value"))
    train = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": Train loss "), v, F.lit(", Learning Rate 1.000e-05, It/sec "), v, F.lit(", Tokens/sec 120.5, Trained Tokens "), (F.col("event_id") * 7).cast("string"), F.lit(", Peak mem 7.250 GB"))
    val = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": Val loss "), v, F.lit(", Val took 3.2s"))
    line = F.when(F.col("event_id") % 10 == 0, val).otherwise(train)
    head = "Loading model\nTrainable parameters: 0.183% (7.340M/4022.468M)\nStarting training..., iters: 500\n"
    tail = F.when(F.col("user_id") % 3 == 0, "\nSaved final weights to x").when(F.col("user_id") % 3 == 1, "\nRuntimeError: out of luck").otherwise("")
    logs = e.select("user_id", F.struct("event_id", line.alias("line")).alias("x")).groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return logs.select(F.col("user_id").alias("run"), F.concat(F.lit(head), F.array_join("xs.line", "\n"), tail).alias("content"))


@query("SELECT user_id AS run, event_id AS iteration, CASE WHEN event_id % 10 = 0 THEN 'val' ELSE 'train' END AS kind, CASE WHEN event_id % 10 <> 0 THEN CAST(printf('%.3f', value) AS DOUBLE) END AS train_loss, CASE WHEN event_id % 10 = 0 THEN CAST(printf('%.3f', value) AS DOUBLE) END AS val_loss FROM events")
def training_log_metrics(spark, sf_dir):
    return runs.metric_lines(runs.log_lines(training_logs(spark, sf_dir))).select("run", "iteration", "kind", "train_loss", "val_loss")


@query("""WITH e AS (SELECT user_id, event_id, CAST(printf('%.3f', value) AS DOUBLE) AS v, event_id % 10 = 0 AS val FROM events)
SELECT user_id AS run, min_by(v, event_id) FILTER (NOT val) AS first_train_loss, max_by(v, event_id) FILTER (NOT val) AS last_train_loss, min(v) FILTER (NOT val) AS min_train_loss, min(v) FILTER (val) AS min_val_loss, round(avg(v) FILTER (NOT val), 6) AS mean_it_sec, CASE WHEN count(*) FILTER (NOT val) > 0 THEN CAST(7.25 AS DOUBLE) END AS max_peak_mem, max(event_id * 7) FILTER (NOT val) AS last_trained_tokens FROM e GROUP BY 1""")
def training_log_summary(spark, sf_dir):
    s = runs.run_summary(runs.metric_lines(runs.log_lines(training_logs(spark, sf_dir))))
    return s.select("run", "first_train_loss", "last_train_loss", "min_train_loss", "min_val_loss", r6("mean_it_sec").alias("mean_it_sec"), "max_peak_mem", "last_trained_tokens")


@query("SELECT DISTINCT user_id AS run, CAST(500 AS BIGINT) AS total_iters, CAST(0.183 AS DOUBLE) AS trainable_percentage, '7.340M/4022.468M' AS trainable_params, CAST(7340000 AS DOUBLE) AS params FROM events")
def training_log_header(spark, sf_dir):
    h = runs.header(runs.log_lines(training_logs(spark, sf_dir)))
    return h.withColumn("params", runs.size_number(F.substring_index("trainable_params", "/", 1)))


@query("SELECT DISTINCT user_id AS run, CASE user_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'Error: out of luck' ELSE 'Training incomplete (no final weights saved)' END AS status FROM events")
def run_status(spark, sf_dir):
    return training_logs(spark, sf_dir).select("run", runs.run_status(F.col("content")).alias("status"))


@query("SELECT strftime(max(ts), '%Y-%m-%d_%H-%M-%S') AS name FROM events")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("/runs/"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit("/")).alias("path"))
    return runs.latest_run(e.select(runs.run_name(F.col("path")).alias("name")).where("name is not null"))


@query("SELECT event_id, CAST(printf('%.3f', value) AS DOUBLE) AS ppl FROM events")
def perplexity(spark, sf_dir):
    out = F.concat(F.lit("Loading\nTest loss 2.229, Test ppl"), F.when(F.col("event_id") % 2 == 0, ": ").otherwise(" "), F.format_string("%.3f", F.col("value")), F.lit("."))
    return table(spark, sf_dir, "events").select("event_id", runs.perplexity(out).alias("ppl"))


# --- code ---------------------------------------------------------------------------------------------------------------


def sources(spark, sf_dir):
    """A module for each document, with the whole text as a string in a function and in a method."""
    body = "def run_{0}(x):\n    \"\"\"Doc.\"\"\"\n    y = x + {0}\n    # note\n    z = y * {0}\n    text = '{1}'\n    return y, z, text\n\n\nclass K{0}:\n    def __init__(self, a):\n        self.a = a\n\n    def go(self, b):\n        c = self.a + b\n        d = [c for _ in range({0})]\n        e = '{1}'\n        return c, d, e\n\n    def test_it(self):\n        return None\n"
    quoted = F.translate("text", "\\'\n\r", '/"  ')
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.replace(F.replace(F.lit(body), F.lit("{0}"), F.col("doc_id").cast("string")), F.lit("{1}"), quoted).alias("source"), F.concat("source", F.lit(".py")).alias("path"))


#: Units of those modules by hand: their lines, and their characters without the id, its digits and the text.
UNITS = """u AS (SELECT source, unit_type, lines, fixed + ids * length(CAST(doc_id AS VARCHAR)) + texts * length(text) AS chars FROM documents, (VALUES ('function', 7, 100, 3, 1), ('class', 12, 214, 2, 1), ('method', 5, 114, 1, 1)) k(unit_type, lines, fixed, ids, texts)),
f AS (SELECT * FROM u WHERE chars BETWEEN 100 AND 3000)"""


@query(f"WITH {UNITS} SELECT unit_type, count(*) AS n, CAST(sum(lines) AS BIGINT) AS total_lines FROM f GROUP BY 1")
def code_unit_counts(spark, sf_dir):
    u = code_units.code_units(sources(spark, sf_dir))
    return u.groupBy("unit_type").agg(F.count("*").alias("n"), F.sum((F.col("end_line") - F.col("start_line") + 1).cast("long")).alias("total_lines"))


@query(f"WITH {UNITS} SELECT count(*) FILTER (unit_type = 'function') AS n_function, count(*) FILTER (unit_type = 'class') AS n_class, count(*) FILTER (unit_type = 'method') AS n_method, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(chars) // count(*) AS BIGINT) AS avg_chars, CAST(floor(sum(lines) / count(*)) AS BIGINT) AS avg_lines, count(DISTINCT source) AS files FROM f")
def code_corpus_summary(spark, sf_dir):
    s = corpus.code_corpus_summary(code_units.code_units(sources(spark, sf_dir)))
    return s.select("n_function", "n_class", "n_method", "total_chars", "avg_chars", "avg_lines", "files")


#: The dumps of the two trees share 82 characters and differ in a name of k.
@query("SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 82 / (82.0 + doc_id % 20 + 1) END, 6) AS likeness FROM documents")
def ast_likeness(spark, sf_dir):
    """Two assignments to names that differ in every character, the longer the less alike; every fifth can't be parsed."""
    k = (F.col("doc_id") % 20 + 1).cast("int")
    other = F.when(F.col("doc_id") % 5 == 0, "def (").otherwise(F.concat(F.repeat(F.lit("b"), k), F.lit(" = 1\n")))
    d = table(spark, sf_dir, "documents").select("doc_id", code_units.ast_similarity(F.concat(F.repeat(F.lit("a"), k), F.lit(" = 1\n")), other).alias("s"))
    return d.select("doc_id", r6("s").alias("likeness"))


@query()
def ast_likeness_texts(spark, sf_dir):
    """Modules that hold whole texts, each against the one before it by id."""
    small_batches(spark)
    d = sources(spark, sf_dir).select("doc_id", "source")
    p = d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("source").alias("other")), "doc_id")
    return p.select("doc_id", r6(code_units.ast_similarity(F.col("source"), F.col("other"))).alias("likeness"))


@query("SELECT doc_id FROM documents WHERE length(text) > 50 ORDER BY lang, doc_id LIMIT 77")
def ordered_limit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 50).select("doc_id", "lang")
    return corpus.ordered_limit(d, 77, ["lang", "doc_id"]).select("doc_id")


QA = "'Based on the following context, answer the question concisely.' || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: What are the key points mentioned?' || chr(10) || 'Answer:'"
REASONING = "'Analyze the following information and explain the main implications.' || chr(10) || chr(10) || 'Information:' || chr(10) || text || chr(10) || chr(10) || 'Analysis:'"
CODE_GENERATION = "'Based on the following specification, write the corresponding code.' || chr(10) || chr(10) || 'Specification:' || chr(10) || text || chr(10) || chr(10) || 'Code:'"


@query(f"SELECT item_id, model, task, CASE task WHEN 'reasoning' THEN {REASONING} WHEN 'code_generation' THEN {CODE_GENERATION} ELSE {QA} END AS prompt FROM benchmark, (VALUES ('claude-sonnet-4-20250514'), ('gpt-4o-mini')) m(model), (VALUES ('qa'), ('reasoning'), ('code_generation'), ('summarization')) t(task)")
def task_prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("verbose"), F.col("text").alias("compressed"), F.lit("nl").alias("domain"))
    asked = validate.requests(b, ["claude", "gpt"], ["qa", "reasoning", "code_generation", "summarization"])
    return asked.select("item_id", validate.model_name(F.col("model")).alias("model"), "task", F.col("verbose_prompt").alias("prompt"))
