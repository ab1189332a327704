"""What keeps queries within limits as tables grow: small batches, nothing computed that is not asked for, small joins."""

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom import seams
from corpusloom.functions import normalize_for_comparison, regex_token_count, strip
from corpusloom.functions.text import ABBREVIATIONS
from corpusloom.operators import code_units
from corpusloom.plans import files, queries

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DOCS = [(i, t, "en", "web") for i, t in enumerate(["plain words go on", "a b  c", "plain words go on", "it's | 5 yrs + 3% more", "one\n\ntwo. And three?"])]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain(extended=True)
    return said.getvalue().split("== Optimized Logical Plan ==")[1]


@pytest.fixture()
def docs(tables):
    return tables(documents=(DOCS, "doc_id long, text string, lang string, source string"))


@pytest.mark.parametrize("operator", ["map_texts", "code_units", "pair_equivalence"])
def test_python_gets_small_batches(spark, operator):
    spark.conf.set(ROWS, "10000")
    d = spark.createDataFrame([("x = 1", "p")], "source string, path string")
    same = lambda: lambda ts: [[1.0] for _ in ts]
    {"map_texts": lambda: seams.map_texts(d, "source", "n", same, "array<double>"), "code_units": lambda: code_units.code_units(d), "pair_equivalence": lambda: seams.pair_equivalence(d, same, "source", "path")}[operator]()
    assert int(spark.conf.get(ROWS)) <= 512


def test_code_units_leave_in_pieces(spark, monkeypatch):
    body = "def run{0}(x):\n    a = x + {0}\n    b = a * 2\n    c = '" + "w" * 200 + "'\n    return a, b, c\n"
    d = spark.createDataFrame([(body.replace("{0}", str(i)), f"{i}.py") for i in range(50)] + [(None, "n.py")], "source string, path string").coalesce(1)
    monkeypatch.setattr(code_units, "PIECE_CHARS", 500)
    assert {r.name for r in code_units.code_units(d).collect()} == {f"run{i}" for i in range(50)}


def test_only_what_is_asked_for(spark, docs):
    assert "bdef" not in plan(queries.QUERIES["evaluation_report"](spark, docs)) and "bdef" not in plan(queries.QUERIES["evaluate_generator"](spark, docs))
    assert "therefore" not in plan(queries.QUERIES["domain_classify"](spark, docs))


def test_vectors_are_joined_by_digest(spark, docs):
    joins = [x for x in plan(queries.QUERIES["batched_similarity"](spark, docs)).split("== Physical Plan ==")[0].split("\n") if "Join LeftOuter" in x]
    assert len(joins) == 2 and all("_digest#" in x for x in joins)


def test_evaluation_runs_once(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda _: f"{tmp_path}/files")
    assert queries.QUERIES["evaluation_files"](spark, docs).count() == 4
    rows = spark.read.json(f"{tmp_path}/files").groupBy("input_text", "duration_ms").count().collect()
    assert rows and all(r["count"] % 2 == 0 for r in rows)


def test_increments_are_compressed(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda _: f"{tmp_path}/files")
    got = {(r.verbose, r.compressed) for r in queries.QUERIES["incremental_files"](spark, docs).collect()}
    assert got == {(t, t.replace(" ", "")) for _, t, _, _ in DOCS}
    parts = [p.name for p in Path(f"{tmp_path}/files").rglob("part-*json*")]
    assert parts and all(p.endswith(".json.gz") for p in parts)


def test_strip_count_and_words(spark):
    odd = [f"{chr(c)}x{chr(c)}y{chr(c)}{chr(c)}" for c in [*range(1, 0x300), 0x1680, 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF, 0x1F600]] + ["", " ", "abcdefghi 12345,6\t7"]
    rows = spark.createDataFrame([(t,) for t in [*odd, None]], "t string").select("t", strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "").alias("old"), regex_token_count(F.col("t")).alias("n")).collect()
    assert all(r.s == r.old and r.n == len(re.findall(r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9 \t\n\r\f]", r.t or "")) for r in rows)


def test_abbreviations_as_words(spark):
    assert not {w for words in ABBREVIATIONS.values() for w in words.split()} & set(ABBREVIATIONS)
    texts = [f"{a}{short}{b}" for short in ABBREVIATIONS for a, b in (("", ""), ("x ", "-y"), ("é", ""), ("", "_"), (f"{short} ", f" {short}"))] + ["ſr yrſ", "mın", "K yr"]
    steps = F.col("t")
    for short, words in ABBREVIATIONS.items():
        steps = F.regexp_replace(steps, rf"(?iU)\b{short}\b", f" {words}")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(steps, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    rows = spark.createDataFrame([(t.lower(),) for t in texts], "t string").select(normalize_for_comparison(F.col("t")).alias("new"), tidy.alias("old")).collect()
    assert all(r.new == r.old for r in rows)
