"""Text expressions against plain Python written from their descriptions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import functions as C
from corpusloom.functions.classify import CODE, PROSE
from corpusloom.functions.text import ABBREVIATIONS, SYMBOLS
from corpusloom.operators.chunks import ChunkOptions, cleaned, markdown_chunks

DOCS = "/root/testdata/sf0.001/documents.parquet"
MARKED = [
    "---\ntitle: x\n---\n# Title\n\nSome **bold** and *it* text_with_marks.\n\n```py\ncode\n```\n\nafter `inline\nspan` end", "![alt](a.png) [text](b)", "* one\n* two\n+ three\n  - four\n12. five", "> quote\n>more\n\n---\n***\n___\ntail",
    "a < b and c > d <b>bold</b>", "no marks", "", "   \n\n\n\n  x  y   z \n\n\n", "# Only header", "## Section one\nbody of one\n\n### Sub\n\nbody two. " + "Sentence here! " * 40, "para one is long enough to be kept by the window here.\n \npara two? " + "word " * 300,
]


def one(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    docs = [r.text for r in spark.read.parquet(DOCS).select("text").collect()]
    return MARKED + docs + [rng.choice(MARKED) + "\n\n" + t for t in docs[:80]]


def py_clean(t):
    t = re.sub(r"\A---\s*\n.*?\n---\s*\n", "", t, flags=re.S)
    t = re.sub("`[^`]+`", "", re.sub(r"```.*?```", "", t, flags=re.S))
    t = re.sub("<[^>]+>", "", t)
    for p, r in ((r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"(?m)^>\s*", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^[-*_]{3,}\s*$", "")):
        t = re.sub(p, r, t)
    return re.sub("\n{3,}", "\n\n", re.sub(" +", " ", t)).strip()


def py_pack(para, o):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", para):
        if len(cur) + len(s) + 1 <= o.max_chars:
            cur = f"{cur} {s}".strip()
            continue
        out += [cur] * (len(cur) >= o.min_chars)
        cur = s
    return out + [cur] * (len(cur) >= o.min_chars)


def py_paragraphs(t, o):
    paras = [p.strip() for p in re.split(r"\n\s*\n", t)]
    paras = [p for p in paras if p and (o.include_headers or not re.match(r"#{1,6}\s+", p))]
    return [c for p in paras for c in ([p] if o.min_chars <= len(p) <= o.max_chars else py_pack(p, o) if len(p) > o.max_chars else [])]


def py_sections(t, o):
    parts = [p.strip() for p in re.split(r"(?m)(?=^#{1,6}\s+)", t)]
    if not o.include_headers:
        parts = [re.sub(r"(?m)^#{1,6}\s+(.+)$", "", p).strip() for p in parts]
    return [c for p in parts if p for c in ([p] if o.min_chars <= len(p) <= o.max_chars else py_paragraphs(p, o) if len(p) > o.max_chars else [])]


def test_cleaning(spark, texts):
    assert one(spark, texts, lambda t: cleaned(t, ChunkOptions())) == [py_clean(t) for t in texts]


@pytest.mark.parametrize("options", [ChunkOptions(), ChunkOptions(max_chars=300), ChunkOptions("section", max_chars=200, min_chars=20), ChunkOptions("section", include_headers=True, min_chars=1), ChunkOptions("document", max_chars=500)])
def test_chunks(spark, texts, options):
    how = {"paragraph": py_paragraphs, "section": py_sections, "document": lambda t, o: [t] if o.min_chars <= len(t) <= o.max_chars else py_sections(t, o)}[options.chunk_by]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in sorted(markdown_chunks(frame, "t", ["i"], options).collect(), key=lambda r: (r.i, r.chunk_idx)):
        got.setdefault(r.i, []).append(r.text)
    want = {i: w for i, t in enumerate(texts) if (w := how(py_clean(t), options) if py_clean(t) else [])}
    assert got == want


def test_unknown_chunking(spark):
    with pytest.raises(ValueError):
        markdown_chunks(spark.createDataFrame([("x",)], "t string"), "t", [], ChunkOptions("page"))


def py_normalize(t):
    t = t.lower()
    for s, w in SYMBOLS.items():
        t = t.replace(s, w)
    for s, w in ABBREVIATIONS.items():
        t = re.sub(rf"\b{s}\b", " " + w, t, flags=re.I)
    say = lambda m: f" {'increased ' if m[1][0] == '+' else 'decreased ' if m[1][0] == '-' else ''}{m[1].lstrip('+-').replace('%', ' percent')} "
    t = re.sub(r"([+-]?\d+(?:\.\d+)?%)", say, t)
    t = re.sub(r"[^\w\s]", " ", re.sub(r"\s+", " ", t).strip())
    return re.sub(r"\s+", " ", t).strip()


def test_normalize_for_comparison(spark, texts):
    extra = ["CEO → rev +15% YoY", "3yr 3 yr min minimum 5pm pm", "-2.5% +3% 40% 1.2.3%", "a@b #1 x|y 2×3 q1 Q4", "mom & VARS config_env", "Éclair naïve_x ∴ ok"]
    got = one(spark, texts + extra, C.normalize_for_comparison)
    assert got == [py_normalize(t) for t in texts + extra]
    assert one(spark, [None, ""], C.normalize_for_comparison) == ["", ""]


def test_overlap(spark):
    rows = [("the cat sat down", "the cat ran off", 2 / 6), ("same Words", "same words", 1.0), ("", "x", 0.0), ("a", None, 0.0), ("a b", "c d", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, w double").select("w", C.lexical_overlap(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(r.w - r.x) < 1e-12 for r in got)
    n = spark.createDataFrame([("rev → 5%", "revenue leads to 5 percent")], "a string, b string").select(C.lexical_overlap(F.col("a"), F.col("b"), True).alias("x")).first()
    assert n.x == 1.0


def py_facts(t):
    parts = [p.strip() for s in re.split("[.!?]+", t) if s.strip() for p in re.split(r"\s+(?:and|but|however|also|additionally)\s+", s.strip(), flags=re.I)]
    return [p.lower() for p in parts if len(p) > 10]


def test_facts_and_lines(spark, texts):
    assert one(spark, texts, C.atomic_facts) == [py_facts(t) for t in texts]
    lines = lambda t: sum(bool(s.strip()) and not s.strip().startswith("#") for s in t.strip().split("\n"))
    assert one(spark, texts, C.logical_lines) == [lines(t) for t in texts]


def test_clean_generated(spark):
    cases = {"  <think>a\nb</think>\n out </tool_call>": "out", "```txt\nbody\nmore\n```": "body\nmore", "```one```": "```one```", "``` a": "``` a", "": ""}
    assert one(spark, list(cases), C.clean_generated) == list(cases.values())
    assert one(spark, ["```one```"], lambda t: C.clean_generated(t, unwrap_single_line=True)) == ["one"]


def py_classify(t):
    if not t.strip():
        return "nl", 0.0, 0.0, []
    lines = t.strip().split("\n")
    shown = [n for n, p in CODE.items() if any(re.search(p, x) for x in lines)]
    hit = sum(any(re.search(p, x) for p in CODE.values()) for x in lines)
    score = 0.7 * hit / len(lines) + 0.3 * sum(bool(re.search(p, t)) for p in CODE.values()) / 13
    prose = sum(bool(re.search(p, t)) for p in PROSE.values())
    if score > 0.7:
        return "code", min(score + 0.1, 1), score, shown[:5]
    if score > 0.3:
        return "mixed", 0.6 + (score - 0.3) * 0.5, score, shown[:5]
    return "nl", 1 - score if prose >= 3 else 0.7, score, shown[:5]


def test_classify(spark, texts):
    code = ["def f(x):\n    return x;", "import os\nfrom a import b\nclass X:\n    pass", "const a = 1;\nlet f = (x) => {\n  y;\n}", "Text first.\ndef f(): pass\nThe end?", "x: int = 3", "   \n ", "async function go() {", "if (x) {\n} else {"]
    for t, x in zip(texts + code, one(spark, texts + code, C.classify)):
        domain, sure, score, shown = py_classify(t)
        assert (x.domain, x.indicators) == (domain, shown) and abs(x.confidence - sure) <= 6e-4 and abs(x.code_ratio - score) <= 6e-4, t
