"""Prose, code or mixed: a score from patterns on lines and on the whole text, in expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Signs of code (fixed values, in order).
CODE = {
    "python_def": r"\bdef\s+\w+\s*\(",
    "python_class": r"\bclass\s+\w+\s*[:\(]",
    "python_import": r"(?m)^\s*(import|from)\s+\w+",
    "python_decorator": r"(?m)^\s*@\w+",
    "js_function": r"\bfunction\s+\w+\s*\(",
    "js_const_let": r"\b(const|let|var)\s+\w+\s*=",
    "js_arrow": r"=>\s*[{\(]?",
    "js_async": r"\basync\s+(function|def|\()",
    "curly_blocks": r"(?s)\{\s*\n.*\n\s*\}",
    "semicolon_lines": r"(?m);\s*$",
    "type_annotation": r":\s*(int|str|float|bool|list|dict|Any|None)\b",
    "return_statement": r"(?m)^\s*return\s+",
    "if_else_block": r"(?m)^\s*(if|else|elif|else if)\s*[\(:]",
}
#: Signs of prose (fixed values, in order).
PROSE = {
    "sentence_end": r"[.!?]\s+[A-Z]",
    "paragraph": r"\n\n[A-Z]",
    "articles": r"(?i)\b(the|a|an)\s+\w+",
    "conjunctions": r"(?i)\b(and|but|or|however|therefore)\b",
    "questions": r"(?m)\?$",
}
#: What every match of a sign has in it: of each string's parts one, of all strings. It spares most texts the search.
HOLDS = {
    "python_def": ["def"], "python_class": ["class"], "python_import": ["import from"], "python_decorator": ["@"], "js_function": ["function"],
    "js_const_let": ["const let var", "="], "js_arrow": ["=>"], "js_async": ["async"], "curly_blocks": ["{", "}"], "semicolon_lines": [";"],
    "type_annotation": [":"], "return_statement": ["return"], "if_else_block": ["if else", "( :"],
}
MIXED_ABOVE, CODE_ABOVE, STRONG_PROSE = 0.3, 0.7, 3


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(f"(?dU){pattern}")


def shows(x: Column, name: str) -> Column:
    """Whether a text shows a sign of code."""
    one_of = lambda parts: reduce(lambda a, b: a | b, (F.contains(x, F.lit(s)) for s in parts.split()))
    return reduce(lambda a, b: a & b, map(one_of, HOLDS[name])) & matches(x, CODE[name])


def _parts(x: Column) -> Column:
    """struct(t, blank, lines) of a text."""
    return F.struct(x.alias("t"), (strip(x) == "").alias("blank"), F.split(strip(x), "\n").alias("lines"))


def _score(p: Column) -> Column:
    shown = F.size(F.filter(p.lines, lambda line: reduce(lambda a, b: a | b, (shows(line, s) for s in CODE))))
    signs = reduce(lambda a, b: a + b, (shows(p.t, s).cast("int") for s in CODE))
    return F.when(p.blank, 0.0).otherwise(0.7 * (shown / F.size(p.lines)) + 0.3 * (signs / len(CODE)))


def code_score(x: Column) -> Column:
    """0.7 of the share of lines that show code, 0.3 of the share of code signs in the whole text; 0 for blank text."""
    return let(_parts(F.coalesce(x, F.lit(""))), _score)


def _domain(score: Column, mixed_above: float, code_above: float) -> Column:
    return F.when(score > code_above, "code").when(score > mixed_above, "mixed").otherwise("nl")


def score_and_domain(x: Column, mixed_above: float = MIXED_ABOVE, code_above: float = CODE_ABOVE) -> Column:
    """struct(score, domain) alone, without the signs of prose and the indicators that `classify` looks for besides."""
    return let(code_score(x), lambda s: F.struct(s.alias("score"), _domain(s, mixed_above, code_above).alias("domain")))


def _on_line(name: str):
    return lambda line: shows(line, name)


def classify(x: Column, mixed_above: float = MIXED_ABOVE, code_above: float = CODE_ABOVE) -> Column:
    """struct(domain, confidence, code_ratio, indicators); numbers rounded to three digits, at most five indicators."""

    def measured(p: Column) -> Column:
        prose = reduce(lambda a, b: a + b, (matches(p.t, s).cast("int") for s in PROSE.values()))
        shown = F.array_compact(F.array(*(F.when(F.exists(p.lines, _on_line(name)), name) for name in CODE)))
        return F.struct(p.blank.alias("blank"), _score(p).alias("score"), prose.alias("prose"), F.slice(shown, 1, 5).alias("shown"))

    def verdict(m: Column) -> Column:
        code, mixed = m.score > code_above, m.score > mixed_above
        sure = F.when(code, F.least(m.score + 0.1, F.lit(1.0))).when(mixed, 0.6 + (m.score - mixed_above) * 0.5).otherwise(F.when(m.prose >= STRONG_PROSE, 1.0 - m.score).otherwise(0.7))
        return F.struct(
            _domain(m.score, mixed_above, code_above).alias("domain"),
            F.when(m.blank, 0.0).otherwise(F.round(sure, 3)).alias("confidence"),
            F.round(m.score, 3).alias("code_ratio"),
            F.when(m.blank, F.expr("cast(array() as array<string>)")).otherwise(m.shown).alias("indicators"),
        )

    return let(let(_parts(F.coalesce(x, F.lit(""))), measured), verdict)
