"""Text expressions: cleaning of marked-up text, normalisation, tokens, overlaps, facts.

Patterns run in Java's engine: `(?U)` gives Unicode classes, `(?d)` makes a line feed the only line end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols and what they stand for (fixed values, applied in this order).
SYMBOLS = {
    "→": " leads to ", "←": " from ", "↔": " bidirectional ", "∵": " because ", "∴": " therefore ", "⇒": " implies ",
    "∧": " and ", "∨": " or ", "@": " at ", "#": " number ", "|": " , ", "×": " times ",
}
#: Whole-word abbreviations and what they stand for (fixed values, applied in this order).
ABBREVIATIONS = {
    "yr": "year", "yrs": "years", "mo": "month", "mos": "months", "wk": "week", "wks": "weeks", "hr": "hour", "hrs": "hours",
    "min": "minute", "mins": "minutes", "sr": "senior", "jr": "junior", "mgr": "manager", "dir": "director",
    "vp": "vice president", "ceo": "chief executive officer", "cto": "chief technology officer", "swe": "software engineer",
    "pm": "product manager", "pt": "patient", "dx": "diagnosis", "rx": "prescription", "hx": "history", "tx": "treatment",
    "yoy": "year over year", "mom": "month over month", "qoq": "quarter over quarter", "q1": "first quarter",
    "q2": "second quarter", "q3": "third quarter", "q4": "fourth quarter", "rev": "revenue", "prev": "previous",
    "curr": "current", "fn": "function", "ret": "return", "param": "parameter", "params": "parameters",
    "impl": "implementation", "config": "configuration", "env": "environment", "var": "variable", "vars": "variables",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The characters that `(?U)\s` stands for.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends (any Unicode white space, line ends too)."""
    return F.btrim(x, F.lit(SPACE))


def where_any(x: Column, signs: str, body: Callable[[Column], Column]) -> Column:
    """body(x) for texts that have one of the characters, which spares the rest a search by pattern; else x."""
    return let(x, lambda p: F.when(reduce(lambda a, b: a | b, (F.contains(p, F.lit(c)) for c in signs)), body(p)).otherwise(p))


def strip_frontmatter(x: Column) -> Column:
    return F.regexp_replace(x, r"(?sU)\A---\s*\n.*?\n---\s*\n", "")


def strip_code(x: Column) -> Column:
    """Without fenced code, then without inline code, which may span lines."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)```.*?```", ""), "`[^`]+`", "")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


#: Marks to remove, what stays, and characters one of which is in every such mark, in this order; links go first, so an
#: image leaves its `!` and alternative text.
MARKS = [
    (r"\[([^\]]+)\]\([^)]+\)", "$1", "["), (r"!\[([^\]]*)\]\([^)]+\)", "", "["), (r"\*\*([^*]+)\*\*", "$1", "*"), (r"\*([^*]+)\*", "$1", "*"),
    (r"__([^_]+)__", "$1", "_"), (r"_([^_]+)_", "$1", "_"), (r"(?dmU)^>\s*", "", ">"), (r"(?dmU)^\s*[-*+]\s+", "", "-*+"),
    (r"(?dmU)^\s*\d+\.\s+", "", "."), (r"(?dmU)^[-*_]{3,}\s*$", "", "-*_"),
]


def clean_marks(x: Column) -> Column:
    for pattern, kept, signs in MARKS:
        x = where_any(x, signs, lambda p, pattern=pattern, kept=kept: F.regexp_replace(p, pattern, kept))
    return x


def normalize_space(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, " +", " "), "\n{3,}", "\n\n"))


def logical_lines(x: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(F.split(strip(x), "\n"), lambda line: (strip(line) != "") & ~F.startswith(strip(line), F.lit("#"))))


def _expand(x: Column) -> Column:
    """Abbreviations one after another, each only where it is a word of the text (no expansion holds one); letters that
    fold to ASCII ones (long s, dotless and dotted i, Kelvin) send a text to all patterns."""
    odd = x.rlike("[\u017f\u0131\u0130\u212a\u0307]")
    words_of = F.array_intersect(F.split(x, r"(?U)\W+"), F.array(*map(F.lit, ABBREVIATIONS)))

    def step(short: str, words: str) -> Callable[[Column], Column]:
        plain = lambda v: F.regexp_replace(v, rf"(?U){short}(?<!\w{short})(?!\w)", f" {words}")  # noqa: E731 - letters first, found fast
        folded = lambda v: F.regexp_replace(v, rf"(?iU)\b{short}\b", f" {words}")
        return lambda p: F.struct(F.when(p.odd, folded(p.v)).when(F.array_contains(p.w, F.lit(short)), plain(p.v)).otherwise(p.v).alias("v"), p.odd.alias("odd"), p.w.alias("w"))

    def all_steps(p: Column) -> Column:
        for short, words in ABBREVIATIONS.items():
            p = let(p, step(short, words))
        return p["v"]

    return let(F.struct(x.alias("v"), odd.alias("odd"), words_of.alias("w")), lambda p: F.when(p.odd | (F.size(p.w) > 0), all_steps(p)).otherwise(p.v))


def _percentages(x: Column) -> Column:
    number = r"(\d+(?:\.\d+)?)%"
    for sign, words in ((r"\+", " increased $1 percent "), ("-", " decreased $1 percent "), ("", " $1 percent ")):
        x = F.regexp_replace(x, f"(?U){sign}{number}", words)
    return x


def normalize_for_comparison(x: Column) -> Column:
    """Symbols, abbreviations and percentages written out in lower case, then words alone; empty for null."""
    x = F.lower(F.coalesce(x, F.lit("")))
    for symbol, words in SYMBOLS.items():
        x = F.replace(x, F.lit(symbol), F.lit(words))
    x = where_any(let(x, _expand), "%", _percentages)
    return strip(F.regexp_replace(x, r"(?U)\W+", " "))


def token_set(x: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(x), r"(?U)\s+"), ""))


def lexical_overlap(a: Column, b: Column, normalize: bool = False) -> Column:
    """Jaccard similarity of token sets; 0 where one is empty or null."""
    if normalize:
        a, b = normalize_for_comparison(a), normalize_for_comparison(b)
    sets = F.struct(token_set(F.coalesce(a, F.lit(""))).alias("x"), token_set(F.coalesce(b, F.lit(""))).alias("y"))
    sized = lambda p: F.struct(F.size(p.x).alias("x"), F.size(p.y).alias("y"), F.size(F.array_intersect(p.x, p.y)).alias("both"))
    return let(let(sets, sized), lambda n: F.when((n.x == 0) | (n.y == 0), 0.0).otherwise(n.both / (n.x + n.y - n.both)))


def atomic_facts(x: Column) -> Column:
    """Clauses of more than ten characters, in lower case: sentences cut at five conjunctions (fixed values)."""
    parts = F.flatten(F.transform(F.split(x, "[.!?]+"), lambda s: F.split(strip(s), r"(?iU)\s+(?:and|but|however|also|additionally)\s+")))
    return F.transform(F.filter(F.transform(parts, strip), lambda p: F.length(p) > 10), F.lower)


def clean_generated(x: Column, unwrap_single_line: bool = False) -> Column:
    """Model output without reasoning blocks, a stray closing tag and a fence around the whole. A fence on one line is
    unwrapped on request; without it such text stays as it is."""
    x = strip(F.regexp_replace(strip(x), r"(?s)<think>.*?</think>", ""))
    x = strip(F.replace(x, F.lit("</tool_call>"), F.lit("")))
    lines = F.split(x, "\n")
    inner = strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    single = strip(F.substring(x, F.lit(4), F.greatest(F.length(x) - 6, F.lit(0)))) if unwrap_single_line else x
    return F.when(F.startswith(x, F.lit("```")) & F.endswith(x, F.lit("```")), F.when(F.size(lines) >= 2, inner).otherwise(single)).otherwise(x)
