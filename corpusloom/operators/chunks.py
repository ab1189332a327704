"""Markdown to chunks, by paragraph, section or document, in expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_marks, normalize_space, strip, strip_code, strip_frontmatter, strip_tags
from ..functions.text import let


@dataclass(frozen=True)
class ChunkOptions:
    chunk_by: str = "paragraph"
    strip_frontmatter: bool = True
    strip_code_blocks: bool = True
    strip_html: bool = True
    min_chars: int = 50
    max_chars: int = 2000
    include_headers: bool = False


NONE = "cast(array() as array<string>)"


def sentences(x: Column) -> Column:
    return F.split(x, r"(?U)(?<=[.!?])\s+")


def pack_sentences(parts: Column, low: int, high: int) -> Column:
    """Sentences put together greedily up to `high` characters; packs under `low` are dropped, one longer sentence stays."""
    start = F.struct(F.lit("").alias("cur"), F.expr(NONE).alias("out"))
    flush = lambda a: F.when(F.length(a.cur) >= low, F.array_append(a.out, a.cur)).otherwise(a.out)
    step = lambda a, s: F.when(F.length(a.cur) + F.length(s) + 1 <= high, F.struct(strip(F.concat(a.cur, F.lit(" "), s)).alias("cur"), a.out.alias("out"))).otherwise(F.struct(s.alias("cur"), flush(a).alias("out")))
    return F.aggregate(parts, start, step, flush)


def by_paragraph(x: Column, o: ChunkOptions) -> Column:
    kept = F.filter(F.transform(F.split(x, r"(?U)\n\s*\n"), strip), lambda p: (p != "") & (F.lit(o.include_headers) | ~p.rlike(r"(?U)\A#{1,6}\s+")))
    one = lambda p: F.when(F.length(p).between(o.min_chars, o.max_chars), F.array(p)).when(F.length(p) > o.max_chars, pack_sentences(sentences(p), o.min_chars, o.max_chars)).otherwise(F.expr(NONE))
    return F.flatten(F.transform(kept, one))


def by_section(x: Column, o: ChunkOptions) -> Column:
    parts = F.transform(F.split(x, r"(?dmU)(?=^#{1,6}\s+)"), strip)
    if not o.include_headers:
        parts = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"(?dmU)^#{1,6}\s+(.+)$", "")))
    one = lambda s: F.when(F.length(s).between(o.min_chars, o.max_chars), F.array(s)).when(F.length(s) > o.max_chars, by_paragraph(s, o)).otherwise(F.expr(NONE))
    return F.flatten(F.transform(F.filter(parts, lambda s: s != ""), one))


def by_document(x: Column, o: ChunkOptions) -> Column:
    return let(strip(x), lambda whole: F.when(F.length(whole).between(o.min_chars, o.max_chars), F.array(whole)).otherwise(by_section(whole, o)))


def cleaned(x: Column, o: ChunkOptions) -> Column:
    if o.strip_frontmatter:
        x = strip_frontmatter(x)
    if o.strip_code_blocks:
        x = strip_code(x)
    if o.strip_html:
        x = strip_tags(x)
    return normalize_space(clean_marks(x))


def chunks(x: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """array<string> of a document's chunks. Give it a column, not a long expression: the text is used many times."""
    kinds = {"paragraph": by_paragraph, "section": by_section, "document": by_document}
    if options.chunk_by not in kinds:
        raise ValueError(f"Unknown chunk_by value: {options.chunk_by}")
    return F.when(x == "", F.expr(NONE)).otherwise(kinds[options.chunk_by](x, options))


def markdown_chunks(df: DataFrame, text_col: str, keep: list[str], options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """One row for each chunk: the `keep` columns, chunk_idx and text."""
    clean = df.select(*keep, cleaned(F.col(text_col), options).alias("clean_text"))
    return clean.select(*keep, F.posexplode(chunks(F.col("clean_text"), options)).alias("chunk_idx", "text"))
