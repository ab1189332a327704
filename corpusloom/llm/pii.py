"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they do not describe.

Pattern spans always stay. The field, trained on the driver from a small labelled table, labels every token of every
line; runs of one label become spans if they do not meet a pattern span and hold what their kind needs (a card 13 to 19
digits that pass Luhn, a phone 9 to 15 digits, an address four parts of at most 255, a secret 20 or more hex digits or
characters of a key as base64 and prefixed keys have them, an e-mail a name and a host), so numbers that the patterns
turned down stay out.

Defined results: null text is empty text and has no spans; offsets count code points; equal texts give equal spans and
repeated rows repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pieces, positional, small_batches, table
from .crf import LABELS, Crf, fit_labelled, labelled_table, tokens

KINDS = LABELS[1:]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the first digit of a run and takes whole runs, so possessive runs find the same matches in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
OPENING, CLOSING = "\"'(<[{", "\"'.,;:!?)>]}*%&$#"
#: Characters of keys; a key that is not all hex digits has digits, both cases and this many different characters.
KEY, VARIED = re.compile(r"[A-Za-z0-9+/_.=-]{20,}"), 10
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(DOUBLED[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is all that can stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def holds(kind: str, s: str) -> bool:
    """Whether the text of a labelled run can be what its label says."""
    d = only_digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s)) and all(int(p) <= 255 for p in s.split("."))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|[\[(<]\s*at\s*[\])>])\s*[\w-]+(?:(?:\.|\s*[\[(<]\s*dot\s*[\])>]\s*)[\w-]+)+", s))
    if not KEY.fullmatch(s) or not DIGIT.search(s):
        return False
    return bool(re.fullmatch(r"[0-9a-fA-F]+", s)) or (len(set(s)) >= VARIED and s != s.lower() and s != s.upper())


def field_spans(field: Crf, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """(kind, first byte, one past the last) of labelled runs, trimmed of quotes and punctuation, by text."""
    starts, ends, line = tokens(data, offs)
    out: dict[int, list] = {}
    if not len(starts):
        return out
    labels = field.label(data, starts, ends, line)
    some = np.flatnonzero(labels)
    if not len(some):
        return out
    new = np.append(True, (labels[some][1:] != labels[some][:-1]) | (np.diff(some) > 1) | (line[some][1:] != line[some][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(some)) - 1
    text = np.searchsorted(offs, starts[some[first]], "right") - 1
    for t, i, j in zip(text.tolist(), some[first].tolist(), some[last].tolist(), strict=True):
        a, b = int(starts[i]), int(ends[j])
        s = data[a:b].tobytes().decode("utf-8", "replace")
        kind = LABELS[labels[i]]
        cut = s.lstrip(OPENING if kind != "phone" else "\"'<[{")
        a += len(s[: len(s) - len(cut)].encode())
        kept = cut.rstrip(CLOSING)
        if kept and "�" not in kept and holds(kind, kept):
            out.setdefault(t, []).append((kind, a - int(offs[t]), a + len(kept.encode()) - int(offs[t])))
    return out


def all_spans(texts: list, data: np.ndarray, offs: np.ndarray, field: Crf) -> Iterator[tuple[list, list]]:
    """(pattern spans, all spans) of each text, in code points."""
    added = field_spans(field, data, offs)
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        if i not in added:
            yield base, base
            continue
        points = np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80, dtype=np.int32)  # code points up to each byte
        by_start = sorted((x, y) for _, x, y in base)
        heads, reach = [x for x, _ in by_start], list(accumulate((y for _, y in by_start), max))
        more = []
        for kind, a, b in added[i]:
            a, b = int(points[a]) - 1, int(points[b - 1])
            k = bisect_left(heads, b)
            if not k or reach[k - 1] <= a:  # meets no pattern span
                more.append((kind, a, b))
        yield base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or union of spans that meet, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text_col: str = "text", keep: tuple = (), field: Crf | None = None) -> DataFrame:
    """The `keep` columns and n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted (null for a null text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or fit_labelled(labelled_table()))
    carried = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)), F.col(text_col).alias("t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for batch, data, offs in pieces(batches, "t"):
            texts, rows = column(batch, "t").to_pylist(), []
            for text, (base, spans) in zip(texts, all_spans(texts, data, offs, shared.value), strict=True):
                counts = [sum(k == x for k, _, _ in base) for x in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(spans), redact(text, spans) if spans else text))
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in carried] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*carried, *OUT])

    out = source.mapInArrow(run, kinds + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


OUT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(table(spark, sf_dir, "documents"), keep=("doc_id",)).drop("redacted")


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, with personal data replaced in its text and n_chars, if there, counted anew."""
    plain = positional(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    out = scan(plain, names["text"], tuple(c for c in plain.columns if c != names["text"]))
    counted = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None
    cols = [F.col("redacted") if n == "text" else F.coalesce(counted, F.col(c)) if n == "n_chars" else F.col(c) for n, c in names.items()]
    return out.select(*(c.alias(p) for c, p in zip(cols, plain.columns, strict=True))).toDF(*docs.columns)
