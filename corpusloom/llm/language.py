"""Language identification with error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1; for every bit a linear classifier over relative n-gram frequencies is fitted
(ridge regression to the bit). A text's outputs are decoded to the language with the least loss, each bit weighted by
how well its classifier separates the training rows; `score` is the gap between the nearest and the next codeword as a
share of their sum, and a text whose score is under `AMBIGUOUS` is flagged.

Training uses at most `PER_LANGUAGE` rows of each language and `TRAINING_ROWS` in all (but one of each language at
least), of the `LANGUAGES` values of the language column that most rows have: those with the least hashes of id and text among all its labelled training rows. Only some hashes and the n-gram
frequencies of these rows reach the driver; a repeated row comes once, with its count. Prediction reads the text alone.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learned; with one learned
language every other text gets it with score 1; a null id is not held out; equal texts get equal results, repeated rows
repeated ones; ties go to the language that sorts first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pieces, positional, small_batches, table
from .words import LOWER, randoms

#: Orders of the n-grams, buckets that they are hashed to, most training rows of a language, and the ridge.
ORDERS, BUCKETS, PER_LANGUAGE, RIDGE = (1, 2, 3, 4), 4096, 500, 1e-3
#: Most training rows in all, shared equally when there are many languages, and most languages: those with most rows.
TRAINING_ROWS, LANGUAGES = 4000, 500
#: Below this score a text's language is ambiguous. Columns of a code for more than five languages, for each doubling.
AMBIGUOUS, COLUMNS = 0.05, 10
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def frequencies(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of each text's hashed n-grams; a row for each text."""
    n = np.diff(offs)
    owner = np.repeat(np.arange(len(n)), n)
    low = LOWER[data].astype(np.uint64)
    factor = randoms(max(ORDERS), 31) | np.uint64(1)
    left = np.repeat(offs[1:], n) - np.arange(len(data))  # bytes to the end of the text
    out = np.zeros((len(n), BUCKETS), np.float32)
    value = np.zeros(len(data), np.uint64)
    for k in range(max(ORDERS)):
        value[: max(0, len(data) - k)] += (low[k:] + np.uint64(1)) * factor[k]
        if k + 1 in ORDERS:
            ok = left > k
            bucket = ((value[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
            out += np.bincount(owner[ok] * BUCKETS + bucket, minlength=out.size).reshape(out.shape)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split for up to five languages, else the best of some random codes by least distance."""
    if n <= 5:
        columns = [(1, *x) for x in itertools.product((1, -1), repeat=max(0, n - 1)) if -1 in x]
        return np.array(columns, float).reshape(len(columns), n).T
    width, best, most = int(np.ceil(COLUMNS * np.log2(n))), None, -1
    for seed in range(64):
        code = np.where((randoms(n * width, 1000 + seed) >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(n, width)
        apart = (width - code @ code.T) / 2
        np.fill_diagonal(apart, width)
        if apart.min() > most and (abs(code.sum(0)) < n).all():
            best, most = code, apart.min()
    return best


class Model:
    def __init__(self, languages: list[str], features: np.ndarray, labels: np.ndarray) -> None:
        self.languages = languages
        if len(languages) < 2:
            return
        self.code = codewords(len(languages))
        bits = self.code[labels]
        self.mean = features.mean(0)
        x = features - self.mean
        share = 1 / np.bincount(labels, minlength=len(languages))[labels]  # every language weighs the same
        root = np.sqrt(share / share.mean())[:, None].astype(np.float32)
        x *= root
        k = (x @ x.T).astype(np.float64)
        k[np.diag_indices(len(k))] += RIDGE * max(float(np.trace(k)), 1e-9) / len(k)
        self.weights = (x.T @ np.linalg.solve(k, bits * root)).astype(np.float32)
        margin = (x @ self.weights) * bits
        right = np.clip((share[:, None] * (margin > 0)).sum(0) / share.sum(), 0.501, 0.999)
        self.trust = np.log(right / (1 - right))

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row."""
        if len(self.languages) < 2:
            return np.zeros(len(features), int), np.ones(len(features))
        out = (features - self.mean) @ self.weights
        loss = (np.maximum(0, 1 - out[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.sort(loss, 1)
        return loss.argmin(1), np.clip((order[:, 1] - order[:, 0]) / np.maximum(order[:, 1] + order[:, 0], 1e-12), 0, 1)


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def up_to(most: dict[str, int]):
    """Whether a row's hash is at most that of its language; languages without one are left out."""
    return F.col("h") <= F.element_at(F.create_map(*(F.lit(x).cast(t) for k, v in most.items() for x, t in ((k, "string"), (v, "long")))), F.col("l"))


def least_hashes(rows: DataFrame, counts: dict[str, int], each: int) -> dict[str, dict[int, int]]:
    """The `each` least hashes of every language, with the times that they are taken. Only hashes below a limit are
    counted, which twice as many rows should pass; where repeated rows leave too few, the limit is raised."""
    out, share = {}, {k: min(1.0, (2 * each + 64) / n) for k, n in counts.items()}
    while share:
        most = {k: min(int(x * 2**64), 2**64 - 1) - 2**63 for k, x in share.items()}
        met: dict[str, list] = {k: [] for k in share}
        for r in rows.where(up_to(most)).groupBy("l", "h").agg(F.count("*").alias("n")).toLocalIterator():
            met[r.l].append((r.h, r.n))
        for k, pairs in met.items():
            left, taken = each, {}
            for h, n in sorted(pairs):
                if left:
                    taken[h] = min(n, left)
                    left -= taken[h]
            if not left or share[k] == 1:
                out[k] = taken
                del share[k]
            else:
                share[k] = min(1.0, 16 * share[k])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, training_rows: int = TRAINING_ROWS) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where(~held_out("i") & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, np.zeros((0, BUCKETS)), np.zeros(0, int))
    each = max(1, int(min(per_language, training_rows / len(languages))))
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    weights = least_hashes(rows, counts, each)

    def run(batches):
        for batch, data, offs in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([column(batch, "l"), column(batch, "h"), pa.array([x.tobytes() for x in frequencies(data, offs).astype(np.float16)], pa.binary())], names=["l", "h", "x"])

    chosen = rows.where(up_to({k: max(w) for k, w in weights.items()})).groupBy("l", "h").agg(F.first("t").alias("t"))
    found = sorted((r.l, bytes(r.x), r.h) for r in chosen.mapInArrow(run, "l string, h long, x binary").toLocalIterator())
    found = [(k, x) for k, x, h in found for _ in range(weights[k][h])]
    seen = sorted({k for k, _ in found})
    values = np.frombuffer(b"".join(x for _, x in found), np.float16).astype(np.float32).reshape(len(found), BUCKETS)
    return Model(seen, values, np.array([seen.index(k) for k, _ in found], int))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The `keep` columns and lang_pred, score, ambiguous of each row, from its text alone."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)), F.col(text_col).alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch, data, offs in pieces(batches, "t"):
            letters = np.concatenate([[0], np.cumsum(LETTER[data])])
            known = letters[offs[1:]] > letters[offs[:-1]]
            for i in np.flatnonzero(~known & (np.diff(offs) > 0)).tolist():
                known[i] = any(map(str.isalpha, column(batch, "t")[i].as_py()))
            best, score = m.predict(frequencies(data, offs))
            known &= len(m.languages) > 0
            best, score = np.where(known, best, len(m.languages)), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in carried] + [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)], names=[*carried, "lang_pred", "score", "ambiguous"])

    out = source.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double, ambiguous boolean")
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those of them that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs), keep=("doc_id",)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows without a letter (null ones too) go. The decoded language and `ambiguous` decide nothing here,
    and with nothing to learn from, rows with a letter stay."""
    plain = positional(docs)
    i, t, l = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text", "lang"))
    model = train(plain, i, t, l)
    if not model.languages:
        return plain.where(F.col(t).rlike(r"\p{L}")).toDF(*docs.columns)
    out = identify(plain, model, t, tuple(plain.columns))
    return out.where("lang_pred <> 'und'").select(plain.columns).toDF(*docs.columns)
