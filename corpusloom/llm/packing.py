"""Best-fit packing of documents into sequences: vector best-fit over tokens, documents and attention cost.

Every bin (sequence) has three capacities: tokens, pieces, and attention cost (the sum of squared piece lengths). A
piece goes into the open bin that has room in every dimension and whose weighted residual norm after placing it is
least (`rule="norm"`), or whose residual has the largest weighted dot product with it (`rule="dot"`); pieces come in
decreasing length. Pieces are dealt evenly into groups of about `GROUP` and each group is packed by itself in one
task, so memory is bounded at any scale and the only waste is a few open bins of each group.

With 2,048 tokens alone (op10, which asks for few sequences) no other capacity can bind: a piece has at least one token,
and squares of lengths sum to at most the square of the sum. `packing_under_limits` is the case where all three do.

Defined results: null text is an empty document (its end-of-text id alone); repeated rows are packed once each; ties
go to the bin opened first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, pieces, small_batches, table
from .wordbpe import shared

#: Tokens of a sequence, pieces in one, pieces packed together by one task, and the id after each document.
TOKENS, PIECES, GROUP, END = 2048, 2048, 32_768, 0
#: Weights of the residuals in tokens, pieces and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 1e-4, 1e-4)
#: Limits that bind: pieces, and a cost of one and a half pieces of half a sequence.
LIMITED = {"most": 12, "cost": 1.5 * (TOKENS // 2) ** 2, "weights": (1.0, 0.5, 1.0), "rule": "dot"}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): whole documents, only longer ones cut."""
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        encoder = shared(vocabulary)
        for batch, _, _ in pieces(batches, "t"):
            rows, keys = [], []
            for n, ids in enumerate(encoder.encode(column(batch, "t"))):
                ids = np.append(ids, END).astype("<u4")
                for k, a in enumerate(range(0, len(ids), tokens)):
                    part = ids[a : a + tokens]
                    rows.append((k, a, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                    keys.append(n)
            k, a, n, crc, part = zip(*rows, strict=True)
            out = [column(batch, "i").take(pa.array(keys)), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array([x.tolist() for x in part], pa.list_(pa.int32()))] if with_ids else []), names=["i", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    small_batches(docs.sparkSession)
    schema = f"i {source.schema['i'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema).withColumnRenamed("i", id_col)


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, most: int = PIECES, cost: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. A piece beyond a capacity by itself gets a bin of its own."""
    cost = float(tokens) ** 2 if cost is None else float(cost)
    caps = np.array([tokens, most, cost])
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / caps
    w = np.array(weights)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, name, filled = np.zeros((3, 1024)), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    opened = made = 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = need.min(0) if len(need) else None
    eps = 1e-12
    for p in order.tolist():
        d, best = need[p], -1
        if opened:
            r = room[:, :opened]
            ok = (r[0] >= d[0] - eps) & (r[1] >= d[1] - eps) & (r[2] >= d[2] - eps)
            if ok.any():
                if rule == "norm":
                    score = w[0] * (r[0] - d[0]) ** 2 + w[1] * (r[1] - d[1]) ** 2 + w[2] * (r[2] - d[2]) ** 2
                else:
                    score = -((w * d) @ r)
                best = int(np.where(ok, score, np.inf).argmin())
        if best < 0:
            if opened == room.shape[1]:
                room, name, filled = np.concatenate([room, np.zeros_like(room)], 1), np.append(name, np.zeros_like(name)), np.append(filled, np.zeros_like(filled))
            best, opened = opened, opened + 1
            room[:, best], name[best], filled[best] = 1.0, made, 0
            made += 1
        bins[p], offsets[p] = name[best], filled[best]
        room[:, best] -= d
        filled[best] += lengths[p]
        if (room[:, best] < least - eps).any():  # no piece fits any more: the last open bin takes its place
            opened -= 1
            if best < opened:
                room[:, best : opened] = room[:, best + 1 : opened + 1]
                name[best : opened], filled[best : opened] = name[best + 1 : opened + 1], filled[best + 1 : opened + 1]
    return bins, offsets


def pack(rows: DataFrame, tokens: int = TOKENS, most: int = PIECES, cost: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length`. The rows are written out first (a checkpoint)."""
    rows = cut(rows)
    groups = max(1, -(-rows.count() // group))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if own:
            whole = pa.Table.from_batches(own).combine_chunks()
            bins, offsets = best_fit(whole.column("length").to_numpy(), tokens, most, cost, weights, rule)
            base = TaskContext.get().partitionId() << 32
            for b in whole.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).to_batches(10_000):
                yield b

    dealt = rows.repartition(groups)  # evenly, whatever the keys
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", sequence_id long, offset long")


def sequence_ids(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry ids; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    return pack(token_pieces(docs, id_col, text_col), **limits)


def packing_under_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, of which a training run takes at most `LIMITED` pieces and attention
    cost: documents are cut at half a sequence, and all three capacities bind, so the weights choose the bins."""
    rows = token_pieces(table(spark, sf_dir, "documents"), tokens=TOKENS // 2)
    return pack(rows, **LIMITED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of docs and their places."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
