"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows of benchmark texts.

Words of an item are ordered by rarity over all documents (one counting pass). A window is contained in a document only
if its rarest word is, so that word is the necessary prefix of the window: document words are joined with prefix words,
the window's place follows from the place of the prefix word in it (positional bound) and must lie inside the document
(length bound), and the survivors are compared word by word, first by hash, then byte for byte.

The benchmark is read in parts of at most `PART_BYTES` of text, each broadcast by itself, so no broadcast grows with the
benchmark. With more than one part the documents are scanned once a part and once more; what a part finds (a bit for each
word of the texts that have hits, each text once) is written out, never the texts, and joined back by a hash of the text.

Defined results: null or wordless texts have no words and no hits; items without words never occur; an item of fewer
than 13 words is one window; repeated documents give repeated rows, repeated items count once by item_id (a null item_id
is the string 'null'); an empty benchmark gives zero hits; an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, column, cut, pieces, positional, small_batches, table
from .words import LOWER, Words, split

#: Words of a window, and bytes of benchmark text in one broadcast.
WINDOW, PART_BYTES = 13, 16 << 20
#: contaminated: at least one of so many words is hit. The pipeline stage asks it of items shorter than a window alone.
SHARE = 20


def words_of(texts: list) -> tuple[Words, np.ndarray]:
    """Words of some texts, and the lower-case bytes that they lie in."""
    data, offs = as_bytes(pa.array(texts, pa.string()))
    return split(data, offs), LOWER[data]


class Index:
    """Windows of one part of the benchmark, to be found by their rarest word."""

    def __init__(self, ids: list[str], texts: list, size: int = WINDOW) -> None:
        w, data = words_of(texts)
        self.names = sorted(set(ids))
        name = {x: i for i, x in enumerate(self.names)}
        n = np.diff(w.first)
        count = np.where(n >= size, n - size + 1, (n > 0).astype(int))
        item = np.repeat(np.arange(len(n)), count)
        self.at = w.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        self.length = np.minimum(n[item], size)
        self.item = np.array([name[x] for x in ids], np.int64)[item]
        self.hashes = w.hashes
        self.raw = [data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
        self.vocabulary = np.unique(w.hashes)

    def order(self, counts: dict[int, int]) -> None:
        """Chooses each window's prefix word: the one in the fewest places of the corpus."""
        rarity = np.array([counts.get(int(x), 0) for x in self.vocabulary], np.int64)
        rank = np.empty(len(rarity), np.int64)
        rank[np.lexsort((self.vocabulary, rarity))] = np.arange(len(rarity))
        of = rank[np.searchsorted(self.vocabulary, self.hashes)] if len(self.hashes) else np.zeros(0, np.int64)
        self.shift = np.array([int(of[a : a + k].argmin()) for a, k in zip(self.at, self.length, strict=True)], np.int64)
        key = self.hashes[self.at + self.shift] if len(self.at) else np.zeros(0, np.uint64)
        by = np.argsort(key, kind="stable")
        self.at, self.length, self.item, self.shift = self.at[by], self.length[by], self.item[by], self.shift[by]
        self.prefix, self.head, self.fan = np.unique(key[by], return_index=True, return_counts=True)
        self.seen = bits(self.prefix)

    def find(self, w: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the texts of w."""
        spot = np.flatnonzero(self.seen[w.hashes >> np.uint64(44)]) if len(self.prefix) else np.zeros(0, np.int64)
        if not len(spot):
            return spot, spot
        near = np.minimum(np.searchsorted(self.prefix, w.hashes[spot]), len(self.prefix) - 1)
        ok = self.prefix[near] == w.hashes[spot]
        spot, near = spot[ok], near[ok]
        fan = self.fan[near]
        window = np.repeat(self.head[near], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        start = np.repeat(spot, fan) - self.shift[window]
        text = np.searchsorted(w.first, np.repeat(spot, fan), "right") - 1
        ok = (start >= w.first[text]) & (start + self.length[window] <= w.first[text + 1])
        start, window = start[ok], window[ok]
        for k in range(int(self.length.max())):
            within = k < self.length[window]
            here, there = np.where(within, start + k, start), np.where(within, self.at[window] + k, self.at[window])
            ok = ~within | (w.hashes[here] == self.hashes[there])
            if not ok.all():
                start, window = start[ok], window[ok]
            if not len(start):
                break
        same = [all(data[w.starts[s + k] : w.ends[s + k]].tobytes() == self.raw[a + k] for k in range(n)) for s, a, n in zip(start.tolist(), self.at[window].tolist(), self.length[window].tolist(), strict=True)]
        return start[same], window[same]


def bits(hashes: np.ndarray) -> np.ndarray:
    """A table of the upper 20 bits that occur: most words are sorted out without a search."""
    out = np.zeros(1 << 20, bool)
    out[hashes >> np.uint64(44)] = True
    return out


def vocabulary_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> dict[int, int]:
    """Places of each benchmark word in all documents; the result has at most a row for each word of the part."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, bits(vocabulary)))

    def run(batches):
        words, seen = shared.value
        total = np.zeros(len(words), np.int64)
        for _, data, offs in pieces(batches, "t"):
            h = split(data, offs).hashes
            h = h[seen[h >> np.uint64(44)]]
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            total += np.bincount(at[words[at] == h], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(total[some])], names=["w", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.w).view(np.uint64)): r.n for r in rows.toLocalIterator()}


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int = PART_BYTES):
    """(ids, texts) of bounded parts, one at a time; rows are dealt by the hash of their text."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = max(1, -(-2 * size // limit)) if size > limit else 1
    for part in range(parts):
        own = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)).collect()
        yield [r.i for r in own], [r.t for r in own], part == parts - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: tuple | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The `keep` columns (the id by default) and n_words, n_hit, n_items, items_sha256, contaminated of each row, and
    full_window: whether a window of `size` words occurs, however long the text is."""
    keep = (id_col,) if keep is None else tuple(keep)
    spark = docs.sparkSession
    small_batches(spark)
    carried = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)), F.col(text_col).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    flat = "".join(f"{k} {kinds[k]}, " for k in carried)
    out = found = None
    for ids, texts, last in benchmark_parts(benchmark, item_col, item_text, part_bytes):
        index = Index(ids, texts, size)
        index.order(vocabulary_counts(docs, text_col, index.vocabulary))
        shared = spark.sparkContext.broadcast(index)
        if last and found is None:
            out = df.mapInArrow(lambda batches, shared=shared: scan(batches, shared.value, size, carried), flat + "n_words long, n_hit long, names array<string>, full_window boolean")
        else:
            hits = df.select("t").mapInArrow(lambda batches, shared=shared: scan_hits(batches, shared.value, size), "h binary, hit binary, names array<string>, full_window boolean")
            hits = cut(hits.groupBy("h").agg(F.first(F.struct("hit", "names", "full_window")).alias("x")))  # equal texts have equal hits
            found = hits if found is None else found.unionByName(hits)
    if found is not None:
        merged = found.groupBy("h").agg(F.collect_list("x").alias("xs")).mapInArrow(merge_hits, "h binary, n_hit long, names array<string>, full_window boolean")
        words = df.mapInArrow(lambda batches: count_words(batches, carried), flat + "h binary, n_words long")
        out = words.join(merged, "h", "left")
    names, n_hit = F.coalesce("names", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select(*carried, "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("full_window", F.lit(False)).alias("full_window"))
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def hits_of(w: Words, data: np.ndarray, index: Index, size: int) -> tuple[np.ndarray, dict[int, list[str]], np.ndarray]:
    """Which words are hit, the sorted items found in each text, and which texts have a full window."""
    start, window = index.find(w, LOWER[data])
    total = len(w.hashes)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.length[window], -1)
    found: dict[int, set] = {}
    full = np.zeros(len(w.first) - 1, bool)
    full[np.searchsorted(w.first, start[index.length[window] == size], "right") - 1] = True
    if len(start):
        text = np.searchsorted(w.first, start, "right") - 1
        for t, i in np.unique(np.stack([text, index.item[window]], 1), axis=0).tolist():
            found.setdefault(t, set()).add(index.names[i])
    return np.cumsum(edge)[:total] > 0, {t: sorted(x) for t, x in found.items()}, full


def scan(batches, index: Index, size: int, carried: list[str]):
    """Words, hits and items of each text, where the benchmark has one part."""
    for batch, data, offs in pieces(batches, "t"):
        w = split(data, offs)
        hit, found, full = hits_of(w, data, index, size)
        sums = np.concatenate([[0], np.cumsum(hit)])
        out = [pa.array(np.diff(w.first), pa.int64()), pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()), pa.array([found.get(t, []) for t in range(batch.num_rows)], pa.list_(pa.string())), pa.array(full)]
        yield pa.RecordBatch.from_arrays([column(batch, k) for k in carried] + out, names=[*carried, "n_words", "n_hit", "names", "full_window"])


def text_hash(data: np.ndarray, offs: np.ndarray, t: int) -> bytes:
    return xxhash.xxh3_128_digest(data[offs[t] : offs[t + 1]].tobytes())


def scan_hits(batches, index: Index, size: int):
    """What one part finds: a bit for each word of every text that has a hit."""
    for _, data, offs in pieces(batches, "t"):
        w = split(data, offs)
        hit, found, full = hits_of(w, data, index, size)
        some = sorted(found)
        maps = [np.packbits(hit[w.first[t] : w.first[t + 1]]).tobytes() for t in some]
        yield pa.RecordBatch.from_arrays([pa.array([text_hash(data, offs, t) for t in some], pa.binary()), pa.array(maps, pa.binary()), pa.array([found[t] for t in some], pa.list_(pa.string())), pa.array(full[some])], names=["h", "hit", "names", "full_window"])


def merge_hits(batches):
    """The union of what all parts found in a text."""
    for batch in batches:
        rows = column(batch, "xs").to_pylist()
        n = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x["hit"], np.uint8) for x in xs])).sum()) for xs in rows]
        names = [sorted({name for x in xs for name in x["names"]}) for xs in rows]
        yield pa.RecordBatch.from_arrays([column(batch, "h"), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([any(x["full_window"] for x in xs) for xs in rows])], names=["h", "n_hit", "names", "full_window"])


def count_words(batches, carried: list[str]):
    for batch, data, offs in pieces(batches, "t"):
        hashes = [text_hash(data, offs, t) for t in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([column(batch, k) for k in carried] + [pa.array(hashes, pa.binary()), pa.array(np.diff(split(data, offs).first), pa.int64())], names=[*carried, "h", "n_words"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("full_window")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows in which no window of 13 words of an item occurs and that are not contaminated, with the
    columns of docs. An item of fewer words can be common speech, so it counts by its share of the text."""
    plain = positional(docs)
    flagged = decontaminate(plain, table(spark, sf_dir, "benchmark"), text_col=plain.columns[docs.columns.index("text")], keep=tuple(plain.columns))
    return flagged.where(~F.col("full_window") & ~F.col("contaminated")).select(plain.columns).toDF(*docs.columns)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, w[i : i + least(len(w), 13) - 1] AS words FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT row_id, w, i, w[i] AS head FROM (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
occ AS (SELECT DISTINCT row_id, item, i, n FROM pos JOIN win ON head = words[1] AND w[i : i + n - 1] = words),
hits AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_id, item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (row_id) LEFT JOIN items USING (row_id)
"""
