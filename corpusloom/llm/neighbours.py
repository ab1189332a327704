"""N-gram Jaccard join: a MinHash LSH forest of sorted prefix tries, then exact verification.

1. Each whole text becomes its set of five-word shingles (64-bit hashes), a digest of that set, and a MinHash signature.
   Texts with one set are one class from here on; only one row of each goes further.
2. Forest: a signature is cut into labels, one for each tree; all labels of a tree are sorted, which lays out its prefix
   trie. Rows are sorted by range over (tree, label, digest), so any run of equal labels can be split over tasks. A pass
   over the order gives for each row the length of the prefix that it shares with the one before; rows that share a
   prefix of length d lie side by side, so the links with prefix >= d chain up exactly the nodes of depth d.
3. Adaptive depth: starting at whole labels, chains at the depth are joined into candidate groups and the groups are
   verified exactly. Of the links found, those whose sets share a prefix of the depth were met by the forest itself; one
   of similarity s stands for 1 / P_d(s) links that exist, P_d being the forest's chance to meet such a pair. While links
   found / links estimated is below the target recall, the prefix is shortened, to the longest that should meet enough of
   the links found so far; groups that a shorter prefix leaves as they were are not verified again. The shortest prefix is
   the longest whose chance reaches the target at the threshold itself, so the target holds there by calculation; with
   no links at all to estimate from, that prefix is used.
4. Verification: a group of up to `BLOCK` sets is one unit of work. In a larger one every set is first compared with the
   group's centre, the set of shingles that most of a block of its sets have. Jaccard distance is a metric, so two sets
   near the centre are linked for sure and two at different distances from it are not; sets are told apart by bands of
   distance, such pairs are counted by band, and only the remaining pairs of blocks become units. So a group of near
   copies, whatever its size, costs one comparison a set, and no unit grows with a group. A unit counts links of its
   sets and their local components; pairs are never emitted. The components of verified links are the classes.

Defined results: words are runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters; a text of fewer than
five words, but not none, has one shingle; null, empty and wordless texts have none and are never linked; one output row
for each input row; `n_links` is the number of other rows at or above the threshold, equal sets included; `class_id` is
the least id of the class (null ids come last); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, column, cut, pieces, positional, small_batches, table
from .components import connected_components
from .words import randoms, shingles, split

SIZE, THRESHOLD = 5, 0.8
#: Trees of the forest, values of a whole label, and the share of links to be found.
TREES, DEPTH, RECALL = 20, 7, 0.998
#: Sets of a block of verification, columns of its dense products, and bands of distance that reach the threshold's.
BLOCK, WIDTH, BANDS = 128, 2048, 10
#: Bits of the filter that keeps texts without candidates out of the shuffle, for each candidate and at most (8 MB).
FILTER_EACH, FILTER_MOST = 16, 1 << 26


def shingle_sets(batches, text_col: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, data, offs in pieces(batches, text_col):
        h, first = shingles(split(data, offs), size)
        yield batch, [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def minhash(sets: list[np.ndarray], factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """16 bits of the least of factor * h + shift over each set, for every factor; sets are not empty. Upper and lower bits
    are folded, as the upper ones of the least are small for large sets; values that are equal by chance, one in 65,536,
    make candidates, never links."""
    out = np.zeros((len(sets), len(factor)), ">u2")
    step, i = 1 << 15, 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= step):
            n += len(sets[j])
            j += 1
        h, first = np.concatenate(sets[i:j]), np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(len(factor)):
            least = np.minimum.reduceat(h * factor[k] + shift[k], first)
            out[i:j, k] = (least ^ (least >> np.uint64(32))) & np.uint64(0xFFFF)
        i = j
    return out


def signatures(rows: DataFrame, size: int, forest: Forest) -> DataFrame:
    """(i, k, digest, n, sig) for rows (i, k, t); digest, n and sig are null without words."""

    def run(batches):
        for batch, sets in shingle_sets(batches, "t", size):
            full = [x for x in sets if len(x)]
            sigs = iter(forest.signatures(full))
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "i"), column(batch, "k"), pa.array(digests, pa.binary()), pa.array([len(x) or None for x in sets], pa.int32()), pa.array([next(sigs).tobytes() if len(x) else None for x in sets], pa.binary())], names=["i", "k", "digest", "n", "sig"])

    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, k string, digest binary, n int, sig binary")


def trie_links(reps: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, lcp): neighbours in the sorted order of a tree that share a prefix of at least `least` values."""
    width = 2 * depth
    labels = reps.select("digest", F.posexplode(F.array(*(F.substring("sig", 1 + t * width, width) for t in range(trees)))).alias("tree", "label"))
    ordered = labels.repartitionByRange("tree", "label", "digest").sortWithinPartitions("tree", "label", "digest")

    def run(batches):
        part, last, opened = TaskContext.get().partitionId(), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, _ = as_bytes(column(batch, "label"))
            values, tree = raw.reshape(-1, depth, 2).view(">u2")[:, :, 0], column(batch, "tree").to_numpy()
            digests = column(batch, "digest").to_pylist()
            edge = []
            if not opened:
                edge.append((digests[0], None, 0, part, int(tree[0]), raw[:width].tobytes()))
                opened = True
            elif last[1] == tree[0] and (n := prefix(last[2][None], values[:1])[0]) >= least:
                edge.append((last[0], digests[0], int(n), None, None, None))
            same = np.where(tree[1:] == tree[:-1], prefix(values[1:], values[:-1]), 0)
            edge += [(digests[i], digests[i + 1], int(same[i]), None, None, None) for i in np.flatnonzero(same >= least).tolist()]
            last = digests[-1], tree[-1], values[-1].copy()
            yield to_batch(edge)
        if opened:
            yield to_batch([(last[0], None, 1, part, int(last[1]), last[2].astype(">u2").tobytes())])

    found = cut(ordered.mapInArrow(run, "a binary, b binary, lcp int, part int, tree int, label binary"))
    # the last row of a task and the first of the next are neighbours too: two rows a task
    ends = sorted((r.part, r.lcp, r.tree, bytes(r.label), bytes(r.a)) for r in found.where("part is not null").collect())
    seams = []
    for x, y in zip(ends[1::2], ends[2::2]):
        n = int(prefix(np.frombuffer(x[3], ">u2")[None], np.frombuffer(y[3], ">u2")[None])[0])
        if x[2] == y[2] and n >= least:
            seams.append((bytearray(x[4]), bytearray(y[4]), n))
    spark = reps.sparkSession
    return found.where("part is null").select("a", "b", "lcp").union(spark.createDataFrame(seams, "a binary, b binary, lcp int"))


def prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(x == y, axis=1).sum(1)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["a", "b", "lcp", "part", "tree", "label"])


def chance(s: np.ndarray, trees: int, depth: int) -> np.ndarray:
    return 1 - (1 - s**depth) ** trees


def shortest(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold itself is met with the target's chance."""
    for d in range(depth, 0, -1):
        if chance(threshold, trees, d) >= recall:
            return d
    raise ValueError(f"{trees} trees can't reach recall {recall} at similarity {threshold}")


class Unit:
    """Sets of one unit of verification: block pairs (x, y) link sets of x with sets of y, all pairs if x = y."""

    def __init__(self) -> None:
        self.digests, self.side, self.copies, self.sets = [], [], [], []

    def add(self, digest, side, copies, values) -> None:
        self.digests.append(digest)
        self.side.append(side)
        self.copies.append(copies)
        self.sets.append(values)

    def shared(self) -> np.ndarray:
        """Sizes of all intersections, by products of 0/1 matrices over slices of the values that occur twice."""
        n = len(self.sets)
        out = np.zeros((n, n), np.float32)
        owner = np.repeat(np.arange(n), [len(x) for x in self.sets])
        values = np.concatenate(self.sets)
        order = np.argsort(values, kind="stable")
        owner, values = owner[order], values[order]
        new = np.append(True, values[1:] != values[:-1])
        rank = np.cumsum(new) - 1
        often = np.bincount(rank)[rank] > 1
        owner, rank = owner[often], rank[often]
        rank = np.cumsum(np.append(True, rank[1:] != rank[:-1])) - 1 if len(rank) else rank
        for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, WIDTH):
            lo, hi = np.searchsorted(rank, [a, a + WIDTH])
            m = np.zeros((n, min(WIDTH, int(rank[-1]) + 1 - a)), np.float32)
            m[owner[lo:hi], rank[lo:hi] - a] = 1
            out += m @ m.T
        return np.rint(out).astype(np.int64)

    def rows(self, threshold: float, forest: Forest) -> list[tuple]:
        """(digest, links to sets, links to rows, least digest linked with, estimates) of each set that has links. The
        estimates are, for prefixes of 1, 2, ... values: the links that those met by it stand for, and how many it should
        meet."""
        if len(self.sets) < 2:
            return []
        both = self.shared()
        size = np.array([len(x) for x in self.sets])
        union = size[:, None] + size[None] - both
        linked = both >= threshold * union - 1e-9
        side = np.array(self.side)
        if side.min() != side.max():
            linked &= side[:, None] != side[None]
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return []
        order = np.array(sorted(range(len(self.digests)), key=self.digests.__getitem__))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        low = rank.copy()
        while True:
            new = np.minimum(low, np.where(linked, low[None], len(low)).min(1))
            new = np.minimum(new, new[order[new]])
            if (new == low).all():
                break
            low = new
        to_rows = linked.astype(np.int64) @ np.array(self.copies)
        labels = np.zeros((len(self.sets), forest.trees, forest.depth), ">u2")
        labels[some] = forest.signatures([self.sets[i] for i in some.tolist()]).reshape(len(some), forest.trees, -1)
        out = []
        for i in some.tolist():
            others = np.flatnonzero(linked[i])
            common = np.logical_and.accumulate(labels[others] == labels[i], axis=2).sum(2).max(1)  # longest prefix of each
            p = chance((both[i, others] / union[i, others])[:, None], forest.trees, forest.lengths)
            stand = np.where(common[:, None] >= forest.lengths, 1 / p, 0).sum(0)
            out.append((self.digests[i], len(others), int(to_rows[i]), self.digests[order[low[i]]], *stand.tolist(), *p.sum(0).tolist()))
        return out


class Forest:
    """The hash functions of `trees` labels of `depth` values."""

    def __init__(self, trees: int, depth: int) -> None:
        self.trees, self.depth, self.lengths = trees, depth, np.arange(1, depth + 1)
        self.factor, self.shift = randoms(trees * depth, 21) | np.uint64(1), randoms(trees * depth, 22)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        return minhash(sets, self.factor, self.shift)

    def estimate_columns(self) -> list[str]:
        return [f"{kind}{x}" for kind in ("stand", "meet") for x in self.lengths.tolist()]


def blocks_of(batches, key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with one key, of batches that are sorted by it; a run is at most some blocks long."""
    now, run = None, []
    for batch in batches:
        cols = [column(batch, n).to_pylist() for n in (*key, *columns)]
        for row in zip(*cols, strict=True):
            if row[: len(key)] != now:
                if run:
                    yield now, run
                now, run = row[: len(key)], []
            run.append(row[len(key) :])
    if run:
        yield now, run


def verify(units: DataFrame, threshold: float, forest: Forest) -> DataFrame:
    """(c, digest, links, row_links, low, stand1, ..., meet1, ...) of units (c, x, y, side, digest, copies, shingles)."""
    names = ["c", "digest", "links", "row_links", "low", *forest.estimate_columns()]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[pa.float64()] * (2 * forest.depth)]

    def run(batches):
        ready = []
        for key, rows in blocks_of(batches, ("c", "x", "y"), ("side", "digest", "copies", "shingles")):
            unit, seen = Unit(), set()
            for side, digest, copies, raw in rows:
                if digest not in seen:
                    seen.add(digest)
                    unit.add(digest, side, copies, np.frombuffer(raw, np.uint64))
            ready += [(key[0], *x) for x in unit.rows(threshold, forest)]
            if len(ready) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)

    dealt = units.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y")
    return dealt.mapInArrow(run, "c binary, digest binary, links long, row_links long, low binary" + "".join(f", {e} double" for e in forest.estimate_columns()))


def row_key(i: Column, k: Column) -> Column:
    """One column for an id and the hash of its text, null included."""
    return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(k, F.lit("-")))


def among_candidates(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(key, t) of rows (i, k, t) that may be those of members: all of these, once each, and few others. A filter of one
    bit for each hash value, a broadcast of at most 2^20 words, keeps texts without candidates out of the shuffle."""
    bits = min(FILTER_MOST, 1 << max(10, (FILTER_EACH * n).bit_length()))
    slot = F.xxhash64("key").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = members.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.bit_or(bit).alias("mask"))
    keyed = texts.select(row_key(F.col("i"), F.col("k")).alias("key"), "t").withColumn("slot", slot).withColumn("word", F.expr("shiftright(slot, 6)"))
    some = keyed.join(F.broadcast(words), "word").where(F.col("mask").bitwiseAND(bit) != 0)
    return some.groupBy("key").agg(F.first("t").alias("t"))


def with_shingles(texts: DataFrame, members: DataFrame, n: int, size: int) -> DataFrame:
    """(c, size, digest, copies, shingles) of members (c, size, digest, copies, key)."""
    found = among_candidates(texts, members, n).join(members, "key").select("c", "size", "digest", "copies", "t")

    def sets(batches):
        for batch, own in shingle_sets(batches, "t", size):
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("c", "size", "digest", "copies")] + [pa.array([x.tobytes() for x in own], pa.binary())], names=["c", "size", "digest", "copies", "shingles"])

    return found.mapInArrow(sets, "c binary, size long, digest binary, copies long, shingles binary")


def dealt_out(groups: DataFrame, parts: str = "nb") -> DataFrame:
    """A row of each group for each of its blocks, so that a join with its members is dealt over (c, block)."""
    return groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))


def bands_of(own: DataFrame, threshold: float) -> DataFrame:
    """(c, nb, block, digest, copies, band) of the sets of large groups: distance to the group's centre, in steps that
    are a tenth of the threshold's distance."""
    step = (1 - threshold) / BANDS

    def centre(batches):
        names, kinds = ["c", "nb", "centre"], [pa.binary(), pa.int32(), pa.binary()]
        for (c,), rows in blocks_of(batches, ("c",), ("nb", "shingles")):
            values, n = np.unique(np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((c, rows[0][0], values[2 * n > len(rows)].tobytes()), kinds, strict=True)], names=names)

    def measure(batches):
        for batch in batches:
            out = []
            for raw, middle in zip(column(batch, "shingles").to_pylist(), column(batch, "centre").to_pylist(), strict=True):
                x, y = np.frombuffer(raw, np.uint64), np.frombuffer(middle or b"", np.uint64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = int((y[at] == x).sum()) if len(y) else 0
                out.append(int((1 - both / (len(x) + len(y) - both)) / step))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("c", "nb", "block", "digest", "copies")] + [pa.array(out, pa.int64())], names=["c", "nb", "block", "digest", "copies", "band"])

    centres = own.where("block = 0").repartition("c").sortWithinPartitions("c").select("c", "nb", "shingles").mapInArrow(centre, "c binary, nb int, centre binary")
    joined = own.join(dealt_out(centres).drop("nb"), ["c", "block"], "left")
    return cut(joined.mapInArrow(measure, "c binary, nb int, block int, digest binary, copies long, band long"))


def large_groups(own: DataFrame, threshold: float, forest: Forest, block: int) -> DataFrame:
    """As `verify`, of the sets (c, size, digest, copies, shingles) of groups of more than a block: what the distances to
    the centre settle, and units for the rest."""
    own = cut(own.withColumn("nb", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.hash("digest"), F.col("nb"))))
    bands = bands_of(own, threshold)
    counts = bands.groupBy("c", "nb", "band").agg(F.count("*").alias("m"), F.sum("copies").alias("rows"), F.min("digest").alias("least"))
    # at most a row for each band of a group, carried in an array
    table_ = cut(counts.withColumn("sub", F.ceil(F.col("m") / block)).groupBy("c", "nb").agg(F.array_sort(F.collect_list(F.struct("band", "m", "rows", "least", "sub"))).alias("bands")))
    placed = cut(bands.join(dealt_out(table_).drop("nb"), ["c", "block"]))
    sure = F.filter("bands", lambda b: b.band + F.col("band") <= BANDS - 2)
    total = lambda f: F.aggregate("sure", F.lit(0).cast("long"), lambda a, b: a + f(b))
    self_ = (2 * F.col("band") <= BANDS - 2).cast("long")
    lowest = F.get("bands", F.lit(0))
    close = placed.withColumn("sure", sure).select("c", "digest", (total(lambda b: b.m) - self_).alias("links"), (total(lambda b: b.rows) - self_ * F.col("copies")).alias("row_links"), F.when(F.size("sure") > 0, lowest["least"]).otherwise(F.col("digest")).alias("low"), "band", "sure").where("links > 0")
    # a pair that the centre settles has about the similarity of independent edits
    step = (1 - threshold) / BANDS
    alike = lambda a, b: F.greatest(F.lit(threshold), 1 - (a + b + 1) * F.lit(step))
    met = lambda s, d: 1 - F.pow(1 - F.pow(s, F.lit(float(d))), F.lit(float(forest.trees)))
    number = lambda b: b.m - F.when(b.band == F.col("band"), 1).otherwise(0)
    weigh = lambda d, f: F.aggregate("sure", F.lit(0.0), lambda a, b: a + f(number(b), met(alike(b.band, F.col("band")), d)))
    values = [weigh(d, f) for f in (lambda n, p: n / p, lambda n, p: n * p) for d in forest.lengths.tolist()]
    settled = close.select("c", "digest", "links", "row_links", "low", *(v.alias(e) for v, e in zip(values, forest.estimate_columns(), strict=True)))
    open_ = F.filter("bands", lambda b: (b.band + F.col("band") > BANDS - 2) & (F.abs(b.band - F.col("band")) <= BANDS + 1))  # a band more than the bound, for rounding
    width = 1 << 32
    key = lambda band, sub: band * F.lit(width) + sub
    other = placed.withColumn("near", F.explode(open_)).where("near.m > 1 or near.band <> band")
    own_sub = F.element_at(F.filter("bands", lambda b: b.band == F.col("band")), 1)["sub"]
    other = other.withColumn("side", key(F.col("band"), F.pmod(F.xxhash64("digest"), own_sub)))
    other = other.select("c", "digest", "side", "near", F.explode(F.sequence(F.lit(0).cast("long"), F.col("near.sub") - 1)).alias("sub")).withColumn("other", key(F.col("near.band"), F.col("sub")))
    pairs = other.select("c", "digest", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
    units = pairs.join(own.select("c", "digest", "copies", "shingles"), ["c", "digest"])
    return verify(units.select("c", "x", "y", "side", "digest", "copies", "shingles"), threshold, forest).unionByName(settled)


def candidates(chain: DataFrame, depth: int) -> DataFrame:
    """(digest, c, size): sets joined by chains of prefixes of `depth` values."""
    groups = connected_components(chain.where(F.col("lcp") >= depth)).withColumnRenamed("v", "digest")
    return cut(groups.join(groups.groupBy("c").agg(F.count("*").alias("size")), "c").select("digest", "c", "size"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, depths: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): (i, k, digest, n) of each row, k being a hash of its text; and (digest, class, rep, copies, links,
    row_links) of each set, class being the set's class and rep a (i, k) of the set. `depths`, if given, gets the prefix
    lengths used, each with the share of the estimated links that was found."""
    least, forest = shortest(threshold, trees, depth, recall), Forest(trees, depth)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).withColumn("k", F.md5("t"))
    rows = cut(signatures(texts.select("i", "k", "t"), size, forest))
    known = rows.where("digest is not null")
    first = F.struct(F.col("i").isNull().alias("nil"), "i", "k")
    # equal sets have one signature, so any will do: a row leaves each task for a set, however many copies it has
    reps = cut(known.groupBy("digest").agg(F.min(first).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))
    chain = cut(trie_links(reps.select("digest", "sig"), trees, depth, least).groupBy("a", "b").agg(F.max("lcp").alias("lcp")))
    groups = verified = None
    d = depth
    while True:
        before, groups = groups, candidates(chain, d)
        fresh = groups
        if before is not None:
            same = groups.select("c", "size").distinct().join(before.select("c", "size").distinct(), ["c", "size"]).select("c")
            fresh, verified = groups.join(same, "c", "left_anti"), verified.join(same, "c", "left_semi")
        members = cut(fresh.join(reps.drop("sig"), "digest").select("c", "size", "digest", "copies", row_key(F.col("rep.i"), F.col("rep.k")).alias("key")))
        n, most = members.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
        small, large = members.where(F.col("size") <= block), members.where(F.col("size") > block)
        zero = F.lit(0).cast("long")
        new = verify(with_shingles(texts, small, n, size).select("c", zero.alias("x"), zero.alias("y"), zero.alias("side"), "digest", "copies", "shingles"), threshold, forest)
        if most > block:
            new = new.unionByName(large_groups(with_shingles(texts, large, n, size), threshold, forest, block))
        verified = cut(new if verified is None else verified.unionByName(new))
        sums = verified.agg(F.sum("links").alias("links"), *(F.sum(e).alias(e) for e in forest.estimate_columns())).first()
        seen = sums["links"]
        share = seen / max(seen, sums[f"stand{d}"]) if seen else 0.0
        if depths is not None:
            depths.append((d, share))
        if d == least or share >= recall:
            break
        d = next((x for x in range(d - 1, least, -1) if seen and sums[f"meet{x}"] >= recall * seen), least)
    linked = verified.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("row_links").alias("row_links"))
    classes = connected_components(verified.select(F.col("digest").alias("a"), F.col("low").alias("b")))
    sets_ = reps.drop("sig").join(linked, "digest", "left").join(classes.withColumnsRenamed({"v": "digest", "c": "class"}), "digest", "left")
    return rows, sets_.select("digest", F.coalesce("class", "digest").alias("class"), "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("row_links", F.lit(0)).alias("row_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, n_links, n_shingles) of every row."""
    rows, sets = similar(docs, id_col, text_col, **options)
    least = sets.groupBy("class").agg(F.min("rep").alias("least"))
    of_set = sets.join(least, "class").select(F.col("digest").alias("d"), F.col("least.i").alias("class_id"), (F.col("row_links") + F.col("copies") - 1).alias("n_links"))
    return rows.join(of_set, F.col("digest") == F.col("d"), "left").select(F.col("i").alias(id_col), F.when(F.col("d").isNull(), F.col("i")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_shingles"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: five-word shingles, similarity 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the least id, and every text without words."""
    plain = positional(docs)
    i, t = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows, sets = similar(plain, i, t)
    best = sets.groupBy("class").agg(F.min("rep").alias("rep")).select(row_key(F.col("rep.i"), F.col("rep.k")).alias("key"), F.lit(True).alias("one"))
    bare = rows.where("digest is null").select(row_key(F.col("i"), F.col("k")).alias("key")).distinct().withColumn("one", F.lit(False))
    # one join of whole rows by one key; of repeated rows with words one stays, found in the join's own partitions
    kept = plain.withColumn("key", row_key(F.col(i), F.md5(t))).join(best.union(bare), "key")
    kept = kept.withColumn("nth", F.when(F.col("one"), -1).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates(["key", "nth"]).select(plain.columns).toDF(*docs.columns)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 5 * k >= 4 * (a.n + b.n - k)),
reach(r, o) AS (SELECT x, x FROM (SELECT DISTINCT x FROM l) UNION SELECT reach.r, l.y FROM reach JOIN l ON l.x = reach.o),
c AS (SELECT reach.r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.o GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(m, 0) AS BIGINT) AS n_links, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN (SELECT x AS r, count(*) AS m FROM l GROUP BY 1) USING (r)
"""
