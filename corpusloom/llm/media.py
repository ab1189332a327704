"""Media columns: ISO base media containers (nested boxes) written and indexed without decoding payloads.

`mux` stores byte payloads losslessly as 8-bit samples of one audio track; `index_media` walks the nested boxes of any
container, decodes the sample tables of every track and the runs of its movie fragments, and returns for each track codec,
duration and the byte ranges of samples and of keyframes. It needs no codec: only box headers and sample tables are read,
payload bytes are just addressed. The columns beside `tracks` are those of the first track that has samples.

Keyframes are one range each. Samples of one size that are all keyframes (as in plain audio, a byte or two each) are one
range for each run of bytes instead, so an index never outgrows its media; their number is then `n_keys`.

Defined results: null text is empty text; an empty payload is padded to one whole sample block; a null or broken
container yields a feature `broken:<reason>` and no ranges; equal texts give equal containers, repeated rows give
repeated results; an empty table gives an empty result; columns that are not named in a call are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, small_batches, table

#: Bytes of padding block, of one chunk of samples, and samples between two sync samples.
BLOCK, CHUNK, SYNC, RATE = 576, 576 * 64, 576 * 16, 8000
#: Boxes that hold other boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, rate: int = RATE, chunk: int = CHUNK, sync: int = SYNC) -> bytes:
    """One `raw ` track of unsigned 8-bit mono samples, a byte each; every `sync` samples one is listed in `stss`."""
    n = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-n // chunk)
    last = n - (chunks - 1) * chunk if chunks else 0
    runs = ([(1, chunk)] if chunks > 1 else []) + ([(chunks, last)] if chunks and (last != chunk or chunks == 1) else [])
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    first = len(ftyp) + 16  # media data come first, so chunk offsets do not depend on the size of moov
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    keys = np.arange(1, n + 1, sync, dtype=">u4")
    offsets = (first + np.arange(chunks, dtype=np.int64) * chunk).astype(">u8")
    stbl = box(
        b"stbl",
        full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
        full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
        full(b"stsz", 0, 0, struct.pack(">II", 1, n)),
        full(b"co64", 0, 0, struct.pack(">I", chunks), offsets.tobytes()),
    )
    minf = box(b"minf", full(b"smhd", 0, 0, bytes(4)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
    mdia = box(
        b"mdia",
        full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, rate, n, 0x55C4, 0)),
        full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"sound\0"),
        minf,
    )
    tkhd = full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, bytes(8))
    mvhd = full(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, rate, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + n) + payload
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """(path, start of the body, end, start of the box) of every box, outer boxes first, each with 32- or 64-bit or
    open-ended size."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("short size")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("box " + kind.decode("latin-1") + " leaves its parent")
        yield (*path, kind), at + head, at + size, at
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def numbers(data: memoryview, start: int, end: int, kind: str, count: int) -> np.ndarray:
    """`count` big-endian numbers of a table, which must lie inside its box."""
    width = np.dtype(kind).itemsize
    if start + width * count > end:
        raise ValueError("table leaves its box")
    return np.frombuffer(data, kind, count, start).astype(np.int64)


@dataclass
class Run:
    """Samples of a fragment that lie one after another; `sizes` is one number where all are equal, `sync` where all or
    none but the first are keyframes."""

    start: int
    count: int
    sizes: np.ndarray | int
    sync: np.ndarray | bool
    first: bool  # whether the first sample is a keyframe
    duration: int

    def stop(self) -> int:
        return self.start + (self.count * self.sizes if isinstance(self.sizes, int) else int(self.sizes.sum()))

    def keys(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Starts and stops of keyframes, and their number."""
        if isinstance(self.sizes, int) and isinstance(self.sync, bool):
            if self.sync and self.first:
                some = np.array([self.start] if self.count else [], np.int64)
                return some, some + self.count * self.sizes, self.count
            if not self.sync:
                some = np.array([self.start] if self.first and self.count else [], np.int64)
                return some, some + self.sizes, len(some)
        sizes = np.full(self.count, self.sizes, np.int64) if isinstance(self.sizes, int) else self.sizes
        sync = np.full(self.count, self.sync, bool) if isinstance(self.sync, bool) else self.sync.copy()
        sync[:1] = self.first
        ends = self.start + np.cumsum(sizes)
        return (ends - sizes)[sync], ends[sync], int(sync.sum())


class Track:
    """What the sample tables of one track say."""

    def __init__(self) -> None:
        self.handler, self.codec, self.timescale, self.duration = "", "", 0, 0
        self.constant, self.samples = 0, 0
        self.sizes = self.offsets = self.keys = None
        self.id, self.defaults, self.base = 0, (0, 0, 0), 0
        self.next: int | None = None  # where a run without an offset of its own starts
        self.fragments: list[Run] = []
        self.runs = np.zeros((0, 3), np.int64)

    def ends(self) -> np.ndarray | None:
        """Bytes of all samples up to each one; None where all have one size."""
        return None if self.sizes is None else np.concatenate([[0], np.cumsum(self.sizes)])

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset of every chunk that has samples, and the samples before each and in total."""
        offsets = np.zeros(0, np.int64) if self.offsets is None else self.offsets
        if not self.samples:
            return offsets[:0], np.zeros(1, np.int64)
        if not len(self.runs) or not len(offsets):
            raise ValueError("samples without chunks")
        first = np.append(self.runs[:, 0], len(offsets) + 1)
        if first[0] != 1 or (np.diff(first) <= 0).any() or first[-2] > len(offsets):
            raise ValueError("chunk runs out of order")
        before = np.concatenate([[0], np.cumsum(np.repeat(self.runs[:, 1], np.diff(first)))])
        if before[-1] < self.samples:
            raise ValueError("samples beyond the last chunk")
        n = int(np.searchsorted(before, self.samples, "left"))
        return offsets[:n], np.append(before[:n], self.samples)

    def bytes_before(self, samples: np.ndarray, ends: np.ndarray | None) -> np.ndarray:
        return samples * self.constant if ends is None else ends[samples]


def tracks(data: bytes | memoryview) -> list[Track]:
    """Every track of the container, from its box tree alone."""
    view, found, extends = memoryview(data), [], {}
    moof, current = 0, None
    for path, a, b, at in walk(view, 0, len(view)):
        kind = path[-1]
        if kind == b"trak":
            found.append(Track())
        elif kind == b"trex":
            extends[struct.unpack_from(">I", view, a + 4)[0]] = struct.unpack_from(">III", view, a + 12)
        elif kind == b"moof":
            moof, current = at, None
        elif kind == b"tfhd":
            current = fragment_header(view, a, found, extends, moof)
        elif kind == b"trun" and current is not None:
            add_fragment(view, a, b, current)
        if not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"tkhd":
            t.id = struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]
        elif kind == b"mdhd":
            if view[a] == 1:
                t.timescale, t.duration = struct.unpack_from(">IQ", view, a + 20)
            else:
                t.timescale, t.duration = struct.unpack_from(">II", view, a + 12)
        elif kind == b"hdlr":
            t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stsz":
            t.constant, t.samples = struct.unpack_from(">II", view, a + 4)
            t.sizes = None if t.constant else numbers(view, a + 12, b, ">u4", t.samples)
        elif kind == b"stz2":
            width, t.samples = view[a + 7], struct.unpack_from(">I", view, a + 8)[0]
            if width == 4:
                raw = numbers(view, a + 12, b, "u1", (t.samples + 1) // 2)
                t.sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[: t.samples]
            else:
                t.sizes = numbers(view, a + 12, b, f">u{width // 8}", t.samples)
        elif kind == b"stsc":
            n = struct.unpack_from(">I", view, a + 4)[0]
            t.runs = numbers(view, a + 8, b, ">u4", 3 * n).reshape(n, 3)
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", view, a + 4)[0]
            t.offsets = numbers(view, a + 8, b, ">u4" if kind == b"stco" else ">u8", n)
        elif kind == b"stss":
            n = struct.unpack_from(">I", view, a + 4)[0]
            t.keys = numbers(view, a + 8, b, ">u4", n) - 1
    return found


def fragment_header(view: memoryview, a: int, found: list[Track], extends: dict, moof: int) -> Track | None:
    """The track that a `tfhd` names, with its defaults (duration, size, flags) and base offset for the runs after it."""
    flags, number = struct.unpack_from(">II", view, a)
    t = next((t for t in found if t.id == number), None)
    if t is None:
        return None
    values, at = list(extends.get(number, (0, 0, 0))), a + 8
    t.base = t.next = moof
    if flags & 1:
        t.base, at = struct.unpack_from(">Q", view, at)[0], at + 8
        t.next = t.base
    at += 4 * bool(flags & 2)
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            values[k], at = struct.unpack_from(">I", view, at)[0], at + 4
    t.defaults = tuple(values)
    return t


def add_fragment(view: memoryview, a: int, b: int, t: Track) -> None:
    """A `trun`: samples that lie one after another from an offset, or from the end of the run before in its fragment."""
    flags, n = struct.unpack_from(">II", view, a)
    at, start = a + 8, t.next
    if flags & 1:
        start, at = t.base + struct.unpack_from(">i", view, at)[0], at + 4
    first = None
    if flags & 4:
        first, at = struct.unpack_from(">I", view, at)[0], at + 4
    fields = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
    table = numbers(view, at, b, ">u4", n * len(fields)).reshape(n, len(fields)) if fields else None
    column_of = lambda k: table[:, fields.index(k)] if k in fields else t.defaults[k]
    durations, marks = column_of(0), column_of(2)
    sync = (marks & 0x10000) == 0
    leading = n > 0 and (bool(sync if isinstance(marks, int) else sync[0]) if first is None else (first & 0x10000) == 0)
    run = Run(start, n, column_of(1), sync, leading, int(n * durations if isinstance(durations, int) else durations.sum()))
    t.next = run.stop()
    t.fragments.append(run)


def table_ranges(t: Track) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Byte runs, starts and stops of keyframes, and their number, of the samples in a track's tables."""
    none = np.zeros(0, np.int64)
    if not t.samples:
        return [], none, none, 0
    offsets, before = t.chunks()
    sums = t.ends()
    if sums is not None and len(sums) != t.samples + 1:
        raise ValueError("sizes are missing")
    total = t.bytes_before(before, sums)
    stops = offsets + np.diff(total)
    new = np.flatnonzero(np.append(True, offsets[1:] != stops[:-1]))
    runs = list(zip(offsets[new].tolist(), stops[np.append(new[1:], len(stops)) - 1].tolist(), strict=True))
    if t.keys is None and sums is None:
        return runs, np.array([a for a, _ in runs]), np.array([b for _, b in runs]), t.samples
    keys = np.arange(t.samples) if t.keys is None else t.keys[(t.keys >= 0) & (t.keys < t.samples)]
    chunk = np.searchsorted(before, keys, "right") - 1
    starts = offsets[chunk] + t.bytes_before(keys, sums) - total[chunk]
    return runs, starts, starts + t.bytes_before(keys + 1, sums) - t.bytes_before(keys, sums), len(keys)


def describe_track(t: Track, length: int) -> dict:
    """A track's samples: those of its tables, then those of its fragments in file order."""
    runs, starts, stops, n_keys = table_ranges(t)
    parts = [f.keys() for f in t.fragments]
    runs = runs + [(f.start, f.stop()) for f in t.fragments]
    if any(a < 0 or b > length for a, b in runs):
        raise ValueError("samples leave the file")
    starts, stops = (np.concatenate([x, *(p[k] for p in parts)]).astype(np.int64) for k, x in enumerate((starts, stops)))
    n_keys += sum(p[2] for p in parts)
    samples, duration = t.samples + sum(f.count for f in t.fragments), t.duration + sum(f.duration for f in t.fragments)
    marks = zlib.crc32(np.stack([starts, stops], 1).astype("<i8").tobytes())
    feature = f"{t.handler}/{t.codec.strip()};rate={t.timescale};duration={duration};samples={samples};keys={n_keys};keymap={marks:08x}"
    return {"track_id": t.id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": duration, "n_samples": samples, "n_keys": n_keys, "key_starts": starts.tolist(), "key_ends": stops.tolist(), "runs": runs, "feature": feature}


def describe(data: bytes | None) -> dict:
    """Codec, duration and byte ranges of every track with samples (`tracks`), those of the first again beside it; payload
    bytes are not looked at. One broken track breaks the container."""
    out = {"track_id": None, "handler": None, "codec": None, "timescale": None, "duration": None, "n_samples": 0, "n_keys": 0, "key_starts": [], "key_ends": [], "runs": [], "feature": "broken:null", "tracks": []}
    if data is None:
        return out
    try:
        found = [describe_track(t, len(data)) for t in tracks(data) if t.samples or t.fragments]
    except (ValueError, struct.error, OverflowError) as error:
        return out | {"feature": f"broken:{error}"}
    if not found:
        return out | {"feature": "broken:no samples"}
    return out | found[0] | {"tracks": found}


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each whole text, padded with bytes 255 to whole blocks, as a container."""

    def run(batches):
        for batch in batches:
            payloads = [(x or "").encode() for x in column(batch, "t").to_pylist()]
            media = [mux(p + b"\xff" * (-len(p) % BLOCK if p else BLOCK)) for p in payloads]
            yield pa.RecordBatch.from_arrays([column(batch, "i"), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], names=["i", "n_bytes", "media"])

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    small_batches(docs.sparkSession)
    return source.mapInArrow(run, f"i {source.schema['i'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("i", id_col)


def index_media(df: DataFrame, media_col: str = "media", keep: tuple = ()) -> DataFrame:
    """The `keep` columns, and of each container's first track: codec, timescale, duration, samples, keyframe byte ranges,
    feature, plus length and SHA-256 of container and payload, the payload being read by the byte ranges of the samples;
    `tracks` has a struct for every track."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for batch in batches:
            rows = []
            for data in column(batch, media_col).to_pylist():
                x, h, n, crc, tail = describe(data), hashlib.sha256(), 0, 0, b""
                for a, b in x["runs"]:
                    h.update(memoryview(data)[a:b])
                    tail = (tail + data[max(a, b - 32) : b])[-32:]
                    n += b - a
                crc = zlib.crc32(tail)
                rows.append((x["codec"], x["timescale"], x["duration"], x["n_samples"], x["key_starts"], x["key_ends"], x["feature"], n, h.hexdigest(), crc, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), [{k: t[k] for k in IN_TRACK} | {"run_starts": [a for a, _ in t["runs"]], "run_ends": [b for _, b in t["runs"]]} for t in x["tracks"]]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 13
            many = pa.list_(pa.int64())
            track = pa.struct([(k, many if t.startswith("array") else pa.int64() if t == "bigint" else pa.string()) for k, t in (x.split(":") for x in TRACK.split(","))])
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), many, many, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(track)]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keep, *NAMES])

    small_batches(df.sparkSession)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{n} {t}" for n, t in zip(NAMES, TYPES, strict=True)])
    return df.select(*keep, media_col).mapInArrow(run, schema)


NAMES = ["codec", "timescale", "duration", "n_samples", "key_starts", "key_ends", "feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tracks"]
#: Fields of a track's struct; all but the last two are of one name with those of `describe`.
TRACK = "track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,n_keys:bigint,key_starts:array<bigint>,key_ends:array<bigint>,run_starts:array<bigint>,run_ends:array<bigint>"
IN_TRACK = [x.split(":")[0] for x in TRACK.split(",")][:-2]
TYPES = ["string", "long", "long", "long", "array<long>", "array<long>", "string", "long", "string", "long", "long", "string", f"array<struct<{TRACK}>>"]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored in a container and indexed again from the stored bytes."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    out = index_media(stored, "media", ("doc_id", "n_bytes"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", F.size("key_starts").cast("long").alias("n_keyframes"))
