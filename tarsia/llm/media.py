"""Media columns: ISO base media containers in a binary column.

``store`` wraps bytes as a video track of uncompressed 8 x 8 frames with one byte per pixel; ``probe`` walks the
nested boxes of any such container, decodes the sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and
returns codec, duration and the byte ranges of keyframes; ``samples`` gives every sample's place. No payload is
decoded: readers take bytes by range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, renamed, restored

FRAME, SIDE, TIMESCALE, CHUNK = 64, 8, 25, 1024  # bytes and pixels of a frame, frames a second, frames of a chunk
CODEC = b"raw "
#: Boxes that hold only other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of a frame."""
    return raw + bytes(-len(raw) % FRAME if raw else FRAME)


def store(payload: bytes) -> bytes:
    """A container for payload, whose length is a multiple of a frame. Every frame is a keyframe."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(k, c) for k, c in ((1, CHUNK if chunks > 1 else 0), (chunks, n % CHUNK)) if c]
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    mdat_head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    base = len(head) + len(mdat_head)
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", k, c, 1) for k, c in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64", struct.pack(">I", chunks), np.arange(base, base + n * FRAME, CHUNK * FRAME).astype(">u8").tobytes()),
    )
    data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    media = box(b"minf", full(b"vmhd", bytes(8), flags=1), data, table)
    times = struct.pack(">IIII", 0, 0, TIMESCALE, n)
    track = box(
        b"trak",
        full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3),
        box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), media),
    )
    movie = box(b"moov", full(b"mvhd", times, struct.pack(">ih", 1 << 16, 1 << 8), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)
    return b"".join((head, mdat_head, payload, movie))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the content of the boxes in data[start:end]. A box that reaches over its end raises."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)


def tracks(data: memoryview) -> list[Track]:
    found: list[Track] = []

    open_ = [walk(data, 0, len(data))]  # boxes that are being walked, outermost first: nesting may be of any depth
    while open_:
        kind, a, b = next(open_[-1], (b"", 0, 0))
        if not kind:
            open_.pop()
            continue
        if kind == b"trak":
            found.append(Track())
        if kind in CONTAINERS:
            open_.append(walk(data, a, b))
        elif found and kind == b"mdhd":
            at, fmt = (a + 20, ">IQ") if data[a] == 1 else (a + 12, ">II")
            found[-1].timescale, found[-1].duration = struct.unpack_from(fmt, data, at)
        elif found and kind == b"hdlr":
            found[-1].handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif found and kind == b"stsd" and b - a >= 16:
            found[-1].codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif found and kind[:3] in (b"stt", b"sts", b"stz", b"stc", b"co6"):
            found[-1].tables[kind] = (a, b)
    return found


def numbers(data: memoryview, at: int, count: int, dtype: str) -> np.ndarray:
    return np.frombuffer(data, dtype, count, at).astype("i8")


def samples(data: memoryview, track: Track) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset, size and keyframe flag of each sample of a track, from its sample tables."""
    t = track.tables
    count = lambda kind, skip=4: struct.unpack_from(">I", data, t[kind][0] + skip)[0]
    if b"stsz" in t:
        same, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
        if same * n > len(data):
            raise ValueError(f"{n} samples of {same} bytes in {len(data)}")
        size = np.full(n, same, "i8") if same else numbers(data, t[b"stsz"][0] + 12, n, ">u4")
    elif b"stz2" in t:
        bits, n = data[t[b"stz2"][0] + 7], count(b"stz2", 8)
        raw = numbers(data, t[b"stz2"][0] + 12, -(-n * bits // 8) if bits < 16 else n, ">u2" if bits == 16 else "u1")
        size = np.stack([raw >> 4, raw & 15], 1).ravel()[:n] if bits == 4 else raw
    else:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, bool)
    kind, dtype = (b"co64", ">u8") if b"co64" in t else (b"stco", ">u4")
    chunk = numbers(data, t[kind][0] + 8, count(kind), dtype) if kind in t else np.empty(0, "i8")
    run = numbers(data, t[b"stsc"][0] + 8, 3 * count(b"stsc"), ">u4").reshape(-1, 3) if b"stsc" in t else np.empty((0, 3), "i8")
    per_chunk = np.repeat(run[:, 1], np.diff(np.append(run[:, 0], len(chunk) + 1))) if len(run) else np.zeros(len(chunk), "i8")
    if per_chunk.sum() != n:
        raise ValueError(f"chunks hold {per_chunk.sum()} samples, sizes are given for {n}")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(size) - size
    offset = before + np.repeat(chunk - (before[first] if n else 0), per_chunk)
    key = np.ones(n, bool)
    if b"stss" in t:
        key[:] = False
        key[numbers(data, t[b"stss"][0] + 8, count(b"stss"), ">u4") - 1] = True
    return offset, size, key


def ranges(offset: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the stretches that samples cover, in order; samples that adjoin are one."""
    if not len(offset):
        return []
    new = np.flatnonzero(np.append(True, offset[1:] != (offset + size)[:-1]))
    end = (offset + size)[np.append(new[1:] - 1, len(offset) - 1)]
    return list(zip(offset[new].tolist(), (end - offset[new]).tolist()))


KEYFRAMES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
PROBE = [("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", KEYFRAMES), ("error", pa.string())]
PROBE_DDL = "codec string, duration double, n_samples long, keyframes array<struct<start:long,length:long>>, error string"


def describe(data: bytes | None) -> tuple:
    """codec, seconds, samples and keyframe ranges of the first video track, else the first track; error for
    bytes that aren't a readable container. Null stays null."""
    if data is None:
        return None, None, None, None, None
    view = memoryview(data)
    try:
        found = tracks(view)
        if not found:
            raise ValueError("no track")
        track = next((t for t in found if t.handler == "vide"), found[0])
        offset, size, key = samples(view, track)
        return track.codec, track.duration / track.timescale if track.timescale else None, len(size), ranges(offset[key], size[key]), None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, None, str(e)


def with_media(docs: DataFrame) -> DataFrame:
    """Adds media, the container of the text's UTF-8 bytes (null as empty), and n_bytes, their number. Other
    columns stay; equal texts give equal media."""
    frame, own = renamed(docs, ["media", "n_bytes"])
    text, names = own["text"], list(own.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                raw = [(t.as_py() or "").encode() for t in b.column(text)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([store(padded(r)) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=[*names, "media", "n_bytes"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kind}, media binary, n_bytes long").select(*restored(own), "media", "n_bytes")


def probe(frame: DataFrame, column: str = "media") -> DataFrame:
    """Replaces a binary column by codec, duration, n_samples, keyframes and error."""
    media, own = renamed(frame, [n for n, _ in PROBE if n != column])
    names = [n for c, n in own.items() if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(m.as_py()) for m in b.column(own[column])]
            more = [pa.array([r[k] if n != "keyframes" or r[k] is None else [{"start": s, "length": x} for s, x in r[k]] for r in rows], t) for k, (n, t) in enumerate(PROBE)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], names=[*names, *dict(PROBE)])

    kind = "".join(f"`{n}` {media.schema[n].dataType.simpleString()}, " for n in names)
    out = media.select(*names, own[column]).mapInArrow(run, f"{kind}{PROBE_DDL}")
    return out.select(*restored({c: n for c, n in own.items() if c != column}), *dict(PROBE))


DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def digests(frame: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the column media: digests of the samples' bytes, taken by
    range, of the container, and its features as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media"):
                m = m.as_py()
                view = memoryview(m)
                (track,) = tracks(view)
                offset, size, key = samples(view, track)
                sha, tail = hashlib.sha256(), b""
                for s, n in ranges(offset, size):
                    sha.update(view[s : s + n])
                    tail = bytes(view[max(s, s + n - 64) : s + n])
                keys = ",".join(f"{s}+{n}" for s, n in ranges(offset[key], size[key]))
                feature = f"codec={track.codec.strip()};seconds={track.duration / track.timescale:.2f};frames={len(size)};keyframes={int(key.sum())};ranges={keys}"
                rows.append((int(size.sum()), sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), DIGEST))], names=["doc_id", "n_bytes", *dict(DIGEST)])

    return frame.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return digests(with_media(docs).select("doc_id", "n_bytes", "media"))


QUERIES = {"op9_media_columns": op9_media_columns}
SQL: dict[str, str] = {}
