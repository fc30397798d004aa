"""Media columns of ISO media containers.

Containers are walked box by box; the sample tables give every sample's place, and codec, duration and the byte
ranges of keyframes are read from them. Payload bytes are copied, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Bytes of a sample, samples of a chunk, samples from one keyframe to the next, samples a second times sample size.
UNIT, CHUNK, SYNC, RATE = 192, 32, 10, 8000
#: Boxes that hold boxes (fixed values).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of a sample."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_container(payload: bytes) -> bytes:
    """A file of one audio track of unsigned 8-bit samples; payload is a positive multiple of UNIT bytes."""
    n = len(payload) // UNIT
    chunks, last = -(-n // CHUNK), (n - 1) % CHUNK + 1
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != CHUNK)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    length = n * UNIT
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def head(first: int) -> bytes:
        places = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * UNIT) + np.uint64(first)
        wide = first + length >= 1 << 32
        offsets = _full(b"co64", struct.pack(">I", chunks), places.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), places.astype(">u4").tobytes())
        sync = np.arange(1, n + 1, SYNC, dtype=">u4")
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, UNIT)), _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, k, 1) for a, k in runs]), _full(b"stsz", struct.pack(">II", UNIT, n)), offsets,
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length & 0xFFFFFFFF, 0x55C4, 0)) if length < 1 << 32 else _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, length), struct.pack(">IH", 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41") + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = len(head(0)) + 8
    if len(payload) + 8 >= 1 << 32:
        size = len(head(1 << 32)) + 16
    return head(size) + _box(b"mdat", payload)


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the body) of every box, nested ones after the box that holds them."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        at = stop


def tracks(data: bytes) -> list[dict]:
    """Of each track that has a sample table: codec, timescale, duration, ticks, and its samples' starts, sizes and
    keyframe numbers. ValueError names what is missing or does not fit."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, z in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path:
            found[-1].setdefault(path[-1], (a, z))
    out = [_track(data, at) for at in found if b"stsd" in at]
    if not out:
        raise ValueError("no track with a sample table")
    return out


def _track(data: bytes, at: dict[bytes, tuple[int, int]]) -> dict:
    def body(*kinds: bytes) -> tuple[bytes, int, int]:
        for kind in kinds:
            if kind in at:
                return kind, *at[kind]
        raise ValueError(f"box {kinds[0]!r} is missing")

    def table(place: int, end: int, n: int, kind: str = ">u4") -> np.ndarray:
        if n * np.dtype(kind).itemsize > end - place:
            raise ValueError(f"a table of {n} entries at {place} does not fit")
        return np.frombuffer(data, kind, n, place).astype(np.int64)

    def counted(kind: bytes, width: int = 1) -> np.ndarray:
        _, a, z = body(kind)
        n = int(table(a + 4, z, 1)[0])
        return table(a + 8, z, n * width).reshape(-1, width)

    _, a, z = body(b"mdhd")
    if z - a < (32 if data[a : a + 1] == b"\1" else 20):
        raise ValueError("box b'mdhd' does not fit")
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    _, a, z = body(b"stsd")
    if z - a < 16:
        raise ValueError("box b'stsd' does not fit")
    codec = data[a + 12 : a + 16].decode("latin-1").strip()
    kind, a, z = body(b"stsz", b"stz2")
    bits, n = table(a + 4, z, 2).tolist()
    if kind == b"stsz":
        sizes = np.full(n, bits, np.int64) if bits else table(a + 12, z, n)
    elif bits == 4:
        sizes = np.stack([(half := table(a + 12, z, -(-n // 2), ">u1")) >> 4, half & 15], axis=1).ravel()[:n]
    elif bits in (8, 16):
        sizes = table(a + 12, z, n, f">u{bits // 8}")
    else:
        raise ValueError(f"sample sizes of {bits} bits")
    kind, a, z = body(b"co64", b"stco")
    chunks = int(table(a + 4, z, 1)[0])
    places = table(a + 8, z, chunks, ">u8" if kind == b"co64" else ">u4")
    runs, times = counted(b"stsc", 3), counted(b"stts", 2)
    per = np.repeat(runs[:, 1], np.maximum(0, np.diff(np.append(runs[:, 0], chunks + 1))))
    if len(per) != chunks or per.sum() != n:
        raise ValueError(f"chunks hold {int(per.sum())} samples, sizes are of {n}")
    first = np.cumsum(per) - per
    before = np.append(np.cumsum(sizes) - sizes, sizes.sum())
    starts = np.repeat(places - before[first], per) + before[:-1]
    if n and (starts + sizes).max() > len(data):
        raise ValueError("samples end after the file")
    sync = counted(b"stss")[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError("keyframes are not samples")
    return {"codec": codec, "timescale": timescale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "starts": starts, "sizes": sizes, "sync": sync}


def probe(data: bytes) -> dict:
    """tracks() of a file, the first."""
    return tracks(data)[0]


def payload(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The samples' bytes in order; neighbouring samples are read together."""
    if not len(starts):
        return b""
    cuts = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    a, z = np.append(0, cuts), np.append(cuts, len(starts)) - 1
    return b"".join(data[starts[i] : starts[j] + sizes[j]] for i, j in zip(a.tolist(), z.tolist(), strict=True))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_columns
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(n - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], pa.array([len(r) for r in raws], pa.int64()), pa.array([write_container(pad(r)) for r in raws], pa.binary())], names=[*b.schema.names[: n - 1], "n_bytes", "media"])


def _schema(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def encode(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The keep columns, n_bytes and media: each text's UTF-8 bytes, padded with spaces, in a container of its own.

    Null and empty texts become 192 spaces. Equal texts have equal media. Other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(_encode, f"{_schema(docs, keep)}n_bytes long, media binary")


FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _ranges(m: dict) -> np.ndarray:
    return np.stack([m["starts"][m["sync"]], (m["starts"] + m["sizes"])[m["sync"]]], axis=1)


def _described(data: bytes) -> dict:
    """A container's columns, by its first track; tracks has all."""
    all_tracks = tracks(data)
    m = all_tracks[0]
    ranges = _ranges(m)
    ends = f"{ranges[0][0]}-{ranges[0][1]};{ranges[-1][0]}-{ranges[-1][1]}" if len(ranges) else "-;-"
    body = payload(data, m["starts"], m["sizes"])
    each = [{"codec": t["codec"], "seconds": t["duration"] / max(1, t["timescale"]), "n_samples": len(t["starts"]), "keyframes": [{"start": a, "end": z} for a, z in _ranges(t).tolist()]} for t in all_tracks]
    return {
        **each[0], "feature": f"{m['codec']};{m['timescale']};{m['duration']};{m['ticks']};{len(m['starts'])};{len(ranges)};{ends};{zlib.crc32(ranges.astype('>i8').tobytes()):08x}",
        "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "tracks": each, "error": None,
    }


_TRACK = [("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(FOUND))]
_KINDS = dict([*_TRACK, ("feature", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tracks", pa.list_(pa.struct(_TRACK))), ("error", pa.string())])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_columns
        rows = []
        for data in b.column(n - 1).to_pylist():
            try:
                rows.append({} if data is None else _described(data))
            except (ValueError, struct.error) as e:  # what is wrong with one file is told in its row
                rows.append({"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "error": str(e)})
        yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], *(pa.array([r.get(k) for r in rows], t) for k, t in _KINDS.items())], names=[*b.schema.names[: n - 1], *_KINDS])


def media_columns(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The keep columns with codec, seconds, n_samples, keyframes (byte ranges), feature and digests of each container's
    first track, and tracks, which describes all.

    Null media have null columns. A file that is empty, has no track, or whose boxes or tables do not fit has an error
    that says so, its size and digest, and nulls elsewhere. Fragments are not read: their samples are in no sample table.
    Repeated rows are read alike; no rows: no rows.
    """
    track = "codec string, seconds double, n_samples long, keyframes array<struct<start:bigint,end:bigint>>"
    kinds = f"{track}, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tracks array<struct<codec:string,seconds:double,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>, error string"
    return df.select(*keep, media).mapInArrow(_columns, f"{_schema(df, keep)}{kinds}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(encode(documents(spark, sf_dir), ["doc_id"]), ["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "keyframes")
