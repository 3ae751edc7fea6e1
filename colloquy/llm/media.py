"""Media columns: bytes stored as ISO base media files, and what their boxes say.

``wrap`` stores a payload of whole 192-byte frames as an uncompressed 8-bit grey
video (16 x 12 samples, one byte each: lossless).  ``tracks`` walks the nested boxes of
any such file, decodes the sample tables of its tracks (stts, stsc, stsz/stz2, stco/co64, stss), its
fragments (trex, tfhd, trun) and edit lists, and returns codec, duration and the byte range of every
keyframe; it reads no payload.  Counts are believed only as far as their box and the file can hold them.
``payload`` follows the same tables to read the stored samples back.

A file is a row of its own; rows never meet, so the plan is one narrow pass.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as T

FRAME = 192
WIDTH, HEIGHT, RATE = 16, 12, 25
#: Frames in a chunk of the file, and from one keyframe to the next.
CHUNK, KEY = 64, 8
#: Boxes that a path names at most; deeper ones are walked under its last.
DEPTH = 64
_CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes) -> bytes:
    """The payload (a positive multiple of FRAME bytes) as a file."""
    n = len(payload) // FRAME
    if n == 0 or len(payload) % FRAME:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    large = len(payload) + 16 >= 1 << 32
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    offsets = len(head) + len(data) + np.arange(0, n, CHUNK, dtype=np.int64) * FRAME
    whole, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK)] if whole else []) + ([(whole + 1, rest)] if rest else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H16xHHII4xH32sHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 1, b"", 8 | 32, -1))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">3I", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(range(1, n + 1, KEY))), np.arange(1, n + 1, KEY).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">3I", a, b, 1) for a, b in runs]),
        _full(b"stsz", struct.pack(">2I", FRAME, n)),
        _full(b"co64" if large else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if large else ">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, n, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">2I", WIDTH << 16, HEIGHT << 16), flags=3), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return b"".join((head, data, payload, movie))


def boxes(data: bytes, low: int = 0, high: int | None = None):
    """(kinds of the box and the boxes around it, their starts, start of body, end) of every box, outer before inner.
    A box that claims more bytes than there are ends the walk of its level; boxes may be nested in any depth."""
    levels = [((), (), low, len(data) if high is None else high)]
    while levels:
        path, starts, at, end_of = levels.pop()
        if at + 8 > end_of:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end_of:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        end = end_of if size == 0 else at + size
        if end > end_of or end < body:
            continue
        levels.append((path, starts, end, end_of))
        inner = ((*path, kind), (*starts, at)) if len(path) < DEPTH else (path, starts)
        yield (*path, kind), (*starts, at), body, end
        if kind in _CONTAINERS:
            levels.append((*inner, body, end))


@dataclass
class Track:
    codec: str
    kind: str
    timescale: int
    duration: int
    offset: np.ndarray
    size: np.ndarray
    key: np.ndarray
    shown: float | None = None

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


class _Box:
    """The body of a full box; reading beyond its end is a ValueError."""

    def __init__(self, data: bytes, body: int, end: int):
        self.data, self.at, self.end = data, body, end
        (self.version, self.flags) = divmod(self.number(4), 1 << 24)

    def number(self, width: int) -> int:
        if self.at + width > self.end:
            raise ValueError("a box is too short")
        self.at += width
        return int.from_bytes(self.data[self.at - width : self.at], "big")

    def table(self, n: int, columns: int = 1, kind: str = ">u4") -> np.ndarray:
        """n rows of numbers; there are at most as many as the box has bytes for."""
        width = np.dtype(kind).itemsize * columns
        if n > (self.end - self.at) // width:
            raise ValueError("a table is longer than its box")
        out = np.frombuffer(self.data, kind, n * columns, self.at).astype(np.int64)
        self.at += n * width
        return out.reshape(n, columns) if columns > 1 else out


def _sizes(box: dict, most: int) -> np.ndarray:
    """The size of every sample; a size for all is believed only as far as the file (``most`` bytes) can hold them."""
    if b"stsz" in box:
        b = box[b"stsz"]
        same, n = b.number(4), b.number(4)
        if not same:
            return b.table(n)
        if n * same > most:
            raise ValueError("more samples than bytes")
        return np.full(n, same, np.int64)
    b = box[b"stz2"]
    bits, n = b.number(4) & 255, b.number(4)
    if bits == 4:
        pairs = b.table((n + 1) // 2, kind=">u1")
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
    return b.table(n, kind={8: ">u1", 16: ">u2"}[bits])


def _listed(box: dict, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, keyframes and duration by the sample tables of a track."""
    size = _sizes(box, most)
    wide = b"co64" in box
    b = box[b"co64" if wide else b"stco"]
    chunks = b.table(b.number(4), kind=">u8" if wide else ">u4")
    b = box[b"stsc"]
    runs = b.table(b.number(4), 3)
    n = len(size)
    if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise ValueError("chunks without samples")
    per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1] if n else np.zeros(0, np.int64)
    upto = np.minimum(np.cumsum(np.minimum(per, n)), n)
    if n and (not len(upto) or upto[-1] < n):
        raise ValueError("samples without a chunk")
    chunk = np.searchsorted(upto, np.arange(n), "right")
    before = np.concatenate(([0], np.cumsum(size)))
    offset = chunks[chunk] + before[:n] - before[np.concatenate(([0], upto))[chunk]] if n else size
    b = box[b"stts"]
    times = b.table(b.number(4), 2)
    key = np.arange(n)
    if b"stss" in box:
        b = box[b"stss"]
        key = b.table(b.number(4)) - 1
        if ((key < 0) | (key >= n)).any():
            raise ValueError("a keyframe that is no sample")
    return offset, size, key, int(sum(a * d for a, d in times.tolist()))


def _fragment(head: _Box, runs: list[_Box], moof: int, before: int | None, preset: tuple[int, int, int], most: int):
    """The (offset, size, is keyframe, duration) of the samples of each of a fragment's runs, and where its data end.

    Without an offset of its own its data begin at the moof if it says so (default-base-is-moof), else where those of
    the fragment before it in the moof end (``before``; the moof for the first one, None if that is not known)."""
    f = head.flags
    base = head.number(8) if f & 1 else moof if f & 0x20000 else before
    if base is None:
        raise ValueError("where the data begin is not known")
    if f & 2:
        head.number(4)
    duration, size, flags = (head.number(4) if f & bit else old for bit, old in zip((8, 16, 32), preset, strict=True))
    at, out = base, []
    for b in runs:
        n = b.number(4)
        if b.flags & 1:
            at = base + (b.number(4) ^ 1 << 31) - (1 << 31)
        first = b.number(4) if b.flags & 4 else None
        given = [k for k in range(4) if b.flags & 256 << k]
        if not given and n * size > most or n > most:
            raise ValueError("more samples than bytes")
        rows = b.table(n, len(given)).reshape(n, len(given)) if given else np.zeros((n, 0), np.int64)
        column = lambda k, same: rows[:, given.index(k)] if k in given else np.full(n, same, np.int64)  # noqa: B023, E731
        sizes, marks = column(1, size), column(2, flags).copy()
        if first is not None and n:
            marks[0] = first
        sums = np.concatenate(([0], np.cumsum(sizes)))
        out.append((at + sums[:-1], sizes, marks >> 16 & 1 == 0, int(column(0, duration).sum())))
        at += int(sums[-1])
    return out, at


def _fragments(data: bytes, moofs: dict, presets: dict) -> dict[int, list | None]:
    """Runs by track, from the fragments of each moof one after the other; None for a track that has a broken one."""
    out: dict[int, list | None] = {}
    ends: dict[int, int | None] = {}
    for (moof, _), part in moofs.items():
        before, ends[moof], number = ends.get(moof, moof), None, None
        try:
            (low, high), *_ = part.get(b"tfhd") or [(0, 0)]
            head = _Box(data, low, high)
            number = head.number(4)
            runs, ends[moof] = _fragment(head, [_Box(data, *r) for r in part.get(b"trun", ())], moof, before, presets.get(number, (0, 0, 0)), len(data))
        except (ValueError, OverflowError):
            out[number] = None
            continue
        if out.setdefault(number, []) is not None:
            out[number].extend(runs)
    return out


def _track(data: bytes, box: dict[bytes, tuple[int, int]], scale: int, fragments: dict) -> Track:
    full = {k: _Box(data, *box[k]) for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss", b"tkhd", b"elst") if k in box}
    b = full[b"mdhd"]
    w = 8 if b.version == 1 else 4
    b.at += 2 * w
    timescale, duration = b.number(4), b.number(w)
    b = full[b"hdlr"]
    b.at += 4
    kind = b.number(4).to_bytes(4, "big").decode("latin-1")
    b = full[b"stsd"]
    b.at += 8
    codec = b.number(4).to_bytes(4, "big").decode("latin-1")
    offset, size, key, listed = _listed(full, len(data))
    b = full[b"tkhd"]
    b.at += 16 if b.version == 1 else 8
    number = b.number(4)
    parts = fragments.get(number, ())
    if parts is None:
        raise ValueError("a fragment that is not whole")
    if parts:
        n = len(offset)
        more = np.concatenate([p[2] for p in parts])
        offset, size = (np.concatenate([x, *[p[i] for p in parts]]) for i, x in enumerate((offset, size)))
        key = np.concatenate([key, np.flatnonzero(more) + n])
        listed += sum(p[3] for p in parts)
    if len(offset) and (offset.min() < 0 or (offset + size).max() > len(data)):
        raise ValueError("samples outside of the file")
    shown = None
    if b"elst" in full and scale:
        b = full[b"elst"]
        w = 8 if b.version == 1 else 4
        edits = b.table(b.number(4), 2 * w + 4, ">u1").reshape(-1, 2 * w + 4)
        shown = sum(int.from_bytes(bytes(e[:w].astype(np.uint8)), "big") for e in edits) / scale
    return Track(codec, kind, timescale, listed or duration, offset, size, key, shown)


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file, in its order, with the samples of its sample tables and of its fragments; a track whose
    tables are not whole, or say more than the file holds, is left out.  Payloads are not read."""
    found: dict[int, dict[bytes, tuple[int, int]]] = {}
    scale, presets, moofs = 0, {}, {}
    for path, starts, body, end in boxes(data):
        try:
            if b"trak" in path[:-1]:
                found.setdefault(starts[path.index(b"trak")], {}).setdefault(path[-1], (body, end))
            elif path[-1] == b"mvhd":
                b = _Box(data, body, end)
                b.at += 16 if b.version == 1 else 8
                scale = b.number(4)
            elif path[-1] == b"trex":
                b = _Box(data, body, end)
                number, _, *preset = (b.number(4) for _ in range(5))
                presets[number] = tuple(preset)
            elif path[-1] in (b"tfhd", b"trun") and b"traf" in path:
                moofs.setdefault((starts[0], starts[path.index(b"traf")]), {}).setdefault(path[-1], []).append((body, end))
        except ValueError:
            continue
    fragments = _fragments(data, moofs, presets)
    out = []
    for box in found.values():
        with suppress(ValueError, KeyError, OverflowError):
            out.append(_track(data, box, scale, fragments))
    return out


def probe(data: bytes) -> Track | None:
    """The first whole track of a file; None where there is none."""
    return next(iter(tracks(data)), None)


def payload(data: bytes, track: Track) -> bytes:
    """The samples of a track, read back from where its tables say."""
    if not len(track.size):
        return b""
    end = track.offset + track.size
    edges = np.flatnonzero(np.concatenate(([True], track.offset[1:] != end[:-1], [True])))
    return b"".join(data[track.offset[a] : end[b - 1]] for a, b in zip(edges[:-1], edges[1:], strict=True))


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def _wrapped(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.diff(offsets)), pa.array([wrap(pad(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_binary()).cast(pa.binary())],
                names=[*rows.schema.names, "n_bytes", "media"],
            )


def with_media(docs: DataFrame) -> DataFrame:
    """docs with ``n_bytes`` of each text and ``media``, the padded text as a file.  A null text counts as empty."""
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "media")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(_wrapped, f"{fields}, n_bytes long, media binary")


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACK = pa.struct([("codec", pa.string()), ("kind", pa.string()), ("duration", pa.float64()), ("shown", pa.float64()), ("samples", pa.int64()), ("keyframes", _RANGES)])
_TRACK_SQL = "struct<codec: string, kind: string, duration: double, shown: double, samples: long, keyframes: array<struct<offset: long, length: long>>>"


def _said(t: Track) -> dict:
    ranges = [{"offset": o, "length": n} for o, n in zip(t.offset[t.key].tolist(), t.size[t.key].tolist(), strict=True)]
    return {"codec": t.codec, "kind": t.kind, "duration": t.seconds, "shown": t.shown, "samples": len(t.size), "keyframes": ranges}


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """media with ``tracks`` (codec, kind, duration in seconds, seconds shown by the edit list, samples and keyframes as
    offset and length) and ``codec``, ``duration`` and ``keyframes`` of the first one; all null for null and for bytes that are no such file.

    Columns of these names are replaced, repeated rows each described."""
    new = ("tracks", "codec", "duration", "keyframes")
    names = [c for c in media.columns if c.lower() not in new]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*names).schema)

    def run(batches):
        for b in batches:
            found = [[_said(t) for t in tracks(x)] if x is not None else [] for x in b.column(column).to_pylist()]
            first = [f[0] if f else {} for f in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f or None for f in found], pa.list_(_TRACK)), *[pa.array([f.get(k) for f in first], t) for k, t in (("codec", pa.string()), ("duration", pa.float64()), ("keyframes", _RANGES))]],
                names=[*b.schema.names, *new],
            )

    return media.select(*names).mapInArrow(run, f"{fields}, tracks array<{_TRACK_SQL}>, codec string, duration double, keyframes array<struct<offset: long, length: long>>")


def _digests(batches):
    for batch in batches:
        for rows, data, offsets in T.pieces(batch):
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                file = wrap(pad(data[a:b].tobytes()))
                track = probe(file)
                back = payload(file, track)
                ranges = np.stack([track.offset[track.key], track.size[track.key]], 1)
                feature = f"codec={track.codec.strip()};seconds={track.seconds:.2f};samples={len(track.size)};keyframes={','.join(f'{o}+{n}' for o, n in ranges.tolist())}"
                out.append((int(b - a), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def report(docs: DataFrame) -> DataFrame:
    """Sizes and digests of each text's file and of what is read back from it, and its feature: codec, seconds, samples, keyframe ranges.

    A row for each row of docs(doc_id, text, ..), repeated ones too, and none for an empty table; further columns go.  A null text is
    an empty one, a null id stays null; equal texts have equal values, whatever their ids."""
    return docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
