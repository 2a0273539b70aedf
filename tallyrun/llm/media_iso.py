"""ISO media containers: nested boxes and sample tables, read without decoding a payload.

Writing: a text's bytes become the frames of a raw RGB track (8 x 8 pixels, 192 bytes, 8-bit
samples), the size of a box's content decides nothing else, so equal texts give equal files.
Reading: boxes are walked at any depth with a stack, the sample tables (and the runs of movie fragments) give every
sample's place, and codec, duration and the byte ranges that open with a key frame are kept as columns. Tables are
checked against their box before they are read, and samples of one constant size are never listed, so memory stays
within a few times the bytes given, whatever these say.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, utf8

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_ms long, n_samples long, n_keyframes long, keyframe_ranges string"
FRAME = 192
#: boxes that hold boxes
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"])
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """The bytes are not a container that can be read."""


def pad_payload(raw: bytes, unit: int = FRAME) -> bytes:
    """Blanks up to a positive multiple of the unit."""
    return raw + b" " * ((-len(raw) % unit) if raw else unit)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_media(payload: bytes, timescale: int = 24, group: int = 16) -> bytes:
    """A file with one raw video track; every `group`-th frame is a key frame and each group is a chunk."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    chunks, last = divmod(n, group)
    runs = [(1, group)] if chunks else []
    if last:
        runs.append((chunks + 1, last))
    keys = range(1, n + 1, group)
    entry = struct.pack(">6xH16xHHIIIH32shH", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"\x03raw" + bytes(28), 24, 0xFFFF)

    def moov(at: int) -> bytes:
        places = [at + i * group * FRAME for i in range(len(keys))]
        wide = places[-1] >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, size, 1) for first, size in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(places)}{'Q' if wide else 'I'}", len(places), *places)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, n, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, timescale, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    front = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ", b"isom")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    at = len(front) + len(moov(0)) + head
    if at + len(payload) >= 1 << 32:  # wide offsets lengthen the tables
        at = len(front) + len(moov(1 << 32)) + head
    return front + moov(at) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, content start, content end) of the boxes in a stretch; size 0 reaches to the end, size 1 is 64 bits wide."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("a wide size is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, start + size
        start += size


@dataclass
class Samples:
    """Samples in chunks: `sizes` is one size of all or an array; `keys` are places (from 0) of key frames, None if all are."""

    sizes: int | np.ndarray
    chunks: np.ndarray
    counts: np.ndarray
    keys: np.ndarray | None

    def __post_init__(self):
        self.n = int(self.counts.sum())
        self.first = np.cumsum(self.counts) - self.counts
        self.before = None if isinstance(self.sizes, int) else np.concatenate([[0], np.cumsum(self.sizes)])
        largest = self.sizes * self.n if self.before is None else int(self.before[-1])
        if largest >= 1 << 62 or len(self.chunks) and int(self.chunks.max()) >= 1 << 62:
            raise MediaError("sizes or places are out of range")

    def upto(self, k: np.ndarray) -> np.ndarray:
        """Bytes of the samples before the k-th."""
        return k * self.sizes if self.before is None else self.before[k]

    def ranges(self, by_key: bool = True) -> list[tuple[int, int]]:
        """Byte ranges [from, to) of runs of adjacent samples, which also end before each key frame if not all are such."""
        on = np.flatnonzero(self.counts)
        if not len(on):
            return []
        first, places = self.first[on], self.chunks[on]
        ends = places + self.upto(first + self.counts[on]) - self.upto(first)
        opens = first[np.concatenate([[True], places[1:] != ends[:-1]])]
        if by_key and self.keys is not None:
            opens = np.union1d(opens, self.keys)
        closes = np.append(opens[1:], self.n) - 1

        def place(k: np.ndarray, more: int) -> np.ndarray:
            c = np.searchsorted(first, k, "right") - 1
            return places[c] + self.upto(k + more) - self.upto(first[c])

        return list(zip(place(opens, 0).tolist(), place(closes, 1).tolist(), strict=True))


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: int | np.ndarray | None = None
    n_sizes: int = 0
    ticks: int = 0
    chunk_runs: np.ndarray | None = None
    chunks: np.ndarray | None = None
    keys: np.ndarray | None = None
    fragments: list[Samples] = field(default_factory=list)

    def parts(self) -> list[Samples]:
        """The samples of the tables, then those of each fragment's runs."""
        chunks = np.zeros(0, np.int64) if self.chunks is None else self.chunks
        runs = np.zeros((0, 3), np.int64) if self.chunk_runs is None else self.chunk_runs
        counts = np.zeros(len(chunks), np.int64)
        if len(runs) and len(chunks):
            if runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
                raise MediaError("the runs of chunks are out of order")
            counts = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1]
        if int(counts.sum()) != self.n_sizes:
            raise MediaError("the sample tables disagree")
        keys = self.keys
        if keys is not None:
            keys = np.unique(keys) - 1
            if len(keys) and (keys[0] < 0 or keys[-1] >= self.n_sizes):
                raise MediaError("a key frame is no sample")
        own = [Samples(0 if self.sizes is None else self.sizes, chunks, counts, keys)] if self.n_sizes else []
        return own + self.fragments

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges [from, to) that open with a key frame and end before the next one, split where bytes are not adjacent.

        Where every sample is a key frame a range is a whole run of adjacent samples."""
        return [r for part in self.parts() for r in part.ranges()]


def read_media(data: bytes) -> list[Track]:
    """The tracks of a container. Payload boxes are passed over."""
    view = memoryview(data)
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}

    def take(code: str, at: int, end: int) -> tuple:
        if at + struct.calcsize(">" + code) > end:
            raise MediaError("a box is cut off")
        return struct.unpack_from(">" + code, view, at)

    def numbers(kind: str, at: int, end: int, n: int, columns: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize * columns
        if at + n * size > end:
            raise MediaError("a table is cut off")
        wide = np.frombuffer(view, kind, n * columns, at)
        if kind == ">u8" and n and int(wide.max()) >= 1 << 63:
            raise MediaError("sizes or places are out of range")
        out = wide.astype(np.int64)
        return out.reshape(n, columns) if columns > 1 else out

    def table(track: Track, kind: bytes, a: int, b: int) -> None:
        if kind == b"tkhd":
            (track.track_id,) = take("I", a + (20 if take("B", a, b)[0] else 12), b)
        elif kind == b"mdhd":
            track.timescale, track.duration = take("IQ", a + 20, b) if take("B", a, b)[0] else take("II", a + 12, b)
        elif kind == b"hdlr":
            track.handler = take("4s", a + 8, b)[0].decode("latin-1")
        elif kind == b"stsd":
            track.codec = ",".join(k.decode("latin-1") for k, _, _ in boxes(view, a + 8, b))
        elif kind == b"stsz":
            size, n = take("II", a + 4, b)
            track.sizes, track.n_sizes = (size if size else numbers(">u4", a + 12, b, n)), n
        elif kind == b"stz2":
            bits, n = take("BI", a + 7, b)
            if bits not in (4, 8, 16):
                raise MediaError("a sample size has an odd width")
            if bits == 4:
                halves = numbers("u1", a + 12, b, (n + 1) // 2)
                track.sizes = np.stack([halves >> 4, halves & 15], axis=1).ravel()[:n]
            else:
                track.sizes = numbers("u1" if bits == 8 else ">u2", a + 12, b, n)
            track.n_sizes = n
        elif kind == b"stts":
            rows = numbers(">u4", a + 8, b, take("I", a + 4, b)[0], 2)
            track.ticks = sum(n * d for n, d in rows.tolist())
        elif kind == b"stsc":
            track.chunk_runs = numbers(">u4", a + 8, b, take("I", a + 4, b)[0], 3)
        elif kind == b"stss":
            track.keys = numbers(">u4", a + 8, b, take("I", a + 4, b)[0])
        elif kind in (b"stco", b"co64"):
            track.chunks = numbers(">u4" if kind == b"stco" else ">u8", a + 8, b, take("I", a + 4, b)[0])

    def fragment(start: int, a: int, b: int, end: int) -> int:
        """The runs of one track in the fragment that starts at `start`; `end` is where the runs of the track before end."""
        track, base, size, duration, flags, at = None, start, 0, 0, 0, end
        for kind, x, y in boxes(view, a, b):
            if kind == b"tfhd":
                has, number = take("II", x, y)
                has &= 0xFFFFFF
                track = next((t for t in tracks if t.track_id == number), None)
                duration, size, flags = defaults.get(number, (0, 0, 0))
                x += 8
                if has & 1:
                    (base,), x = take("Q", x, y), x + 8
                elif not has & 0x20000:
                    base = end  # data follow those of the track before
                x += 4 * bool(has & 2)
                if has & 8:
                    (duration,), x = take("I", x, y), x + 4
                if has & 0x10:
                    (size,), x = take("I", x, y), x + 4
                if has & 0x20:
                    (flags,), x = take("I", x, y), x + 4
                at = base
            elif kind == b"trun" and track is not None:
                has, n = take("II", x, y)
                has &= 0xFFFFFF
                x += 8
                if has & 1:
                    at, x = base + take("i", x, y)[0], x + 4
                first_flags = None
                if has & 4:
                    (first_flags,), x = take("I", x, y), x + 4
                columns = [c for c in (0x100, 0x200, 0x400, 0x800) if has & c]
                rows = numbers(">u4", x, y, n, len(columns)).reshape(n, len(columns)) if columns else None
                of = {c: rows[:, i] for i, c in enumerate(columns)}
                if at < 0 or at >= 1 << 62:
                    raise MediaError("sizes or places are out of range")
                track.ticks += int(of[0x100].sum()) if 0x100 in of else n * duration
                keys = np.flatnonzero(of[0x400] & 0x10000 == 0) if 0x400 in of else None if not flags & 0x10000 else np.zeros(0, np.int64)
                if first_flags is not None and n and 0x400 not in of and (first_flags ^ flags) & 0x10000:
                    if keys is not None:
                        keys = np.zeros(1, np.int64)
                    elif n <= len(data):
                        keys = np.arange(1, n)
                    else:
                        raise MediaError("a run has more samples than bytes")
                run = Samples(of.get(0x200, size), np.array([at], np.int64), np.array([n], np.int64), keys)
                track.fragments.append(run)
                at += int(run.upto(np.int64(n)))
        return at

    try:
        # (place, end, track, kind, start of the box around) of what is still to be read, the next at the end
        stack = [(boxes(view, 0, len(data)), None, 0)]
        fragment_end = 0
        while stack:
            walk, track, start = stack[-1]
            found = next(walk, None)
            if found is None:
                stack.pop()
                continue
            kind, a, b = found
            if kind == b"trak":
                tracks.append(Track())
                stack.append((boxes(view, a, b), tracks[-1], a))
            elif kind == b"moof":
                fragment_end = _box_start(view, a)
                stack.append((boxes(view, a, b), None, fragment_end))
            elif kind == b"traf":
                fragment_end = fragment(start, a, b, fragment_end)
            elif kind in CONTAINERS:
                stack.append((boxes(view, a, b), track, start))
            elif kind == b"trex":
                number, _, *rest = take("5I", a + 4, b)
                defaults[number] = tuple(rest)
            elif track is not None:
                table(track, kind, a, b)
    except (struct.error, OverflowError) as e:
        raise MediaError(str(e)) from e
    return tracks


def _box_start(view: memoryview, content: int) -> int:
    """Where the box starts whose content starts here: its head has 8 bytes, or 16 if its size is 64 bits wide."""
    return content - 16 if content >= 16 and struct.unpack_from(">I", view, content - 16)[0] == 1 and bytes(view[content - 12 : content - 8]) == b"moof" else content - 8


def describe(data: bytes) -> dict:
    """Columns of a container: the first video track, else the first track."""
    tracks = read_media(data)
    if not tracks:
        raise MediaError("no track")
    track = next((t for t in tracks if t.handler == "vide"), tracks[0])
    parts = track.parts()
    ticks = track.ticks or track.duration
    ms = round(1000 * ticks / track.timescale) if track.timescale else None
    n, n_keys = sum(p.n for p in parts), sum(p.n if p.keys is None else len(p.keys) for p in parts)
    if max(n, ms or 0) >= 1 << 63:
        raise MediaError("sizes or places are out of range")
    return {"track": track, "codec": track.codec, "duration_ms": ms, "n_samples": n, "n_keyframes": n_keys, "ranges": track.key_ranges()}


def read_samples(data: bytes, track: Track) -> bytes:
    """The stored samples in order; neighbours are copied together."""
    view, out = memoryview(data), []
    for part in track.parts():
        for a, b in part.ranges(by_key=False):
            if b > len(data):
                raise MediaError("a sample lies outside the file")
            out.append(view[a:b])
    return b"".join(out)


def parse_media(files: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """Codec, duration and key-frame byte ranges of container files in a binary column.

    Null, empty or unreadable bytes give nulls and the reason in `error`; nothing is dropped and no file ends the task.
    Repeated rows each give a row, an empty table gives none, and only the two columns are read, so others may have any
    name. Ranges may lie beyond the bytes given, as where only a file's head was fetched.
    """

    def make():
        def work(batch):
            rows = []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    d = describe(data if data is not None else b"")
                    rows.append({"id": key, "codec": d["codec"], "duration_ms": d["duration_ms"], "n_samples": d["n_samples"], "n_keyframes": d["n_keyframes"], "keyframe_ranges": [{"from": a, "to": b} for a, b in d["ranges"]], "error": None})
                except MediaError as e:
                    rows.append({"id": key, "error": str(e)})
            kinds = pa.schema([("id", pa.int64()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframe_ranges", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

        return work

    schema = "id long, codec string, duration_ms long, n_samples long, n_keyframes long, keyframe_ranges array<struct<from:long,to:long>>, error string"
    return map_batches(files.select(files[id_col].cast("long").alias("id"), files[data_col].cast("binary").alias("data")), make, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a container, read it back through its tables, and give digests and media columns.

    A null text counts as empty and becomes one frame of blanks. Equal texts give equal values; repeated
    rows each give a row, an empty table none; only the id and the text are read, so others may have any name. A text of any
    length is one file. With `keep_media` the file itself is a column.
    """

    def make():
        def work(batch):
            rows, files = [], []
            for key, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                raw = raw or b""
                media = write_media(pad_payload(raw))
                d = describe(media)
                back = read_samples(media, d["track"])
                ranges = d["ranges"]
                feature = f"{d['codec']};{d['duration_ms']}ms;{d['n_samples']};{d['n_keyframes']};{ranges[0][0]}-{ranges[-1][1]}"
                spans = ",".join(f"{a}-{b}" for a, b in ranges)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, d["codec"], d["duration_ms"], d["n_samples"], d["n_keyframes"], spans))
                if keep_media:
                    files.append(media)
            names, kinds = zip(*(f.split(" ") for f in SCHEMA.split(", ")), strict=True)
            arrays = [pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(files, pa.binary())] if keep_media else [])], names=[*names, *(["media"] if keep_media else [])])

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA + (", media binary" if keep_media else ""))
