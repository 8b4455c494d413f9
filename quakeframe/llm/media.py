"""Media columns: ISO base media containers, built and read without decoding a payload.

``store_media`` packs bytes as unsigned 8-bit mono sound ('raw '): an access unit is 64 samples,
a chunk holds up to 256 units, every 16th unit is a sync sample. ``probe_media`` walks the nested
boxes of any such file, decodes the sample tables and returns codec, duration and the byte ranges
of keyframes; the payload itself is only sliced.

Defined results: a null text is the empty text, whose payload is 64 zero bytes; a null media
column, or one that isn't a well-formed container, has a null codec and the reason in ``error``.
Rows are independent: repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

UNIT, CHUNK_UNITS, SYNC_EVERY, RATE = 64, 256, 16, 8000
#: Boxes in each other, at most; the deepest that is read here is the sixth.
DEEPEST = 32
#: Boxes whose body is a list of boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)
    return struct.pack(">I4s", size, kind) + b"".join(body)


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT - len(data), -len(data) % UNIT))


def store_media(data: bytes) -> bytes:
    """A container whose payload is ``padded(data)``."""
    payload = padded(data)
    units = len(payload) // UNIT
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    offsets = first + np.arange(0, units, CHUNK_UNITS, dtype=np.int64) * UNIT
    last = units - (len(offsets) - 1) * CHUNK_UNITS
    runs = [(1, min(CHUNK_UNITS, units), 1)] + ([(len(offsets), last, 1)] if len(offsets) > 1 and last != CHUNK_UNITS else [])
    wide = offsets[-1] >= 1 << 32
    sync = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, units, UNIT)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, units)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
    )
    length = units * UNIT
    dref = full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", dref), stbl)
    mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1)
    mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
    mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(buf: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the body) of each box, parents before their children. What is still to be read lies on a stack, so
    nesting takes no Python frames; more than ``DEEPEST`` boxes in each other are an error."""
    to_read: list[tuple[tuple[bytes, ...], int, int]] = [((), start, end)]
    while to_read:
        path, start, end = to_read.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", buf, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", buf, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or start + size < body:
            raise ValueError("a box is longer than what holds it")
        yield (*path, kind), body, start + size
        to_read.append((path, start + size, end))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise ValueError("boxes are nested too deep")
            to_read.append(((*path, kind), body, start + size))


def table_of(buf: memoryview, at: int, end: int, count: int, dtype: str, columns: int = 1) -> np.ndarray:
    need = count * columns * np.dtype(dtype).itemsize
    if at + need > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(buf, dtype, count * columns, at).astype(np.int64).reshape(count, columns)


def tracks(buf: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """For each track the boxes that matter, by kind."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, at, end in walk(buf, 0, len(buf)):
        if path[-1] == b"trak":
            found.append({})
        elif path[:2] == (b"moov", b"trak") and found:
            found[-1].setdefault(path[-1], (at, end))
    return found


def sample_table(buf: memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, timescale, duration, and offset, size and sync of each sample of a track."""

    def part(kind: bytes) -> tuple[int, int]:
        if kind not in boxes:
            raise ValueError(f"there is no {kind.decode('latin-1')} box")
        return boxes[kind]

    def number(at: int, end: int, code: str = ">I") -> int:
        if at + struct.calcsize(code) > end:
            raise ValueError("a box is cut off")
        return struct.unpack_from(code, buf, at)[0]

    at, end = part(b"mdhd")
    long = number(at, end, ">B") == 1
    scale, duration = (number(at + 20, end), number(at + 24, end, ">Q")) if long else (number(at + 12, end), number(at + 16, end))
    at, end = part(b"stsd")
    codec = bytes(buf[at + 12 : at + 16]).decode("latin-1") if number(at + 4, end) else ""
    at, end = part(b"stsz")
    fixed, n = number(at + 4, end), number(at + 8, end)
    if fixed * n > len(buf):
        raise ValueError("the samples are larger than the file")
    sizes = np.full(n, fixed, np.int64) if fixed else table_of(buf, at + 12, end, n, ">u4")[:, 0]
    wide = b"co64" in boxes
    at, end = part(b"co64" if wide else b"stco")
    chunks = table_of(buf, at + 8, end, number(at + 4, end), ">u8" if wide else ">u4")[:, 0]
    at, end = part(b"stsc")
    runs = table_of(buf, at + 8, end, number(at + 4, end), ">u4", 3)
    length = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (length < 0).any() or length.sum() != len(chunks) or (runs[:, 1] < 1).any() or (runs[:, 1] * length).sum() != n:
        raise ValueError("the chunks don't hold the samples")
    per_chunk = np.repeat(runs[:, 1], length)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = before + np.repeat(chunks - (before[first] if n else 0), per_chunk)
    sync = np.arange(n)
    if b"stss" in boxes:
        at, end = boxes[b"stss"]
        sync = table_of(buf, at + 8, end, number(at + 4, end), ">u4")[:, 0] - 1
    at, end = part(b"stts")
    times = table_of(buf, at + 8, end, number(at + 4, end), ">u4", 2)
    if times[:, 0].sum() != n:
        raise ValueError("the samples don't have a duration each")
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(buf) or len(sync) and not 0 <= sync.min() <= sync.max() < n):
        raise ValueError("a sample lies outside the file")
    ends = first + per_chunk - 1
    spans = list(zip(chunks.tolist(), (offsets[ends] + sizes[ends] - chunks).tolist(), strict=True)) if n else []
    return {
        "codec": codec, "timescale": scale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "n_samples": n,
        "key_offset": offsets[sync], "key_length": sizes[sync], "chunks": spans,
    }


def probe_media(media: bytes) -> dict:
    """``sample_table`` of the first track; the file must have one."""
    view = memoryview(media)
    found = tracks(view)
    if not found:
        raise ValueError("there is no track")
    return sample_table(view, found[0])


def payload(media: bytes, chunks: list[tuple[int, int]]) -> bytes:
    return b"".join(media[at : at + n] for at, n in chunks)
