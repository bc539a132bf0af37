"""Matroska media columns: write 8-bit audio, parse packets, clusters, lacing and cues.

``mux`` stores bytes as unsigned 8-bit PCM samples of one audio track; ``parse``
reads any Matroska bytes (variable-length EBML elements, known and unknown
sizes, SimpleBlock and BlockGroup, all four lacings) into packets with track,
timestamp and byte range. ``packet_table`` and ``cue_table`` do so for a column.

Defined results: a null media value has no packets; bytes that end inside an
element give the packets before it; a null text is muxed as the empty text; the
empty text still has one padded packet. Repeated rows stay repeated.
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
from pyspark.sql import functions as F

from .common import stage

UNIT = 64  # payloads are padded to a multiple of this
RATE = 8000  # samples a second, one byte each
FRAME = 1024
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOCTYPE, SCALE, DURATION, TITLE = 0x4282, 0x2AD7B1, 0x4489, 0x7BA9
TRACK, NUMBER, UID, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, PER_FRAME = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACE, EBML}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(x: int, body: bytes) -> bytes:
    return _id(x) + _size(len(body)) + body


def _uint(x: int, value: int) -> bytes:
    return _element(x, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    """Lacing header and frames; kind 1 Xiph, 2 fixed size, 3 EBML."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            head += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def mux(data: bytes) -> bytes:
    """``pad(data)`` as one PCM track; the unpadded length is kept in the title."""
    payload = pad(data)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = _element(EBML, _element(DOCTYPE, b"matroska"))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(TITLE, b"bytes=%d" % len(data)))
    audio = _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(PER_FRAME, FRAME * 1_000_000_000 // RATE) + audio))
    body, cues, ms = info + tracks, b"", FRAME * 1000 // RATE
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), per_cluster):
        blocks = _uint(TIME, c * ms)
        for b in range(c, min(c + per_cluster, len(frames)), FRAMES_PER_BLOCK):
            own = frames[b : min(b + FRAMES_PER_BLOCK, c + per_cluster)]
            kind = 0 if len(own) == 1 else 1 + b // FRAMES_PER_BLOCK % 3
            if kind == 2 and len(own[-1]) != len(own[0]):
                kind = 3
            blocks += _element(SIMPLE, b"\x81" + struct.pack(">hB", (b - c) * ms, 0x80 | kind << 1) + (_laced(own, kind) if kind else own[0]))
        cues += _element(CUE, _uint(CUE_TIME, c * ms) + _element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, len(body))))
        body += _element(CLUSTER, blocks)
    return head + _element(SEGMENT, body + _element(CUES, cues))


@dataclass
class Parsed:
    packets: list[tuple[int, float, int, int, int]] = field(default_factory=list)  # track, ms, offset, size, cluster
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # ms, track, offset of the cluster
    title: str = ""
    duration: float = 0.0
    clusters: int = 0


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """Value and width of the variable-length integer at ``at``; -1 for the unknown size."""
    if at >= len(data) or not data[at]:
        raise EOFError
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise EOFError
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value ^= 1 << 7 * width
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, width


def _frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, width = _vint(data, at)
            size = value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
            at += width
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def parse(data: bytes | None) -> Parsed:
    """Packets, cues and header of Matroska bytes, as far as whole elements reach."""
    out, scale, per_frame = Parsed(), 1_000_000, {}
    segment = time = 0
    track = cue_ms = cue_track = 0
    todo = [(0, len(data or b""))]
    try:
        while todo:
            at, stop = todo.pop()
            if at >= stop:
                continue
            x, width = _vint(data, at, keep=True)
            size, more = _vint(data, at + width)
            begin = at + width + more
            end = stop if size < 0 else begin + size
            if x in MASTERS:
                if size >= 0:
                    todo.append((end, stop))
                todo.append((begin, end))
                if x == SEGMENT:
                    segment = begin
                elif x == CLUSTER:
                    out.clusters, time = out.clusters + 1, 0
                continue
            if end > len(data):
                raise EOFError
            todo.append((end, stop))
            body = data[begin:end]
            if x in (SIMPLE, BLOCK):
                number, width = _vint(data, begin)
                offset, flags = struct.unpack_from(">hB", data, begin + width)
                sizes, place = _frame_sizes(data, begin + width + 3, end, flags >> 1 & 3)
                ms = (time + offset) * scale / 1e6
                for i, n in enumerate(sizes):
                    out.packets.append((number, ms + i * per_frame.get(number, 0) / 1e6, place, n, out.clusters))
                    place += n
            elif x == TIME:
                time = int.from_bytes(body, "big")
            elif x == SCALE:
                scale = int.from_bytes(body, "big")
            elif x == DURATION:
                out.duration = struct.unpack(">d" if len(body) == 8 else ">f", body)[0] * scale / 1e6
            elif x == TITLE:
                out.title = body.decode("utf-8", "replace")
            elif x == NUMBER:
                track = int.from_bytes(body, "big")
            elif x == PER_FRAME:
                per_frame[track] = int.from_bytes(body, "big")
            elif x == CUE_TIME:
                cue_ms = int.from_bytes(body, "big")
            elif x == CUE_TRACK:
                cue_track = int.from_bytes(body, "big")
            elif x == CUE_CLUSTER:
                out.cues.append((cue_ms, cue_track, segment + int.from_bytes(body, "big")))
    except (EOFError, IndexError, struct.error):
        pass
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text muxed, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [mux((t or "").encode("utf-8")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet: key, cluster, track, timestamp_ms, byte_start, byte_end (end exclusive)."""

    def run(batches):
        for b in batches:
            rows = [(k, c, t, ms, at, at + n) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, ms, at, n, c in parse(m).packets]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([(key, pa.int64()), ("cluster", pa.int32()), ("track", pa.int32()), ("timestamp_ms", pa.float64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, cluster int, track int, timestamp_ms double, byte_start long, byte_end long")


def cue_table(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per cue: key, time_ms, track, byte_start of its cluster."""

    def run(batches):
        for b in batches:
            rows = [(k, *c) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in parse(m).cues]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([(key, pa.int64()), ("time_ms", pa.int64()), ("track", pa.int32()), ("byte_start", pa.int64())])
    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, time_ms long, track int, byte_start long")


def _digest(media: bytes) -> tuple:
    found = parse(media)
    payload = b"".join(media[at : at + n] for _, _, at, n, _ in found.packets)
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128.0
    feature = f"clusters={found.clusters};packets={len(found.packets)};cues={len(found.cues)};duration_ms={found.duration:.3f};mean={samples.mean():.6f};rms={np.sqrt((samples**2).mean()):.6f}"
    return int(found.title.partition("=")[2]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op1_media(docs: DataFrame) -> DataFrame:
    """Store every text as Matroska in the shared folder, read the stored bytes back and digest them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            rows = [_digest(m.as_py()) for m in b.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    stored = stage(store_texts(docs), "media")
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
