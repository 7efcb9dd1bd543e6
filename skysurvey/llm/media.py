"""Media columns in Matroska: payload bytes stored losslessly and read back through a packet table.

Method: an EBML writer puts a payload into a Matroska file (EBML header, Info, one raw
8-bit track, clusters of SimpleBlocks whose frames share a block by fixed-size or EBML
lacing, and cues); the reader parses variable-length element ids and sizes, clusters,
lacing and cues into a packet table (track, timestamp, byte offset, byte length, key
frame) and never relies on what the writer knew: times come from the file's timestamp
scale, and those of frames that share a block from the track's default duration or, for
raw samples, from the frames' sizes. Unknown-size segments and clusters, BlockGroups, whose
blocks are key frames unless they refer to others, and Xiph lacing, which this writer does
not produce, are read as well.

Defined results: null and empty text is one frame of padding; every payload is a
positive multiple of ``FRAME`` bytes, padded with byte 255, which UTF-8 never has, so
the text comes back whole; texts of any length are stored whole; equal texts give equal
files; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysurvey.llm.common import map_columns, text_input

#: Bytes of a frame, frames of a block and blocks of a cluster (whose times must fit 16 bits).
FRAME = 576
LACED = 8
BLOCKS = 48
#: A frame of 576 8-bit samples at 8000 samples a second lasts 72 ms; timestamps count ms.
FRAME_MS = 72

# Element ids of the Matroska format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING_FLAG, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x23E383, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}
_INSIDE = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}


class Packet(NamedTuple):
    """One frame: its track, time in ms, byte range in the file and whether it is a key frame."""

    track: int
    timestamp: int
    offset: int
    length: int
    key: bool


# ---- writing ---------------------------------------------------------------


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _vint(value: int, width: int = 0) -> bytes:
    """A variable-length size: as many bytes as needed; all-ones values are reserved."""
    if not width:
        width = 1
        while value >= (1 << (7 * width)) - 1:
            width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def _element(element: int, data: bytes) -> bytes:
    return _id(element) + _vint(len(data)) + data


def _uint(element: int, value: int) -> bytes:
    return _element(element, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], relative: int) -> bytes:
    """A SimpleBlock of track 1: fixed lacing for frames of one size, EBML lacing otherwise."""
    head = b"\x81" + struct.pack(">h", relative)
    if len(frames) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if len({len(f) for f in frames}) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = _vint(len(frames[0]))
    for a, b in zip(frames, frames[1:-1]):
        width = 1
        while not -((1 << (7 * width - 1)) - 1) <= len(b) - len(a) <= (1 << (7 * width - 1)) - 1:
            width += 1
        sizes += _vint(len(b) - len(a) + (1 << (7 * width - 1)) - 1, width)
    return _element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames))


def mux(frames: list[bytes]) -> bytes:
    """A Matroska file of the frames, in order."""
    header = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS))) + _element(MUXING_APP, b"skysurvey") + _element(WRITING_APP, b"skysurvey"))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", 8000.0)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING_FLAG, 1) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body = [info, tracks]
    at = len(info) + len(tracks)
    cues = []
    for first in range(0, len(frames), LACED * BLOCKS):
        time = first * FRAME_MS
        part = frames[first : first + LACED * BLOCKS]
        blocks = b"".join(_laced(part[i : i + LACED], i * FRAME_MS) for i in range(0, len(part), LACED))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, time) + blocks)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(body))


# ---- reading ---------------------------------------------------------------


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    width = 9 - first.bit_length()
    if not 1 <= width <= 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_vint(data: bytes, at: int) -> tuple[int | None, int, int]:
    """(value, or None where the size is unknown; the next byte; the width)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (None if value == (1 << (7 * width)) - 1 else value), at + width, width


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and the first one's place."""
    if not lacing:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if lacing == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    else:
        value, at, _ = _read_vint(data, at)
        sizes.append(value or 0)
        for _ in range(n - 2):
            first = data[at]
            width = 9 - first.bit_length()
            raw = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
            sizes.append(sizes[-1] + raw - ((1 << (7 * width - 1)) - 1))
            at += width
        if n == 1:
            sizes = []
    sizes.append(end - at - sum(sizes))
    return sizes, at


class Media(NamedTuple):
    """What a file holds: packets, cues as (time in ms, cluster's place), clusters' places, codecs by track."""

    packets: list[Packet]
    cues: list[tuple[int, int]]
    clusters: list[int]
    tracks: dict[int, str]


class _Track:
    """What a track's entry says about its frames' times."""

    def __init__(self) -> None:
        self.codec, self.duration, self.rate, self.channels, self.bits = "", 0, 8000.0, 1, 0

    def lasts(self, size: int) -> float:
        """Nanoseconds of a frame of so many bytes, 0 where the file does not tell."""
        if self.duration:
            return self.duration
        sample = self.channels * self.bits / 8
        return size / sample / self.rate * 1e9 if self.codec.startswith("A_PCM") and sample and self.rate else 0.0


def _float(raw: bytes) -> float:
    return struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if len(raw) in (4, 8) else 0.0


def demux(data: bytes) -> Media:
    """Parse a file into its packet table."""
    packets: list[Packet] = []
    cues: list[tuple[int, int]] = []
    clusters: list[int] = []
    tracks: dict[int, _Track] = {}
    entry = _Track()
    scale, time, cue_time = 1_000_000, 0, 0
    segment, group = 0, 0
    number = lambda: int.from_bytes(data[at:end], "big")
    at = 0
    ends: list[tuple[int, int]] = []  # open master elements: (id, end)
    while at < len(data):
        while ends and at >= ends[-1][1]:
            ends.pop()
        start = at
        element, at = _read_id(data, at)
        size, at, _ = _read_vint(data, at)
        # An element of unknown size ends where one begins that cannot be inside it.
        while ends and ends[-1][0] == CLUSTER and element in _TOP:
            ends.pop()
        end = len(data) if size is None else at + size
        if element in _INSIDE:
            ends.append((element, end))
            if element == SEGMENT:
                segment = at
            elif element == CLUSTER:
                clusters.append(start - segment)
                time = 0
            elif element == TRACK_ENTRY:
                entry = _Track()
            elif element == BLOCK_GROUP:
                group = len(packets)
            continue
        if element == TIMESTAMP:
            time = number()
        elif element == TIMESTAMP_SCALE:
            scale = number() or scale
        elif element == TRACK_NUMBER:
            tracks[number()] = entry
        elif element == CODEC_ID:
            entry.codec = data[at:end].decode("ascii", "replace")
        elif element == DEFAULT_DURATION:
            entry.duration = number()
        elif element == SAMPLING:
            entry.rate = _float(data[at:end])
        elif element == CHANNELS:
            entry.channels = number()
        elif element == BIT_DEPTH:
            entry.bits = number()
        elif element == CUE_TIME:
            cue_time = number() * scale // 1_000_000
        elif element == CUE_CLUSTER:
            cues.append((cue_time, number()))
        elif element == REFERENCE:
            packets[group:] = [p._replace(key=False) for p in packets[group:]]
        elif element in (SIMPLE_BLOCK, BLOCK):
            track, place, _ = _read_vint(data, at)
            relative = struct.unpack_from(">h", data, place)[0]
            flags = data[place + 2]
            sizes, place = _frame_sizes(data, place + 3, end, flags >> 1 & 3)
            lasts, passed = tracks.get(track or 0, _Track()).lasts, 0.0
            for n in sizes:
                packets.append(Packet(track or 0, int(((time + relative) * scale + passed) // 1_000_000), place, n, element == BLOCK or bool(flags & 0x80)))
                place += n
                passed += lasts(n)
        at = end
    return Media(packets, cues, clusters, {k: t.codec for k, t in tracks.items()})


def payload(text: bytes) -> bytes:
    """text padded with byte 255 to a positive multiple of FRAME."""
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def feature(media: Media, samples: np.ndarray) -> str:
    """Counts of the packet table and statistics of the samples read back."""
    keys = sum(p.key for p in media.packets)
    linked = len(set(media.clusters).intersection(place for _, place in media.cues))
    last = media.packets[-1].timestamp if media.packets else 0
    mean = float(samples.mean()) if len(samples) else 0.0
    spread = float(samples.std()) if len(samples) else 0.0
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={linked};keys={keys};last_ms={last};mean={mean:.6f};std={spread:.6f}"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Per row: sizes and digests of the payload read back and of the file; with full also the file and its packets."""
    kind = docs.schema[key].dataType.simpleString()
    slim = text_input(docs, key, text=text).select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            data = payload(text)
            file = mux([data[i : i + FRAME] for i in range(0, len(data), FRAME)])
            media = demux(file)
            back = b"".join([file[p.offset : p.offset + p.length] for p in media.packets])
            row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(media, np.frombuffer(back, np.uint8)))
            rows.append((*row, file, [p._asdict() for p in media.packets]) if full else row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        if full:
            packet = pa.struct([("track", pa.int64()), ("timestamp", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.bool_())])
            kinds += [pa.binary(), pa.list_(packet)]
            names += ["file", "packets"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["key", *names])

    schema = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if full:
        schema += ", file binary, packets array<struct<track: bigint, timestamp: bigint, offset: bigint, length: bigint, key: boolean>>"
    return map_columns(slim, schema, run).withColumnRenamed("key", key)
