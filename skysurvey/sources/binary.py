"""Binary formats: image headers, metadata packets and LAS point records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

IMAGE_TYPES = ("jpg", "jpeg", "tif", "tiff", "png", "dng", "raw", "nef", "webp", "bmp")
VIDEO_TYPES = ("mp4", "mov", "lrv", "ts")


def scan_names(names: DataFrame, column: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """Names with ``valid``: of a known type and not a mask."""
    low = F.lower(column)
    base = F.regexp_replace(low, r"\.[a-z0-9]+$", "")
    return names.withColumn("valid", F.substring_index(low, ".", -1).isin(*types) & low.contains(".") & ~base.endswith("_mask"))


def scan_folder(spark: SparkSession, path: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """(path, length, content, valid) of the files of a folder; contents are read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return scan_names(files, "path", types)


def image_size(data: bytes) -> tuple[int, int] | None:
    """S3: (width, height) from a PNG, JPEG, TIFF or BMP header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    tags = tiff_tags(data)
    return (int(tags[256][0]), int(tags[257][0])) if 256 in tags and 257 in tags else None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_tags(data: bytes, start: int = 0, pointers: tuple[int, ...] = (0x8769, 0x8825)) -> dict[int, list]:
    """Values by tag of a TIFF structure, with those of the directories it points to."""
    order = {b"II": "<", b"MM": ">"}.get(data[start : start + 2])
    if order is None or len(data) < start + 8:
        return {}
    found: dict[int, list] = {}
    todo = [struct.unpack(order + "I", data[start + 4 : start + 8])[0]]
    seen = set()
    while todo:
        at = start + todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            size = _SIZES.get(kind, 0) * n
            place = entry[8:12] if size <= 4 else data[(o := start + struct.unpack(order + "I", entry[8:12])[0]) : o + size]
            if not size or len(place) < size:
                continue
            if kind == 2:
                value: list = [place[:size].rstrip(b"\0").decode("utf-8", "replace")]
            elif kind in (5, 10):
                raw = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * n), place[:size])
                value = [f"{a}/{b}" for a, b in zip(raw[::2], raw[1::2])]
            elif kind == 7:
                value = [place[:size].hex()]
            else:
                value = list(struct.unpack(order + _CODES[kind] * n, place[:size]))
            if tag in pointers and kind in (3, 4):
                todo.append(value[0])
            else:
                found.setdefault(tag, value)
    return found


def exif_tags(data: bytes) -> dict[int, list]:
    """Tags of a TIFF file or of a JPEG's Exif segment."""
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0", 0, 65536 * 4)
        return tiff_tags(data, at + 6) if at >= 0 else {}
    return tiff_tags(data)


def xmp_packets(data: bytes) -> list[str]:
    """The XMP packets of a file's bytes."""
    out, at = [], 0
    while (low := data.find(b"<x:xmpmeta", at)) >= 0:
        high = data.find(b"</x:xmpmeta", low)
        if high < 0:
            break
        at = high + 12
        out.append(data[low:at].decode("utf-8", "replace"))
    return out


def thermal_payload(data: bytes) -> bytes:
    """The bytes of a JPEG's application (and comment) segments 3 to 13, counted from 0: a thermal image of 16-bit samples."""
    parts, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xE0 <= data[at + 1] <= 0xEF or data[at + 1] == 0xFE:
            parts.append(data[at + 4 : at + 2 + size])
        at += 2 + size
    return b"".join(parts[3:14])


def with_thermal_payload(files: DataFrame) -> DataFrame:
    """(path, payload) from a binaryFile DataFrame."""
    from skysurvey.session import ship

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([thermal_payload(c.as_py()) for c in batch.column(1)], pa.binary())], ["path", "payload"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, payload binary")


def with_image_metadata(files: DataFrame) -> DataFrame:
    """(path, width, height, tags, xmp) from a binaryFile DataFrame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                size = image_size(content) or (None, None)
                rows.append((path, *size, {str(k): ",".join(map(str, v)) for k, v in exif_tags(content).items()}, xmp_packets(content)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "tags", "xmp"])

    from skysurvey.session import ship

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, tags map<string, string>, xmp array<string>")


# The fields of LAS point records.
_LAS_OLD = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_LAS_NEW = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("more", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps_time", "<f8")]
_LAS_TIME, _LAS_RGB = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: Records of one point by format.
LAS_FORMATS = {0: _LAS_OLD, 1: _LAS_OLD + _LAS_TIME, 2: _LAS_OLD + _LAS_RGB, 3: _LAS_OLD + _LAS_TIME + _LAS_RGB, 6: _LAS_NEW, 7: _LAS_NEW + _LAS_RGB, 8: [*_LAS_NEW, *_LAS_RGB, ("nir", "<u2")]}
#: The format that is written.
LAS_RECORD = np.dtype(LAS_FORMATS[3])
LAS_SCHEMA = "x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, scan_angle double, user_data int, point_source_id int, gps_time double, red int, green int, blue int"
_LAS_HEAD = struct.Struct("<4sHH16sBB32s32sHHHIIBHI5I12d")


def las_header(data: bytes) -> dict:
    """What a LAS header (1.0 to 1.4) says about the records, and the code of its reference system where data holds it (else 0)."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    h = _LAS_HEAD.unpack(data[: _LAS_HEAD.size])
    count = struct.unpack("<Q", data[247:255])[0] if h[5] >= 4 and len(data) >= 255 else h[15]
    found = {"offset": h[11], "format": h[13], "record": h[14], "count": count, "scale": h[21:24], "shift": h[24:27], "epsg": 0}
    at = h[10]
    for _ in range(h[12]):
        if at + 54 > len(data):
            break
        _, user, record, size, _ = struct.unpack("<H16sHH32s", data[at : at + 54])
        keys = struct.unpack(f"<{size // 2}H", data[at + 54 : at + 54 + size // 2 * 2]) if record == 34735 and at + 54 + size <= len(data) else ()
        codes = {k: v for k, _, _, v in zip(*(keys[i::4] for i in range(4)))}
        found["epsg"] = codes.get(3072, codes.get(2048, found["epsg"]))
        at += 54 + size
    return found


def _las_record(header: dict) -> np.dtype:
    if header["format"] not in LAS_FORMATS:
        raise ValueError(f"point format {header['format']} is not supported")
    fields = LAS_FORMATS[header["format"]]
    plain = np.dtype(fields)
    return np.dtype({"names": plain.names, "formats": [plain[n] for n in plain.names], "offsets": [plain.fields[n][1] for n in plain.names], "itemsize": header["record"]})


def las_points(data: bytes, header: dict) -> pa.RecordBatch:
    """Records as columns; what a format lacks is 0."""
    shape = _las_record(header)
    r = np.frombuffer(data, shape, len(data) // shape.itemsize)
    new = header["format"] >= 6
    none = np.zeros(len(r), np.int32)
    field = lambda k: r[k] if k in shape.names else none
    bits, kind = (15, 255) if new else (7, 31)
    shift = 4 if new else 3
    angle = field("angle") * (0.006 if new else 1.0)
    (sx, sy, sz), (ox, oy, oz) = header["scale"], header["shift"]
    ints = lambda a: pa.array(a.astype(np.int32))
    columns = [pa.array(r["x"] * sx + ox), pa.array(r["y"] * sy + oy), pa.array(r["z"] * sz + oz), ints(r["intensity"]), ints(r["flags"] & bits), ints(r["flags"] >> shift & bits), ints(r["classification"] & kind), pa.array(angle.astype(float)), ints(r["user"]), ints(r["source"]), pa.array(field("gps_time").astype(float)), ints(field("red")), ints(field("green")), ints(field("blue"))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LAS_SCHEMA.split(", ")])


def las_bytes(frame: pd.DataFrame, scale: float = 0.001, epsg: int = 0) -> bytes:
    """K7, K9: a LAS 1.2 file of point format 3, with a record of its reference system if given."""
    n = len(frame)
    lows = [float(frame[k].min()) if n else 0.0 for k in "xyz"]
    highs = [float(frame[k].max()) if n else 0.0 for k in "xyz"]
    shift = [float(np.floor(v)) for v in lows]
    keys = struct.pack("<8H", 1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg) if epsg else b""
    system = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if epsg else b""
    head = _LAS_HEAD.pack(b"LASF", 0, 0, bytes(16), 1, 2, b"skysurvey", b"skysurvey", 1, 2024, _LAS_HEAD.size, _LAS_HEAD.size + len(system), 1 if epsg else 0, 3, LAS_RECORD.itemsize, n, n, 0, 0, 0, 0, scale, scale, scale, *shift, *(v for pair in zip(highs, lows) for v in pair))
    r = np.zeros(n, LAS_RECORD)
    for k, o in zip("xyz", shift):
        r[k] = np.rint((frame[k].to_numpy(float) - o) / scale).astype(np.int32)
    get = lambda k: frame[k].fillna(0).to_numpy() if k in frame else 0
    for field, name in (("intensity", "intensity"), ("classification", "classification"), ("angle", "scan_angle"), ("user", "user_data"), ("source", "point_source_id"), ("gps_time", "gps_time"), ("red", "red"), ("green", "green"), ("blue", "blue")):
        r[field] = get(name)
    r["flags"] = np.asarray(get("return_number")).astype(int) | np.asarray(get("number_of_returns")).astype(int) << 3
    return head + system + r.tobytes()


def las_from_binary(files: DataFrame) -> DataFrame:
    """The points of LAS files of any store, from a binaryFile DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                header = las_header(data)
                body = memoryview(data)[header["offset"] : header["offset"] + header["count"] * header["record"]]
                step = 100_000 * header["record"]
                for at in range(0, len(body), step):
                    yield las_points(bytes(body[at : at + step]), header)

    from skysurvey.session import ship

    ship(files.sparkSession)
    return files.select("content").mapInArrow(run, LAS_SCHEMA)


class _LasRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _LasReader(DataSourceReader):
    """Record ranges of files on a file system that all executors mount."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("rowsPerPartition", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            count = las_header(f.read(_LAS_HEAD.size))["count"]
        return [_LasRange(self.path, i, min(i + self.rows, count)) for i in range(0, count, self.rows)] or [_LasRange(self.path, 0, 0)]

    def read(self, partition: _LasRange) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            header = las_header(f.read(_LAS_HEAD.size))
            f.seek(header["offset"] + partition.first * header["record"])
            yield las_points(f.read((partition.last - partition.first) * header["record"]), header)


class _LasMessage(WriterCommitMessage):
    pass


class _LasWriter(DataSourceWriter):
    """One LAS file for each partition."""

    def __init__(self, options: dict, schema):
        self.path = options["path"].removeprefix("file://")
        self.names = schema.names

    def write(self, iterator) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        rows = list(iterator)  # one partition's points
        frame = pd.DataFrame.from_records(rows, columns=self.names)
        context = TaskContext.get()
        final = os.path.join(self.path, f"part-{context.partitionId():05d}.las")
        # Written aside and renamed, so that a repeated task leaves whole files.
        with open(f"{final}.{context.taskAttemptId()}", "wb") as f:
            f.write(las_bytes(frame))
        os.replace(f.name, final)
        return _LasMessage()


class LasDataSource(DataSource):
    """``spark.read.format("las")`` and ``df.write.format("las")``."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LasReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LasWriter(self.options, schema)
