"""Raster, mesh and photo containers as bytes: PNG and GeoTIFF tiles, binary glTF, Exif stamps; and PLY points.

A raster is cut into blocks, so each file is of bounded size and blocks are made in
parallel.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysurvey.session import ship
from skysurvey.sources.binary import LAS_SCHEMA, las_from_binary, tiff_tags


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of bytes of shape (height, width) or (height, width, 2 to 4 channels)."""
    height, width = pixels.shape[:2]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of an unfiltered 8-bit PNG, as png_bytes makes them."""
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    at, body = 8, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += size + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * channels + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows are not supported")
    return rows[:, 1:].reshape((height, width) if channels == 1 else (height, width, channels))


_STRIP = 64


def geotiff_bytes(values: np.ndarray, west: float, north: float, size: float, epsg: int = 0, nodata: float | None = None, software: str = "skysurvey") -> bytes:
    """A deflated GeoTIFF of 32-bit floats or bytes of shape (height, width) or (height, width, bands)."""
    values = values[:, :, None] if values.ndim == 2 else values
    height, width, bands = values.shape
    kind, bits = (1, 8) if values.dtype == np.uint8 else (3, 32)
    body = values.astype(np.uint8 if kind == 1 else "<f4")
    strips = [zlib.compress(body[r : r + _STRIP].tobytes()) for r in range(0, height, _STRIP)]
    keys = [1, 1, 0, 1, 3072 if epsg != 4326 else 2048, 0, 1, epsg]
    entries: list[tuple[int, int, list]] = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * bands), (259, 3, [8]), (262, 3, [2 if bands >= 3 else 1]), (273, 4, [0] * len(strips)), (277, 3, [bands]), (278, 4, [_STRIP]),
        (279, 4, [len(s) for s in strips]), (284, 3, [1]), (305, 2, [software.encode() + b"\0"]), (339, 3, [kind] * bands),
        (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0]),
    ]
    if epsg:
        entries.append((34735, 3, keys))
    if nodata is not None:
        entries.append((42113, 2, [f"{nodata:g}".encode() + b"\0"]))
    return _tiff(entries, strips)


_PACK = {1: "B", 3: "H", 4: "I", 12: "d"}


def _tiff(entries: list[tuple[int, int, list]], strips: list[bytes]) -> bytes:
    """A little-endian TIFF of one directory; the strips follow it, and their offsets fill tag 273."""
    packed = [(tag, kind, v[0] if kind == 2 else b"".join(struct.pack("<" + _PACK[kind], x) for x in v), len(v[0]) if kind == 2 else len(v)) for tag, kind, v in entries]
    at = 8 + 2 + 12 * len(packed) + 4
    places = {}
    for tag, _, raw, _ in packed:
        if len(raw) > 4:
            places[tag] = at
            at += len(raw) + len(raw) % 2
    offsets = list(np.cumsum([at, *map(len, strips)])[:-1].tolist()) if strips else []
    out = [b"II*\0", struct.pack("<IH", 8, len(packed))]
    tail = []
    for tag, kind, raw, n in packed:
        raw = struct.pack(f"<{len(offsets)}I", *offsets) if tag == 273 else raw
        out.append(struct.pack("<HHI", tag, kind, n) + (struct.pack("<I", places[tag]) if tag in places else raw.ljust(4, b"\0")))
        if tag in places:
            tail.append(raw + b"\0" * (len(raw) % 2))
    return b"".join([*out, b"\0\0\0\0", *tail, *strips])


def geotiff_values(data: bytes) -> tuple[np.ndarray, dict]:
    """The values (height, width, bands) of a plain or deflated TIFF of strips, no data as NaN, and west, north, size, epsg."""
    tags = tiff_tags(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) != 1 or 273 not in tags:
        raise ValueError("only plain or deflated strips are supported")
    width, height, bands = one(256, 0), one(257, 0), one(277, 1)
    kind = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (3, 32): "f4", (3, 64): "f8"}[one(339, 1), one(258, 8)]
    raw = b"".join((zlib.decompress(s) if one(259, 1) != 1 else s) for s in (data[o : o + n] for o, n in zip(tags[273], tags[279])))
    values = np.frombuffer(raw, np.dtype(kind).newbyteorder("<" if data[:2] == b"II" else ">"), height * width * bands).reshape(height, width, bands).astype(float)
    if 42113 in tags:
        values[values == float(tags[42113][0])] = np.nan
    keys = tags.get(34735, [])
    codes = {k: v for k, _, _, v in zip(*(keys[i::4] for i in range(4)))}
    place = tags.get(33922, [0.0] * 6)
    return values, {"west": place[3], "north": place[4], "size": tags.get(33550, [1.0])[0], "epsg": codes.get(3072, codes.get(2048, 0))}


def geotiff_tiles(raster: DataFrame, size: float, epsg: int, block: int = 512, nodata: float = -9999.0) -> DataFrame:
    """(tile_row, tile_col, content) of a raster (row, col, value); rows count to the north, files start at the northern edge."""
    ship(raster.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["tile_row"].iloc[0], frame["tile_col"].iloc[0]
        values = np.full((block, block), nodata, np.float32)
        values[block - 1 - (frame["row"] - r * block), frame["col"] - c * block] = frame["value"]
        return pd.DataFrame({"tile_row": [r], "tile_col": [c], "content": [geotiff_bytes(values, c * block * size, (r + 1) * block * size, size, epsg, nodata)]})

    keyed = raster.select((F.floor(F.col("row") / block)).alias("tile_row"), F.floor(F.col("col") / block).alias("tile_col"), "row", "col", F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
    return keyed.groupBy("tile_row", "tile_col").applyInPandas(run, "tile_row long, tile_col long, content binary")


def geotiff_cells(files: DataFrame) -> DataFrame:
    """(row, col, band, value, epsg) of GeoTIFF files (content); rows count to the north from the system's origin, cells without data are left out."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                values, place = geotiff_values(content.as_py())
                i, j, band = np.nonzero(~np.isnan(values))
                row = np.rint(place["north"] / place["size"]).astype(np.int64) - 1 - i
                col = np.rint(place["west"] / place["size"]).astype(np.int64) + j
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(band.astype(np.int32)), pa.array(values[i, j, band]), pa.array(np.full(len(i), place["epsg"], np.int32))], ["row", "col", "band", "value", "epsg"])

    return files.select("content").mapInArrow(run, "row long, col long, band int, value double, epsg int")


def png_tiles(raster: DataFrame, block: int = 256) -> DataFrame:
    """(z, x, y, content) tiles of a raster of bytes (z, row, col, value), with an alpha channel; rows count to the north."""
    ship(raster.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (frame[k].iloc[0] for k in "zxy")
        pixels = np.zeros((block, block, 2), np.uint8)
        pixels[block - 1 - (frame["row"] - y * block), frame["col"] - x * block] = np.stack([frame["value"], np.full(len(frame), 255)], axis=1)
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "content": [png_bytes(pixels)]})

    keyed = raster.select(F.col("z").cast("int").alias("z"), F.floor(F.col("col") / block).alias("x"), F.floor(F.col("row") / block).alias("y"), "row", "col", "value").filter("value IS NOT NULL")
    return keyed.groupBy("z", "x", "y").applyInPandas(run, "z int, x long, y long, content binary")


def tile_document(title: str, epsg: int, bounds: tuple[float, float, float, float], zooms: tuple[int, int], resolution: float, size: int = 256, ext: str = "png") -> str:
    """The XML description of a tile directory."""
    sets = "".join(f'<TileSet href="{z}" units-per-pixel="{resolution / 2**z:.14f}" order="{z}"/>' for z in range(zooms[0], zooms[1] + 1))
    x0, y0, x1, y1 = bounds
    return (
        f'<?xml version="1.0" encoding="utf-8"?><TileMap version="1.0.0" tilemapservice="http://tms.osgeo.org/1.0.0"><Title>{title}</Title><SRS>EPSG:{epsg}</SRS><BoundingBox minx="{x0}" miny="{y0}" maxx="{x1}" maxy="{y1}"/>'
        f'<Origin x="{x0}" y="{y0}"/><TileFormat width="{size}" height="{size}" mime-type="image/{ext}" extension="{ext}"/><TileSets>{sets}</TileSets></TileMap>'
    )


def glb_bytes(vertices: np.ndarray, places: np.ndarray, faces: np.ndarray) -> bytes:
    """Binary glTF of vertices (n, 3) about their centre, texture places (n, 2) counted from the top, and triangles (m, 3)."""
    centre = (vertices.min(axis=0) + vertices.max(axis=0)) / 2 if len(vertices) else np.zeros(3)
    at = (vertices - centre).astype("<f4")
    uv = np.stack([places[:, 0], 1 - places[:, 1]], axis=1).astype("<f4") if len(places) else np.zeros((0, 2), "<f4")
    parts = [at.tobytes(), uv.tobytes(), faces.astype("<u4").tobytes()]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    views = [{"buffer": 0, "byteOffset": s, "byteLength": len(p), "target": t} for s, p, t in zip(starts, parts, (34962, 34962, 34963))]
    ends = lambda a: {"min": a.min(axis=0).astype(float).tolist(), "max": a.max(axis=0).astype(float).tolist()} if len(a) else {}
    accessors = [{"bufferView": 0, "componentType": 5126, "count": len(at), "type": "VEC3", **ends(at)}, {"bufferView": 1, "componentType": 5126, "count": len(uv), "type": "VEC2"}, {"bufferView": 2, "componentType": 5125, "count": int(faces.size), "type": "SCALAR"}]
    scene = {
        "asset": {"version": "2.0", "generator": "skysurvey"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "extensions": {"CESIUM_RTC": {"center": centre.tolist()}}, "extensionsUsed": ["CESIUM_RTC"],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "TEXCOORD_0": 1}, "indices": 2}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": starts[-1]}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(parts)
    return struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(text) + 8 + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def glb_scene(data: bytes) -> dict:
    """The JSON document of a binary glTF file."""
    size = struct.unpack("<I", data[12:16])[0]
    return json.loads(data[20 : 20 + size])


def _rational(text: str) -> bytes:
    return b"".join(struct.pack(">II", *map(int, r.split("/"))) for r in text.split(" "))


def stamped(jpeg: bytes, latitude: str, longitude: str, refs: str, time: str, make: str) -> bytes:
    """A JPEG with an Exif segment: positions as rationals 'd/1 m/1 s/100000' with references as in 'NE', a time and a maker."""
    text = lambda s: s.encode() + b"\0"
    ascii_ = [(271, text(make)), (306, text(time))]
    gps = [(1, 2, text(refs[0])), (2, 5, _rational(latitude)), (3, 2, text(refs[1])), (4, 5, _rational(longitude))]
    first = [(t, 2, v) for t, v in ascii_] + [(0x8825, 4, b"")]
    start = 8 + 2 + 12 * len(first) + 4
    later, at = [], start

    def entry(tag: int, kind: int, raw: bytes) -> bytes:
        nonlocal at
        n = len(raw) // {2: 1, 5: 8}[kind]
        head = struct.pack(">HHI", tag, kind, n)
        if len(raw) <= 4:
            return head + raw.ljust(4, b"\0")
        later.append(raw + b"\0" * (len(raw) % 2))
        at += len(later[-1])
        return head + struct.pack(">I", at - len(later[-1]))

    rows = [entry(*e) for e in first[:-1]]
    place = at  # the second directory follows the first one's values
    at += 2 + 12 * len(gps) + 4
    own, later = later, []
    inner = b"".join(entry(*e) for e in gps)
    rows.append(struct.pack(">HHII", 0x8825, 4, 1, place))
    tiff = b"MM\0*" + struct.pack(">IH", 8, len(rows)) + b"".join(rows) + b"\0\0\0\0" + b"".join(own) + struct.pack(">H", len(gps)) + inner + b"\0\0\0\0" + b"".join(later)
    body = b"Exif\0\0" + tiff
    return jpeg[:2] + struct.pack(">HH", 0xFFE1, len(body) + 2) + body + jpeg[2:]


def with_stamps(frames: DataFrame) -> DataFrame:
    """(path, content) of frames (path, content, latitude, longitude, refs, time, make)."""
    ship(frames.sparkSession)
    names = ["content", "latitude", "longitude", "refs", "time", "make"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(1, 7)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stamped(*r) for r in rows], pa.binary())], ["path", "content"])

    return frames.select("path", *names).mapInArrow(run, "path string, content binary")


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLY_SCHEMA = "x double, y double, z double, red int, green int, blue int, views int"


def ply_points(data: bytes) -> pa.RecordBatch:
    """The vertices of a PLY file, ASCII or binary, under the names of PLY_SCHEMA; null where the file has no such property."""
    head, _, body = data.partition(b"end_header\n")
    lines = head.decode("ascii", "replace").splitlines()
    form = next((x.split()[1] for x in lines if x.startswith("format")), "")
    count, fields, inside = 0, [], False
    for parts in (x.split() for x in lines):
        if parts[:1] == ["element"]:
            inside = parts[1] == "vertex"
            count = int(parts[2]) if inside else count
        elif parts[:1] == ["property"] and inside:
            if parts[1] == "list":
                raise ValueError("vertices with lists are not supported")
            fields.append((parts[2], _PLY[parts[1]]))
    if form == "ascii":
        table = np.array(b" ".join(body.splitlines()[:count]).split(), float).reshape(count, len(fields)) if count else np.zeros((0, len(fields)))
        found = {n: table[:, k] for k, (n, _) in enumerate(fields)}
    else:
        order = "<" if "little" in form else ">"
        rows = np.frombuffer(body, np.dtype([(n, order + k) for n, k in fields]), count)
        found = {n: rows[n] for n, _ in fields}
    alias = {"red": ("red", "diffuse_red"), "green": ("green", "diffuse_green"), "blue": ("blue", "diffuse_blue"), "views": ("views", "scalar_views")}
    columns, names = [], []
    for name, kind in (c.split() for c in PLY_SCHEMA.split(", ")):
        values = next((found[k] for k in alias.get(name, (name,)) if k in found), None)
        arrow = pa.float64() if kind == "double" else pa.int32()
        columns.append(pa.nulls(count, arrow) if values is None else pa.array(values.astype(float if kind == "double" else np.int32)))
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names)


def points_from_binary(files: DataFrame) -> DataFrame:
    """Points (x, y, z, red, green, blue, views) of PLY and LAS files (path, content), read by their type."""
    ship(files.sparkSession)
    ply, las = (files.filter(F.lower("path").endswith(f".{k}")) for k in ("ply", "las"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield ply_points(content.as_py())

    names = [c.split()[0] for c in PLY_SCHEMA.split(", ")]
    known = {c.split()[0] for c in LAS_SCHEMA.split(", ")}
    points = las_from_binary(las).select(*(F.col(n) if n in known else F.lit(None).cast("int").alias(n) for n in names))
    return ply.select("content").mapInArrow(run, PLY_SCHEMA).unionByName(points)


def gml_member(gcp: DataFrame) -> DataFrame:
    """K4: ground control as GML features, one a row."""
    at = F.concat_ws(",", *(F.col(k).cast("string") for k in "xyz"))
    escape = F.regexp_replace(F.regexp_replace("filename", "&", "&amp;"), "<", "&lt;")
    return gcp.select(F.concat(F.lit("<gml:featureMember><gcp><filename>"), escape, F.lit("</filename><gml:Point><gml:coordinates>"), at, F.lit("</gml:coordinates></gml:Point></gcp></gml:featureMember>")).alias("feature"))
