"""Text formats of surveys as DataFrames: ground control, positions, boundaries, subtitles, meshes and lists.

Line-oriented files are read whole, one row a file, since their first line says how to
read the others; each file is small, and files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skysurvey.functions.checks import checked

_BOM = "\ufeff"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file, without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", f"^{_BOM}", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 0, line) without trailing blanks."""
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _header(files: DataFrame) -> DataFrame:
    return files.select("path", F.trim(F.get(F.split("text", r"\r?\n"), F.lit(0))).alias("srs"), "text")


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def read_gcp(spark: SparkSession, path: str) -> DataFrame:
    """(path, srs, line_no, x, y, z, px, py, filename, extras); lines of fewer than six fields are left out."""
    return parse_gcp(whole_files(spark, path))


def parse_gcp(files: DataFrame) -> DataFrame:
    head = _header(files)
    rows = lines(head.select("path", "text")).join(head.select("path", "srs"), "path").filter((F.col("line_no") > 0) & (F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\s+")
    rows = rows.withColumn("p", parts).filter(F.size("p") >= 6)
    numbers = [_field(F.col("p"), i).try_cast("double").alias(k) for i, k in enumerate(("x", "y", "z", "px", "py"))]
    return rows.select("path", "srs", "line_no", *numbers, _field(F.col("p"), 5).alias("filename"), F.array_join(F.slice("p", 7, 1000), " ").alias("extras"))


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Positions by file name; the last line of a name wins."""
    return parse_geo(whole_files(spark, path))


def parse_geo(files: DataFrame) -> DataFrame:
    head = _header(files)
    rows = lines(head.select("path", "text")).join(head.select("path", "srs"), "path").filter((F.col("line_no") > 0) & (F.col("line") != "") & ~F.col("line").startswith("#"))
    p = F.col("p")
    number = lambda i: _field(p, i).try_cast("double")
    rows = rows.withColumn("p", F.split("line", r"\s+")).filter(F.size("p") >= 3)
    turned = (F.size(p) >= 7) & number(4).isNotNull() & number(5).isNotNull() & number(6).isNotNull() & ~F.isnan(number(4)) & ~F.isnan(number(5)) & ~F.isnan(number(6))
    exact = F.size(p) >= 9
    rows = rows.select(
        "path", "srs", "line_no", _field(p, 0).alias("filename"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"),
        *(F.when(turned, number(i)).alias(k) for i, k in ((4, "yaw"), (5, "pitch"), (6, "roll"))),
        *(F.when(exact, number(i)).alias(k) for i, k in ((7, "horizontal_accuracy"), (8, "vertical_accuracy"))),
        F.when(exact, F.array_join(F.slice("p", 10, 1000), " ")).otherwise("").alias("extras"),
    )
    rest = [c for c in rows.columns if c not in ("path", "filename")]
    return rows.groupBy("path", "filename").agg(F.max_by(F.struct(*rest), "line_no").alias("_r")).select("path", "filename", "_r.*")


def parse_coords(files: DataFrame) -> DataFrame:
    """(path, srs, east, north) of a reference file: a system, then offsets."""
    rows = F.split("text", r"\r?\n")
    pair = F.split(F.trim(F.get(rows, F.lit(1))), r"\s+")
    return files.select("path", F.trim(F.get(rows, F.lit(0))).alias("srs"), F.get(pair, F.lit(0)).cast("double").alias("east"), F.get(pair, F.lit(1)).cast("double").alias("north"))


_GEOJSON = "type string, crs struct<properties: struct<name: string>>, geometry struct<type: string, coordinates: string>, features array<struct<type: string, geometry: struct<type: string, coordinates: string>>>"


def parse_boundary(files: DataFrame) -> DataFrame:
    """(path, crs, ring) of a GeoJSON with exactly one Polygon feature; only its outer ring counts."""
    doc = files.select("path", F.from_json("text", _GEOJSON).alias("j"))
    features = F.when(F.col("j.type") == "FeatureCollection", F.col("j.features.geometry")).otherwise(F.array(F.col("j.geometry")))
    doc = doc.withColumn("f", features)
    ring = F.get(F.from_json(F.get("f", F.lit(0))["coordinates"], "array<array<array<double>>>"), F.lit(0))
    point = lambda q: F.struct(q[0].alias("x"), q[1].alias("y"), F.get(q, F.lit(2)).alias("z"))
    return doc.select("path", F.col("j.crs.properties.name").alias("crs"), checked(F.size("f") == 1, checked(F.get("f", F.lit(0))["type"] == "Polygon", F.transform(ring, point), "a boundary is a polygon"), "a boundary has exactly one feature").alias("ring"))


_CAMERA = "struct<focal: double, focal_x: double, k1: double, k2: double, width: int, height: int, projection_type: string>"
_SHOT = "struct<rotation: array<double>, translation: array<double>, camera: string, gps_dop: double, capture_time: double>"
RECONSTRUCTION = f"array<struct<reference_lla: struct<latitude: double, longitude: double, altitude: double>, cameras: map<string, {_CAMERA}>, shots: map<string, {_SHOT}>, points: map<string, struct<coordinates: array<double>>>>>"


def parse_reconstruction(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras, shots and points of the first reconstruction of each file."""
    first = files.select("path", F.get(F.from_json("text", RECONSTRUCTION), F.lit(0)).alias("r"))
    cameras = first.select("path", F.explode("r.cameras").alias("camera", "v")).select("path", "camera", "v.*")
    shots = first.select("path", F.explode("r.shots").alias("filename", "v")).select("path", "filename", "v.*")
    points = first.select("path", F.explode("r.points").alias("id", "v")).select("path", "id", *(F.get("v.coordinates", F.lit(i)).alias(k) for i, k in enumerate("xyz")))
    return cameras, shots, points


def parse_nvm(files: DataFrame) -> DataFrame:
    """(path, place, filename, rest) of the images of an NVM_V3 file."""
    body = lines(files).filter(F.col("line") != "")
    at = F.row_number().over(_in_order()) - 1
    numbered = body.withColumn("at", at).withColumn("magic", F.first("line").over(_in_order()))
    count = F.max(F.when(F.col("at") == 1, F.col("line").try_cast("int"))).over(_whole())
    images = numbered.withColumn("n", checked(F.col("magic").startswith("NVM_V3"), count, "not an NVM_V3 file")).filter((F.col("at") >= 2) & (F.col("at") < F.col("n") + 2))
    return images.select("path", (F.col("at") - 2).alias("place"), F.substring_index("line", " ", 1).alias("filename"), F.expr("substring(line, locate(' ', line) + 1)").alias("rest"))


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("line_no")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("path")


def parse_obj(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (path, id, x, y, z), texture places (path, id, u, v) and faces (path, line_no, material, corner, vertex, texture)."""
    rows = lines(files).withColumn("p", F.split("line", r"\s+")).withColumn("tag", F.get("p", F.lit(0)))
    material = F.last(F.when(F.col("tag") == "usemtl", F.get("p", F.lit(1))), ignorenulls=True).over(_in_order())
    rows = rows.withColumn("material", material)

    def numbered(tag: str, names: str) -> DataFrame:
        some = rows.filter(F.col("tag") == tag)
        return some.select("path", F.row_number().over(_in_order()).alias("id"), *(F.get("p", F.lit(i)).cast("double").alias(k) for i, k in enumerate(names, 1)))

    corners = rows.filter("tag = 'f'").select("path", "line_no", "material", F.posexplode(F.slice("p", 2, 100)).alias("corner", "c"))
    parts = F.split("c", "/")
    faces = corners.select("path", "line_no", "material", "corner", F.get(parts, F.lit(0)).cast("int").alias("vertex"), F.get(parts, F.lit(1)).try_cast("int").alias("texture"))
    return numbered("v", "xyz"), numbered("vt", "uv"), faces


def parse_ply_header(files: DataFrame) -> DataFrame:
    """(path, vertex_count, has_normals, has_views, properties) of PLY headers of at most 100 lines."""
    head = F.slice(F.split("text", r"\r?\n"), 1, 100)
    body = files.withColumn("h", head).withColumn("ends", F.array_position("h", "end_header"))
    inside = F.slice("h", F.lit(1), F.greatest(F.col("ends").cast("int"), F.lit(1)))
    names = F.transform(F.filter(inside, lambda x: x.startswith("property")), lambda x: F.substring_index(x, " ", -1))
    vertex = F.filter(inside, lambda x: x.startswith("element vertex"))
    return body.select(
        "path", F.substring_index(F.get(vertex, F.lit(0)), " ", -1).cast("long").alias("vertex_count"),
        F.arrays_overlap(names, F.array(F.lit("nx"), F.lit("normalx"), F.lit("normal_x"))).alias("has_normals"), F.array_contains(names, "views").alias("has_views"),
        checked(F.col("ends") > 0, names, "the PLY header has more than 100 lines").alias("properties"),
    )


_TIME = r"(\d\d:\d\d:\d\d[,.]\d{1,3})"
_NUMBER = r"([+-]?\d+\.?\d*)"


def _place(field: int, tag: str) -> str:
    """The pattern of one field of a position (longitude, latitude, altitude) after a tag."""
    return rf"\b{tag}\s*\(\s*" + r"[^,()]*,\s*" * (field - 1) + _NUMBER


def _pick(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def parse_srt(files: DataFrame) -> DataFrame:
    """(path, cue, start_s, end_s, iso, shutter, fnum, focal_len, latitude, longitude, altitude) of drone subtitles.

    A cue is a block between blank lines; the last one counts without a blank line after
    it. Markup is removed; every field is looked for under several vendors' spellings, and
    a height above the start is never taken for an altitude.
    """
    blocks = files.select("path", F.posexplode(F.split("text", r"\r?\n\s*\r?\n")).alias("cue", "block"))
    text = F.regexp_replace("block", "<[^>]+>", "")
    cues = blocks.withColumn("t", text).filter(F.col("t").rlike(f"{_TIME}\\s*-->\\s*{_TIME}"))
    times = [F.regexp_extract("t", f"{_TIME}\\s*-->\\s*{_TIME}", i) for i in (1, 2)]

    def seconds(stamp: Column) -> Column:
        p = F.split(F.regexp_replace(stamp, ",", "."), ":")
        return F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double")

    t = F.col("t")
    number = lambda x: x.try_cast("double")
    shutter = _pick(t, [r"(?i)shutter\s*:\s*(?:\d+/)?(\d+\.?\d*)", r"SS (\d+\.?\d*)"])
    return cues.select(
        "path", "cue", seconds(times[0]).alias("start_s"), seconds(times[1]).alias("end_s"),
        _pick(t, [r"(?i)iso\s*:\s*(\d+)", r"ISO (\d+)"]).try_cast("int").alias("iso"),
        shutter.try_cast("double").alias("shutter"),
        (_pick(t, [r"(?i)fnum\s*:\s*(\d+\.?\d*)", r"F/(\d+\.?\d*)"]).try_cast("double")).alias("fnum_raw"),
        _pick(t, [r"(?i)focal_len\s*:\s*(\d+)"]).try_cast("int").alias("focal_len"),
        number(_pick(t, [rf"(?i)latitude\s*:\s*{_NUMBER}", _place(2, "GPS"), _place(2, "RTK"), rf"\(N:?\s*{_NUMBER}"])).alias("latitude"),
        number(_pick(t, [rf"(?i)long?itude?\s*:\s*{_NUMBER}", rf"(?i)longtitude\s*:\s*{_NUMBER}", _place(1, "GPS"), _place(1, "RTK")])).alias("longitude"),
        number(_pick(t, [rf"(?i)altitude\s*:\s*{_NUMBER}", _place(3, "GPS"), _place(3, "RTK"), rf"(?i)abs_alt\s*:\s*{_NUMBER}"])).alias("altitude"),
    ).withColumn("fnum", F.when(F.col("fnum_raw") > 100, F.col("fnum_raw") / 100).otherwise(F.col("fnum_raw"))).drop("fnum_raw")


def parse_groups(files: DataFrame) -> DataFrame:
    """(path, name, group) of lists of images and groups or epochs."""
    p = F.split("line", r"\s+")
    return lines(files).filter(F.col("line") != "").select("path", F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("group"))


def parse_waypoints(files: DataFrame) -> DataFrame:
    """(path, place, x, y, z)."""
    p = F.split("line", r"\s+")
    return lines(files).filter(F.col("line") != "").select("path", F.col("line_no").alias("place"), *(F.get(p, F.lit(i)).cast("double").alias(k) for i, k in enumerate("xyz")))


def parse_ramp(files: DataFrame) -> DataFrame:
    """(path, stop, red, green, blue); stops are values or percents, 'nv' stands for no value."""
    p = F.split("line", r"[\s,]+")
    stop = F.get(p, F.lit(0))
    value = F.when(stop.endswith("%"), F.regexp_replace(stop, "%", "").try_cast("double")).when(stop == "inf", F.lit(float("inf"))).otherwise(stop.try_cast("double"))
    return lines(files).filter(F.col("line") != "").select("path", value.alias("stop"), stop.endswith("%").alias("percent"), *(F.get(p, F.lit(i)).cast("int").alias(k) for i, k in enumerate(("red", "green", "blue"), 1)))


def complete_groups(found: DataFrame, group: str, expected: int) -> DataFrame:
    """Groups all of whose files are there."""
    return found.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") == expected).select(group)
