"""Queries through readers, writers, tags and small rules, each held against the values it started from."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skysurvey.functions import geodesy as G, photo as P, sensor as X
from skysurvey.operators import points as O, raster as R, scenes as C, sets as S
from skysurvey.plans import lineage as L
from skysurvey.plans.adapters import domain, oracle
from skysurvey.plans.io_queries import texts_by
from skysurvey.session import shared_folder, ship
from skysurvey.sources import binary as B, containers as N, sinks as K, text as T
from skysurvey.streaming import frames as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same result."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = oracle(sql)
        return fn

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else lit(p) for p in parts))


def _string(v: Column) -> Column:
    return v.cast("string")


def _in_folder(folder: Column, name: Column) -> Column:
    """A path that is unique where names are not: file names cut capture numbers of more than six digits."""
    return F.concat(_string(folder), lit("/"), name)


# ---- readers -----------------------------------------------------------------


@query("""
    SELECT ord, ord % 6 IN (0, 1) AS image, ord % 6 = 3 AS video FROM photos
""")
def scanned_files(spark, sf_dir):
    """Files by their type, whatever its case; masks and names without a type are not taken."""
    end = F.element_at(F.array(*map(lit, (".JPG", ".tif", ".txt", ".MOV", "_mask.png", ""))), (c("ord") % 6 + 1).cast("int"))
    names = domain(spark, sf_dir, "photos").select("ord", _text("a/b", _string(c("ord")), end).alias("path"))
    both = B.scan_names(B.scan_names(names, "path").withColumnRenamed("valid", "image"), "path", B.VIDEO_TYPES)
    return both.select("ord", "image", c("valid").alias("video"))


@query("""
    SELECT ord, width, height, CASE WHEN ord % 2 = 0 THEN CAST(width AS STRING) END AS tag_width, CASE WHEN ord % 2 = 0 THEN 'DJI' END AS make, CAST(ord % 3 AS INT) AS packets FROM photos
""")
def image_files(spark, sf_dir):
    """Sizes, tags and metadata packets of image files made here: TIFF and PNG headers."""
    p = domain(spark, sf_dir, "photos").select("ord", "width", "height")
    word = lambda v: F.lpad(F.hex(v), 8, "0")
    tiff = _text("4D4D002A000000080003", "0100000400000001", word(c("width")), "0101000400000001", word(c("height")), "010F000200000004444A4900", "00000000")
    png = _text("89504E470D0A1A0A0000000D49484452", word(c("width")), word(c("height")), "0806000000")
    packet = F.hex(lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><a>1</a></x:xmpmeta>').cast("binary"))
    body = F.unhex(F.concat(F.when(c("ord") % 2 == 0, tiff).otherwise(png), F.repeat(packet, (c("ord") % 3).cast("int"))))
    found = B.with_image_metadata(p.select(_string(c("ord")).alias("path"), body.alias("content")))
    tag = lambda n: F.try_element_at("tags", lit(n))
    return found.select(c("path").cast("long").alias("ord"), "width", "height", tag("256").alias("tag_width"), tag("271").alias("make"), F.size("xmp").alias("packets"))


@query("SELECT ord, repeat(lpad(hex(ord % 251 + 3), 2, '0'), 2) || lpad(hex(ord % 251 + 4), 2, '0') || '01' AS payload FROM photos")
def thermal_payloads(spark, sf_dir):
    """Application segments 3 and 4 of images whose first three segments hold other things."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    k = c("ord") % 251
    body = F.unhex(_text("FFD8", "FFE00004AAAA", "FFE10004BBBB", "FFFE0004CCCC", "FFE30004", byte(k + 3), byte(k + 3), "FFE30004", byte(k + 4), "01", "FFDA0004FFE30004EEEE"))
    files = domain(spark, sf_dir, "photos").select(_string(c("ord")).alias("path"), body.alias("content"))
    return B.with_thermal_payload(files).select(c("path").cast("long").alias("ord"), F.hex("payload").alias("payload"))


@query("SELECT CAST(id AS STRING) AS path, 'WGS84 UTM ' || CAST(id % 60 + 1 AS STRING) || 'N' AS srs, CAST(id * 1000 AS DOUBLE) AS east, CAST(id * 10 AS DOUBLE) AS north FROM gcp UNION ALL SELECT 'own', 'EPSG:32616', 500000, 4000000")
def coords_text(spark, sf_dir):
    """The system and offsets of reference files."""
    g = domain(spark, sf_dir, "gcp").select(_string(c("id")).alias("path"), _text("WGS84 UTM ", _string(c("id") % 60 + 1), "N\n", _string(c("id") * 1000), " ", _string(c("id") * 10), "\n1 2 3").alias("text"))
    own = spark.createDataFrame([("own", "\n".join(K.coords_lines("EPSG:32616", 500000, 4000000)))], "path string, text string")
    return T.parse_coords(g.unionByName(own))


@query("SELECT ord, filename, CASE WHEN ord % 3 = 0 THEN 'RGB' ELSE band_name END AS band_name, 0.85::DOUBLE AS focal_ratio, 1 AS orientation, latitude FROM photos")
def photo_store(spark, sf_dir):
    """Photos written as a table of records and read again with their defaults."""
    p = domain(spark, sf_dir, "photos").select("filename", F.when(c("ord") % 3 != 0, c("band_name")).alias("band_name"), "latitude", c("ord").cast("int").alias("iso_speed"))
    folder = _folder(spark, "photos")
    C.write_photos(p, folder)
    return C.read_photos(spark, folder).select(c("iso_speed").cast("long").alias("ord"), "filename", "band_name", "focal_ratio", "orientation", "latitude")


@query("""
    SELECT CAST(capture AS STRING) AS path, filename, 'cam' || CAST(ord % 2 AS STRING) AS camera, CAST(ord AS DOUBLE) AS tz, 5.5::DOUBLE AS gps_dop, width FROM photos
""")
def reconstruction_text(spark, sf_dir):
    """The shots of reconstruction files, one a capture, with the width of their camera."""
    p = domain(spark, sf_dir, "photos").withColumn("camera", _text("cam", _string(c("ord") % 2)))
    shot = F.struct(F.array(lit(0.1), lit(0.2), lit(0.3)).alias("rotation"), F.array(lit(1.0), lit(2.0), c("ord").cast("double")).alias("translation"), c("filename").alias("camera"), lit(5.5).alias("gps_dop"))
    camera = F.struct(lit(0.85).alias("focal"), "width", "height")
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    lla = F.struct(lit(44.5).alias("latitude"), lit(-85.5).alias("longitude"), lit(0.0).alias("altitude"))
    scene = F.struct(lla.alias("reference_lla"), entries(c("filename"), camera).alias("cameras"), entries(c("filename"), shot).alias("shots"))
    files = p.groupBy(_string(c("capture")).alias("path")).agg(F.to_json(F.array(scene)).alias("text"))
    cameras, shots, _ = T.parse_reconstruction(files)
    joined = shots.withColumnRenamed("camera", "key").join(cameras.select("path", c("camera").alias("key"), "width"), ["path", "key"])
    order = c("path").cast("long") * 5 + F.regexp_extract("filename", r"_(\d+)_(\d)", 2).cast("long") - 1  # the name cuts long capture numbers
    return joined.select("path", "filename", _text("cam", _string(order % 2)).alias("camera"), F.get("translation", lit(2)).alias("tz"), "gps_dop", "width")


@query("SELECT CAST(id AS STRING) AS path, id * 7 AS vertex_count, id % 2 = 0 AS has_normals, id % 3 = 0 AS has_views, CAST(2 + 3 * CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) AS INT) AS n FROM submodels")
def ply_headers(spark, sf_dir):
    """What the headers of mesh and cloud files say."""
    s, n = domain(spark, sf_dir, "submodels"), c("id")
    normals = F.when(n % 2 == 0, "property float nx\nproperty float ny\nproperty float nz\n").otherwise("")
    views = F.when(n % 3 == 0, "property uchar views\n").otherwise("")
    text = _text("ply\nformat ascii 1.0\ncomment made here\nelement vertex ", _string(n * 7), "\nproperty float x\nproperty float y\n", normals, views, "end_header\n1 2\n")
    return T.parse_ply_header(s.select(_string(n).alias("path"), text.alias("text"))).select("path", "vertex_count", "has_normals", "has_views", F.size("properties").alias("n"))


@query("""
    WITH g AS (SELECT CAST(capture // 100 AS STRING) AS path, filename AS name, 'epoch' || CAST(capture AS STRING) AS "group" FROM photos WHERE ord % 13 <> 0)
    SELECT path, name, "group", count(*) OVER (PARTITION BY path, "group") = 5 AS whole FROM g
""")
def group_lists(spark, sf_dir):
    """Lists of images and their groups, and the groups all of whose files are there."""
    p = domain(spark, sf_dir, "photos").filter("ord % 13 <> 0").select(F.floor(c("capture") / 100).alias("file"), "ord", _text(c("filename"), " epoch", _string(c("capture"))).alias("line"))
    found = T.parse_groups(texts_by(p, "file", "line", "ord", sep="\n\n"))
    full = T.complete_groups(found.withColumn("key", F.concat_ws("/", "path", "group")), "key", 5)
    return found.withColumn("key", F.concat_ws("/", "path", "group")).join(full.withColumn("whole", lit(True)), "key", "left").select("path", "name", "group", F.coalesce("whole", lit(False)).alias("whole"))


@query("SELECT CAST(track AS STRING) AS path, x, y, z FROM fixes")
def waypoint_lists(spark, sf_dir):
    """Places of waypoint files."""
    f = domain(spark, sf_dir, "fixes").withColumn("line", F.concat_ws("  ", *(_string(c(k)) for k in "xyz")))
    return T.parse_waypoints(texts_by(f, "track", "line", "id")).select("path", "x", "y", "z")


@query("SELECT id, lower(hex(encode('raw' || CAST(id AS STRING)))) AS raw, CAST(id % 90 AS DOUBLE) - 40.5 AS reflected, CAST(id % 7 AS DOUBLE) AS distance FROM pixels")
def thermal_metadata(spark, sf_dir):
    """Binary fields and numbers with units of a metadata document."""
    p = domain(spark, sf_dir, "pixels").select("id", ((c("id") % 90).cast("double") - 40.5).alias("r"), (c("id") % 7).alias("d"))
    raw = F.base64(_text("raw", _string(c("id"))).cast("binary"))
    document = _text('[{"RawThermalImage":"base64:', raw, '","ReflectedApparentTemperature":"', _string(c("r")), ' C","ObjectDistance":"', _string(c("d")), ' m"}]')
    field = lambda k: X.temperature(F.get_json_object("j", f"$[0].{k}"))
    return p.withColumn("j", document).select("id", F.lower(F.hex(C.decoded_field(c("j"), "RawThermalImage"))).alias("raw"), field("ReflectedApparentTemperature").alias("reflected"), field("ObjectDistance").alias("distance"))


@query("""
    SELECT * FROM (VALUES ('rules', 'pc_classify', 'True'), ('rules', 'skip_3dmodel', 'True'), ('rules', 'crop', '0.01'), ('rules', 'smrf_slope', '0.2'), ('rules', 'smrf_window', '18.0'), ('rectify', 'plan', 'median'), ('rectify', 'extend_plan', 'surrounding'),
    ('rectify', 'threshold', '5.0'), ('rectify', 'distance', '5.0'), ('rectify', 'min_area', '750.0'), ('rectify', 'min_points', '500'), ('frames', 'blur', '200.0'), ('frames', 'distance', '10.0'), ('frames', 'black', '0.98'),
    ('text', 'test', '1'), ('file', 'test', '2'), ('dem', 'PREDICTOR', '3'), ('orthophoto', 'PREDICTOR', '2'), ('orthophoto', 'BLOCKXSIZE', '512'), ('submodel', 'crop', '0.015625'), ('submodel', 'max', '1')) AS v("set", name, value)
""")
def option_rules(spark, sf_dir):
    """Options with the rules that follow from them, defaults and files."""
    chosen = L.options({"dtm": True, "fast_orthophoto": True, "cutline": True, "crop": 0}, {"smrf_slope": 0.2})
    rows = [("rules", k, chosen[k]) for k in ("pc_classify", "skip_3dmodel", "crop", "smrf_slope", "smrf_window")]
    rows += [("rectify", k, v) for k, v in L.RECTIFY.items()] + [("frames", k, v) for k, v in (("blur", V.BLUR), ("distance", V.DISTANCE), ("black", V.BLACK))]
    rows += [("text", k, v) for k, v in L.path_or_json(' {"test": "1"} ', lambda p: "").items()] + [("file", k, v) for k, v in L.path_or_json("a.json", lambda p: '{"test": "2"}').items()]
    rows += [("dem", "PREDICTOR", C.RASTER_OPTIONS["dem"]["PREDICTOR"]), *(("orthophoto", k, C.RASTER_OPTIONS["orthophoto"][k]) for k in ("PREDICTOR", "BLOCKXSIZE"))]
    rows += [("submodel", k, v) for k, v in L.submodel_options({"crop": 0, "gcp": "a"}, {"max": 1}, ["gcp"]).items()]
    return spark.createDataFrame([(a, b, str(v)) for a, b, v in rows], "`set` string, name string, value string")


# ---- writers -----------------------------------------------------------------


@query("""
    SELECT 'gcp' AS kind, '{"type":"Feature","properties":{"filename":"' || filename || '","px":' || CAST(px AS STRING) || ',"py":' || CAST(py AS STRING) || '},"geometry":{"type":"Point","coordinates":[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || ',' || CAST(z AS STRING) || ']}}' AS value FROM gcp
    UNION ALL SELECT 'shot', '{"type":"Feature","properties":{"filename":"' || filename || '","width":' || CAST(width AS STRING) || '},"geometry":{"type":"Point","coordinates":[' || CAST(width / 8 AS STRING) || ',' || CAST(height / 8 AS STRING) || ',' || CAST(coalesce(altitude, 0) AS STRING) || ']}}' FROM photos
""")
def feature_files(spark, sf_dir):
    """K4, K5: ground control and shots as features, one a line."""
    shots = domain(spark, sf_dir, "photos").select("filename", "width", (c("width") / 8).alias("longitude"), (c("height") / 8).alias("latitude"), "altitude")
    kinds = {"gcp": K.gcp_geojson(domain(spark, sf_dir, "gcp")), "shot": K.shots_geojson(shots, ["filename", "width"])}
    return functools.reduce(DataFrame.unionByName, (K.feature_lines(df).select(lit(k).alias("kind"), "value") for k, df in kinds.items()))


@query("SELECT x, y, z FROM points")
def xyz_files(spark, sf_dir):
    """K8: a cloud as a table of three columns, written and read again."""
    folder = _folder(spark, "xyz")
    K.write_xyz(domain(spark, sf_dir, "points"), folder)
    return spark.read.option("header", "true").schema("x double, y double, z double").csv(folder)


@query("SELECT '3-' || CAST(CAST(floor(x / 25) AS BIGINT) AS STRING) || '-' || CAST(CAST(floor(y / 25) AS BIGINT) AS STRING) || '-' || CAST(CAST(floor(z / 25) AS BIGINT) AS STRING) AS node, count(*) AS n, max(z) AS z FROM points GROUP BY 1")
def octree_folders(spark, sf_dir):
    """A cloud in folders of octree cells."""
    folder = _folder(spark, "octree")
    K.write_octree(domain(spark, sf_dir, "points").select("x", "y", "z"), folder, 200.0, 3)
    return spark.read.parquet(folder).groupBy("node").agg(F.count("*").alias("n"), F.max("z").alias("z"))


@query("SELECT id, CAST(floor(red / 255 * 65535) AS INT) AS wide, 0.25 + id % 3 AS u, 1 - ((1 - 0.5) * 128 + 64) / 1024 AS v FROM pixels")
def wide_colours(spark, sf_dir):
    """Colours of 16 bits, and texture places in a packed image."""
    p = domain(spark, sf_dir, "pixels")
    u, v = K.packed_uv(lit(0.0), lit(0.5), (c("id") % 3 + 0.25) * 1024, lit(64.0), lit(128.0), lit(128.0), lit(1024.0), lit(1024.0))
    return p.select("id", X.to_16bit(c("red")).alias("wide"), u.alias("u"), v.alias("v"))


@query("SELECT strftime(make_timestamp(CAST(avg(epoch_ms(taken)) AS BIGINT) // 1000 * 1000000), '%Y:%m:%d %H:%M:%S') AS datetime, 'skysurvey' AS software FROM photos")
def raster_stamps(spark, sf_dir):
    """The tags of a finished raster."""
    p = domain(spark, sf_dir, "photos").select(F.unix_millis(c("taken").cast("timestamp")).cast("double").alias("utc_time"))
    return C.raster_tags(p, "skysurvey")


@query("""
    SELECT CAST(id // 100 AS STRING) AS path, 0 AS part, '' AS material, id % 100 + 1 AS place, format('v {:.6f} {:.6f} 1.500000', CAST(row AS DOUBLE), CAST(col AS DOUBLE)) AS line FROM pixels
    UNION ALL SELECT CAST(id // 100 AS STRING), 1, '', id % 100 + 1, 'vt 0.500000 0.250000' FROM pixels
    UNION ALL SELECT DISTINCT CAST(id // 100 AS STRING), 2, 'm' || CAST(id % 2 AS STRING), -1, 'usemtl m' || CAST(id % 2 AS STRING) FROM pixels WHERE id % 3 = 0
    UNION ALL SELECT CAST(id // 100 AS STRING), 2, 'm' || CAST(id % 2 AS STRING), NULL, 'f 1/' || CAST(id % 5 + 1 AS STRING) || ' 2/1 3/1' FROM pixels WHERE id % 3 = 0
""")
def mesh_rewrite(spark, sf_dir):
    """Meshes read and written again, faces under their material."""
    p = domain(spark, sf_dir, "pixels").withColumn("file", F.floor(c("id") / 100))
    face = F.format_string("\nusemtl m%d\nf 1/%d 2/1 3/1", c("id") % 2, c("id") % 5 + 1)
    line = F.concat(F.format_string("v %d %d 1.5\nvt 0.5 0.25\n# note", c("row"), c("col")), F.when(c("id") % 3 == 0, face).otherwise(""))
    vertices, places, faces = T.parse_obj(texts_by(p.withColumn("line", line), "file", "line", "id"))
    return C.obj_lines(vertices, places, faces).withColumn("place", F.when(c("line").startswith("f "), lit(None)).otherwise(c("place")))


@query("""
    WITH i AS (SELECT CAST(capture // 100 AS STRING) AS path, ord, row_number() OVER (PARTITION BY capture // 100 ORDER BY ord) - 1 AS place FROM photos)
    SELECT path, CAST(place + 3 AS INT) AS line_no, 'img' || CAST(ord AS STRING) || '.jpg 0.5 ' || CAST(ord AS STRING) AS line FROM i UNION ALL SELECT path, 0, 'NVM_V3' FROM i GROUP BY path UNION ALL SELECT path, 1, '' FROM i GROUP BY path UNION ALL SELECT path, 2, CAST(count(*) AS STRING) FROM i GROUP BY path
""")
def nvm_rewrite(spark, sf_dir):
    """The images of scene files under new names."""
    p = domain(spark, sf_dir, "photos").withColumn("file", F.floor(c("capture") / 100)).withColumn("filename", _in_folder(c("ord"), c("filename")))
    n = p.groupBy(_string(c("file")).alias("path")).agg(F.count("*").alias("n"))
    files = texts_by(p.withColumn("line", F.concat_ws(" ", "filename", lit("0.5"), _string(c("ord")))), "file", "line", "ord").join(n, "path")
    images = T.parse_nvm(files.select("path", _text("NVM_V3\n\n", _string(c("n")), "\n", c("text"), "\n0\n").alias("text")))
    renamed = p.select("filename", _text("img", _string(c("ord")), ".jpg").alias("new_name"))
    return K.nvm_lines(images, renamed).select("path", c("line_no").cast("int").alias("line_no"), "line")


@query("""
    SELECT lower(concat_ws(' ', make, model)) AS camera, CAST(max(width) AS DOUBLE) AS width, 0.5::DOUBLE AS k1, 0.25::DOUBLE AS k1_prior, CAST(NULL AS DOUBLE) AS k9 FROM photos GROUP BY 1
""")
def camera_document(spark, sf_dir):
    """All camera models in one document; known values without the suffix of priors, then some as priors again."""
    values = F.create_map(lit("width"), F.max("width").cast("double"), lit("k1_prior"), lit(0.5), lit("k9"), lit(3.0))
    models = domain(spark, sf_dir, "photos").groupBy(F.lower(F.concat_ws(" ", "make", "model")).alias("camera")).agg(values.alias("v"))
    models = models.select("camera", K.camera_fields(c("v"), ["width", "k1"]).alias("v")).withColumn("v", K.camera_priors(c("v"), ["k1"]))
    models = models.select("camera", *(F.try_element_at("v", lit(k)).alias(k) for k in ("width", "k1", "k1_prior", "k9"))).withColumn("k1_prior", c("k1_prior") / 2)
    back = F.from_json("cameras", "map<string, struct<width: double, k1: double, k1_prior: double, k9: double>>")
    return K.cameras_json(models).select(F.explode(back).alias("camera", "v")).select("camera", "v.*")


@query("""
    WITH a AS (SELECT ord, abs(latitude) AS v FROM photos), d AS (SELECT ord, v, floor(v) AS d FROM a), m AS (SELECT ord, v, d, floor((v - d) * 60) AS m FROM d)
    SELECT ord, CAST(d AS BIGINT) AS degrees, CAST(m AS BIGINT) AS minutes, round(CAST(round((v - d - m / 60) * 3600 * 100000) AS DOUBLE) / 100000, 3) AS seconds FROM m
""")
def exif_stamps(spark, sf_dir):
    """Positions as rationals, read back as numbers."""
    text = K.exif_rationals(c("latitude"))
    parts = F.transform(F.split(text, " "), P.rational)
    return domain(spark, sf_dir, "photos").withColumn("p", parts).select("ord", c("p")[0].cast("long").alias("degrees"), c("p")[1].cast("long").alias("minutes"), F.round(c("p")[2], 3).alias("seconds"))


# ---- photos ------------------------------------------------------------------


@query("""
    SELECT ord, CAST(ord % 90 AS DOUBLE) + CAST(ord % 60 AS DOUBLE) / 60 AS unsigned_degrees, coalesce(CASE WHEN ord % 2 = 0 THEN 'b' END, 'c') AS tag, 'IMG_' || lpad(CAST(capture AS STRING), 6, '0') AS capture, CASE band_index WHEN 0 THEN 'Red' WHEN 3 THEN 'NIR' ELSE CAST(band_index + 1 AS STRING) END AS band,
           coalesce(CASE WHEN std_xy IS NOT NULL AND std_z IS NOT NULL THEN greatest(std_xy, std_z) END, 0.75) * 2 AS rtk, band_name = 'NIR' AS thermal, band_name = 'Red' AS colour, (ord % 10 + 20) / 2 AS dark, CAST(ord % 100 AS DOUBLE) / 65535 AS sun, coalesce(std_xy, 0) AS dls
    FROM photos
""")
def photo_tags(spark, sf_dir):
    """Positions without a reference, tags under several names, bands in file names, deviations and light sensors."""
    o, none = c("ord"), lit(None).cast("string")
    tags = F.map_filter(F.create_map(lit("x:b"), F.when(o % 2 == 0, "b"), lit("x:c"), lit("c")), lambda k, v: v.isNotNull())
    named = P.filename_band(F.regexp_replace("filename", "tif$", "jpg"), {"1": "Red", "4": "NIR"})
    band = F.when(c("band_name") == "NIR", "LWIR").when(c("band_name") == "Red", "RedGreenBlue").otherwise(c("band_name"))
    return domain(spark, sf_dir, "photos").select(
        "ord", P.dms_to_decimal((o % 90).cast("double"), (o % 60).cast("double"), lit(0.0), none).alias("unsigned_degrees"), P.first_tag(tags, ["x:a", "x:b", "x:c"]).alias("tag"), named["capture"].alias("capture"), named["band"].alias("band"),
        P.rtk_stddev(c("std_xy"), c("std_z"), lit(0.75)).alias("rtk"), P.is_thermal(band, c("make"), c("model")).alias("thermal"), P.is_rgb(band).alias("colour"), P.dark_level(_text(_string(o % 10), " 20")).alias("dark"),
        P.sun_sensor((o % 100).cast("double")).alias("sun"), P.dls_pose(lit(1.0), c("std_xy"), lit(2.0))[1].alias("dls"),
    )


@query("""
    WITH p AS (SELECT ord, ord % 5 = 0 AS masked, CASE WHEN ord % 4 = 0 THEN 'fisheye' ELSE 'brown' END AS proj, CASE WHEN ord % 7 = 0 THEN NULL ELSE pitch END AS pitch, ord % 3 = 0 AS blank FROM photos)
    SELECT ord, NOT masked AND (proj = 'fisheye' OR pitch IS NULL OR abs(pitch) > 20) AND NOT blank AS sky, NOT masked AND NOT blank AS background FROM p
""")
def mask_candidates(spark, sf_dir):
    """Photos that need masks."""
    o = c("ord")
    mask, projection = F.when(o % 5 == 0, "m.png"), F.when(o % 4 == 0, "fisheye").otherwise("brown")
    name, pitch = F.when(o % 3 == 0, "a b.jpg").otherwise("ab.jpg"), F.when(o % 7 != 0, c("pitch"))
    return domain(spark, sf_dir, "photos").select("ord", P.needs_sky_mask(mask, projection, pitch, name).alias("sky"), P.needs_background_mask(mask, name).alias("background"))


@query("""
    SELECT ord, make AS camera, CASE WHEN ord % 3 <> 0 THEN latitude END AS latitude, CASE WHEN ord % 3 <> 0 THEN coalesce(altitude, 0) END AS altitude, CASE WHEN ord % 3 <> 0 THEN coalesce(std_xy, 10) END AS dop, CASE WHEN ord % 3 <> 0 AND std_z IS NOT NULL THEN std_z * 100 + 1 END AS first_speeds FROM photos
""")
def reconstruction_input(spark, sf_dir):
    """What is handed to reconstruction; speeds in the order y, x, z."""
    there = c("ord") % 3 != 0
    out = P.sfm_export(F.when(there, c("latitude")), c("longitude"), c("altitude"), c("std_xy"), lit(1.0), c("std_z"), lit(3.0), c("make"))
    return domain(spark, sf_dir, "photos").withColumn("s", out).select("ord", "s.camera", "s.gps.latitude", "s.gps.altitude", "s.gps.dop", (c("s.speed")[0] * 100 + c("s.speed")[1]).alias("first_speeds"))


# ---- places ------------------------------------------------------------------


@query("""
    SELECT 'WGS84 UTM 16N' AS srs, 'EPSG:32616' AS code, 609865.708 AS x, 4950688.362 AS y UNION ALL SELECT '+proj=utm +zone=16', 'EPSG:32616', 609865.708, 4950688.362 UNION ALL SELECT 'EPSG:32748', 'EPSG:32748', NULL, NULL UNION ALL SELECT 'EPSG:4326', 'EPSG:4326', -85.613, 44.701
    UNION ALL SELECT 'EPSG:3857', 'EPSG:3857', round(-85.61322729531112::DOUBLE * 20037508.342789244::DOUBLE / 180, 3), round(ln(tan((90 + 44.701151842605441::DOUBLE) * pi() / 360)) * 6378137, 3) UNION ALL SELECT 'EPSG:2251', 'EPSG:2251', 609925.818, 4950688.772
""")
def reference_systems(spark, sf_dir):
    """One place under the systems that files state, and a state-plane place in feet."""
    lon, lat = lit(-85.61322729531112), lit(44.701151842605441)
    rows = []
    for text in ("WGS84 UTM 16N", "+proj=utm +zone=16", "EPSG:32748", "EPSG:4326", "EPSG:3857", "EPSG:2251"):
        srs = G.parse_srs(text)
        if srs.kind == "michigan_feet":
            place = G.transform(srs, G.parse_srs("EPSG:32616"), lit(26607594.75468351), lit(-26813.882366498266))
        else:
            place = G.transform(G.parse_srs("EPSG:4326"), srs, lon, lat)
        near = F.lit(text != "EPSG:32748")  # the place is outside of that zone
        rows.append(spark.range(1).select(lit(text).alias("srs"), lit(G.srs_name(srs)).alias("code"), F.when(near, F.round(place["x"], 3)).alias("x"), F.when(near, F.round(place["y"], 3)).alias("y")))
    return functools.reduce(DataFrame.unionByName, rows)


@query("SELECT id, 0 - y + 500 AS x, x + 4000 AS y, z * 2 + 7 AS z, x * 100 AS pseudo_x, z * 100 AS pseudo_z FROM gcp")
def moved_places(spark, sf_dir):
    """Places under a 4 by 4 matrix, and without a georeference."""
    moved = G.affine([0, -1, 0, 500, 1, 0, 0, 4000, 0, 0, 2, 7, 0, 0, 0, 1], c("x"), c("y"), c("z"))
    pseudo = G.pseudo_place(c("x"), c("y"), c("z"))
    g = domain(spark, sf_dir, "gcp").withColumn("m", moved).withColumn("p", pseudo)
    return g.select("id", "m.x", "m.y", "m.z", F.round("p.x", 6).alias("pseudo_x"), F.round("p.z", 6).alias("pseudo_z"))


@query("SELECT 'a.jpg' AS filename, '609,865.708' AS x, '4,950,688.362' AS y, '0.000' AS z, -85.613227 AS lon, 44.701152 AS lat")
def utm_listings(spark, sf_dir):
    """A listing of photos in one zone, and a scene's origin back in degrees."""
    photos = spark.createDataFrame([("a.jpg", -85.61322729531112, 44.701151842605441, None)], "filename string, longitude double, latitude double, altitude double")
    lon, lat = C.reference_place(16, False, 609865.7077054137, 4950688.361817497)
    return C.utm_listing(photos, 16).select("*", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""
    WITH RECURSIVE t(w, h, n) AS (SELECT 5000, 3000, 0 UNION ALL SELECT w // 2, h // 2, n + 1 FROM t WHERE w > 256 OR h > 256),
    s AS (SELECT max(n) OVER () - n AS tier, (w + 255) // 256 AS cols, (h + 255) // 256 AS rows FROM t)
    SELECT CAST(tier AS INT) AS tier, CAST(cols AS INT) AS cols, CAST(rows AS INT) AS rows, CAST(coalesce(sum(cols * rows) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS first FROM s
""")
def zoomify_levels(spark, sf_dir):
    """G24."""
    return spark.createDataFrame(G.zoomify_tiers(5000, 3000), "tier int, cols int, rows int, first int")


@query("""
    WITH w AS (SELECT id, CAST(trunc(id % 40 - 10 + 0.001) AS INT) AS rx, 20 AS rw FROM pixels), b AS (SELECT id, rx, greatest(0, -rx) AS before, rw, CASE WHEN rx < 0 THEN CAST(floor(256 * (greatest(0, -rx) / rw::DOUBLE)) AS INT) ELSE 0 END AS wx FROM w)
    SELECT id, greatest(rx, 0) AS rx, CASE WHEN greatest(rx, 0) + rw - before > 35 THEN 35 - greatest(rx, 0) ELSE rw - before END AS rw, wx,
           CASE WHEN greatest(rx, 0) + rw - before > 35 THEN CAST(floor((256 - wx) * ((35 - greatest(rx, 0)) / (rw - before)::DOUBLE)) AS INT) ELSE 256 - wx END AS ww FROM b
""")
def clipped_windows(spark, sf_dir):
    """Windows of a raster, clipped to it."""
    west = (c("id") % 40 - 10).cast("double")
    w = G.clip_window(lit(0.0), lit(100.0), west, lit(100.0), west + 20, lit(80.0), lit(1.0), 35, 100, 256)
    return domain(spark, sf_dir, "pixels").withColumn("w", w).select("id", "w.rx", "w.rw", "w.wx", "w.ww")


@query("""
    WITH g AS (SELECT CAST(floor(row * 4 / 8.0) AS BIGINT) AS row, CAST(floor(col * 4 / 8.0) AS BIGINT) AS col, avg(value) AS value FROM (SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, max(z) AS value FROM points GROUP BY 1, 2) AS d GROUP BY 1, 2)
    SELECT row, col, round(value, 6) AS value FROM g
""")
def reprojected_raster(spark, sf_dir):
    """A raster in another grid of its system."""
    d = R.grid_max(domain(spark, sf_dir, "points"), 4.0).select("row", "col", "value")
    utm = G.Srs("mercator")
    return C.reprojected(d, 4.0, utm, utm, 8.0).withColumn("value", F.round("value", 6))


# ---- sensors, frames, clouds -------------------------------------------------


@query("""
    WITH p AS (SELECT id, raw, 21106.77::DOUBLE AS r1, 1501.0::DOUBLE AS b, -7340.0::DOUBLE AS o, 0.012545258::DOUBLE AS r2, 40/100.0 * exp(1.5587 + 0.06939*20 - 0.00027816*400 + 0.00000068455*8000) AS h2o FROM pixels),
    q AS (SELECT *, 1.9 * exp(-sqrt(25) * (0.006569 - 0.002276 * sqrt(h2o))) + (1 - 1.9) * exp(-sqrt(25) * (0.01262 - 0.00667 * sqrt(h2o))) AS tau, r1 / (r2 * (exp(b / 293.15) - 1)) - o AS air, r1 / (r2 * (exp(b / 303.15) - 1)) - o AS refl FROM p),
    w AS (SELECT *, raw / 0.95 / tau / tau - (1 - 0.95) / 0.95 * refl - (1 - tau) / 0.95 / tau * air - (1 - tau) / 0.95 / tau / tau * air AS obj FROM q)
    SELECT id, round(b / ln(r1 / (r2 * (obj + o)) + 1) - 273.15, 6) AS celsius FROM w
""")
def payload_celsius(spark, sf_dir):
    """Temperatures of one vendor's payload."""
    return domain(spark, sf_dir, "pixels").select("id", F.round(X.vendor_celsius(lit("DJI"), lit("MAVIC2-ENTERPRISE-ADVANCED"), c("raw"), lit(0.0), X.THERMAL), 6).alias("celsius"))


@query("""
    WITH l AS (SELECT min(red) AS low, max(span) AS span FROM (SELECT row, min(red) AS red, max(red) - min(red) AS span FROM pixels GROUP BY row) AS f), k AS (SELECT row, avg(CASE WHEN red < low + 0.30 * span THEN 1.0 ELSE 0 END) AS black FROM pixels, l GROUP BY row)
    SELECT row, round(black, 9) AS black, CASE WHEN 250 < 200 THEN 'blurry' WHEN black >= 0.2 THEN 'black' END AS verdict FROM k
""")
def dark_frames(spark, sf_dir):
    """The share of dark pixels of every frame against the recording's range."""
    p = domain(spark, sf_dir, "pixels").select("row", c("red").alias("value"))
    ends = p.groupBy("row").agg(F.min("value").alias("low"), (F.max("value") - F.min("value")).alias("span"))
    limit = ends.agg(V.absolute_black(F.min("low"), F.max("span")).alias("black_below"))
    return V.black_ratio(p, "row", limit).select("row", F.round("black", 9).alias("black"), V.early_verdict(lit(250.0), c("black"), black_limit=0.2).alias("verdict"))


@query("SELECT id, greatest(red, green) / 1400 AS resolution, greatest(red, green) / 1400 * sqrt(2) AS radius, round(red / 100 * 2, 9) AS third, round(0.05 * 4, 9) AS doubled FROM pixels")
def gridding_sizes(spark, sf_dir):
    """Sizes of the overlap diagram, and radii of gridding steps."""
    d = X.overlap_diagram(c("red"), c("green"))
    steps = X.radius_steps(c("red") / 100, 3)
    return domain(spark, sf_dir, "pixels").select("id", d["resolution"].alias("resolution"), d["radius"].alias("radius"), F.round(steps[2], 9).alias("third"), lit(round(C.radii(0.1, 3)[2], 9)).alias("doubled"))


@query("SELECT * FROM (VALUES ('quoted', '\"a\\\"b\\$c\"'), ('postfix', '/x/a_2.png'), ('moved', '/y/p_a.tif'), ('bare', 'a.las'), ('url', 'True'), ('no url', 'False')) AS v(name, value)")
def text_helpers(spark, sf_dir):
    """X30."""
    rows = [("quoted", C.shell_quoted('a"b$c')), ("postfix", C.related_path("/x/a.tif", postfix="_2", ext="png")), ("moved", C.related_path("/x/a.tif", prefix="p_", folder="/y")), ("bare", C.related_path("a.laz", ext=".las")), ("url", str(C.is_url("https://example.org/a"))), ("no url", str(C.is_url("a b")))]
    return spark.createDataFrame(rows, "name string, value string")


_HULL = [(20.0, 10.0), (150.0, 5.0), (180.0, 80.0), (30.0, 90.0)]
_HULL_SQL = " AND ".join(f"({bx} - {ax}) * (y - {ay}) - ({by} - {ay}) * (x - {ax}) >= -0.000000001" for (ax, ay), (bx, by) in zip(_HULL, [*_HULL[1:], _HULL[0]]))


@query(f"SELECT class, count(*) AS n, sum(z) AS z FROM points WHERE {_HULL_SQL} GROUP BY class")
def hull_members(spark, sf_dir):
    """points inside or on a convex ring."""
    return domain(spark, sf_dir, "points").filter(O.in_hull(c("x"), c("y"), _HULL)).groupBy("class").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


@query("""
    WITH v AS (SELECT id, track, CASE WHEN row_number() OVER (PARTITION BY track ORDER BY id) = 1 THEN 0 ELSE (id % 50 + 10) / 25 END AS own, first_value(CAST(id AS DOUBLE)) OVER (PARTITION BY track ORDER BY id) AS t0 FROM fixes)
    SELECT id, round(t0 + sum(own) OVER (PARTITION BY track ORDER BY id), 6) AS start, round(t0 + sum(own) OVER (PARTITION BY track ORDER BY id) + 50 / 25, 6) AS at FROM v
""")
def video_clock(spark, sf_dir):
    """Start times of the videos of each flight, and the time of a frame."""
    v = domain(spark, sf_dir, "fixes").select("id", "track", c("id").alias("ord"), c("id").cast("double").alias("file_time"), (c("id") % 50 + 10).alias("frames"), lit(25.0).alias("rate"))
    return V.video_starts(v, "track").select("id", F.round("start", 6).alias("start"), F.round(V.frame_time(lit(50), c("rate"), c("start")), 6).alias("at"))


@query("SELECT ord, filename FROM photos WHERE ord % 3 <> 0")
def remaining_photos(spark, sf_dir):
    """What is left of a set."""
    p = domain(spark, sf_dir, "photos").select("ord", "filename")
    return S.remaining(p, p.filter("ord % 3 = 0"), "ord")


@query("""
    SELECT 'point' AS kind, submodel || '_' || CAST(ord AS STRING) || '.' || CAST(line AS STRING) AS id, x FROM (SELECT DISTINCT submodel, ord, line, max(x) AS x FROM points GROUP BY ALL) AS p
    UNION ALL SELECT 'seen', submodel || '_' || CAST(ord AS STRING) || '.' || CAST(line AS STRING), 0 FROM (SELECT DISTINCT submodel, ord, line FROM points WHERE class = 2) AS q
""")
def merged_parts(spark, sf_dir):
    """Points of partial reconstructions under one reference, and the observations of known points."""
    p = domain(spark, sf_dir, "points").groupBy("submodel", "ord", "line").agg(F.max("x").alias("x"), F.max("class").alias("class"))
    parts = p.select(c("submodel").alias("part"), F.concat_ws(".", _string(c("ord")), _string(c("line"))).alias("id"), "x", lit(0.0).alias("y"), lit(0.0).alias("z"))
    seen = p.filter("class = 2").select(c("submodel").alias("part"), F.concat_ws(".", _string(c("ord")), _string(c("line"))).alias("track"), lit("a.jpg").alias("shot"))
    lost = seen.limit(1).withColumn("track", lit("nowhere"))
    references = p.select(lit(44.5).alias("latitude"), lit(-85.5).alias("longitude"), lit(0.0).alias("altitude"))
    points, kept = C.merged_reconstructions(parts, seen.unionByName(lost), references)
    return points.select(lit("point").alias("kind"), "id", "x").unionByName(kept.select(lit("seen").alias("kind"), c("track").alias("id"), lit(0.0).alias("x")))


@query("""
    SELECT ord, row_number() OVER (ORDER BY width DESC, filename) AS by_radius, row_number() OVER (ORDER BY CASE WHEN band_name = 'Green' THEN 0 ELSE 1 END, ord) AS primary_first, row_number() OVER (ORDER BY filename) AS by_name FROM photos
""")
def run_orders(spark, sf_dir):
    """Places of photos in the orders of runs: by falling size, the primary band first, and by name; equal ones by their number."""
    p = domain(spark, sf_dir, "photos").select("ord", "width", "filename", "band_name")
    p = C.in_order(p, {"radius": -c("width"), "name": c("filename"), "ord": c("ord")}, "by_radius")
    p = C.in_order(p, {"main": F.when(c("band_name") == "Green", 0).otherwise(1), "ord": c("ord")}, "primary_first")
    return C.in_order(p, {"name": c("filename"), "ord": c("ord")}, "by_name").select("ord", "by_radius", "primary_first", "by_name")


@query("SELECT * FROM (VALUES ('a', 0, 0, 80, 80), ('b', 40, 0, 80, 80), ('c', 0, 40, 80, 80), ('d', 30, 40, 80, 80), ('e', 60, 40, 80, 80)) AS v(name, x, y, width, height)")
def packed_blocks(spark, sf_dir):
    """Texture blocks in one image: right of the first, then below it."""
    places, width, height = C.packed([("e", 20, 20), ("c", 30, 40), ("d", 30, 30), ("a", 40, 40), ("b", 40, 40)])
    return spark.createDataFrame([(n, x, y, width, height) for n, (x, y) in places.items()], "name string, x int, y int, width int, height int")


@query("SELECT submodel, count(*) AS n, max(x) AS x FROM submodels GROUP BY submodel")
def submodel_steps(spark, sf_dir):
    """V7, V8: a step of plain Python for each submodel; the scheduler repeats failed ones."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"submodel": [frame["submodel"].iloc[0]], "n": [len(frame)], "x": [frame["x"].max()]})

    return L.per_submodel(domain(spark, sf_dir, "submodels").select("submodel", "x"), "submodel", step, "submodel int, n long, x double")


@query("SELECT ord, line, CAST(views AS SMALLINT) AS views, x AS \"Red\", y AS \"Blue\" FROM points")
def renamed_dimensions(spark, sf_dir):
    """The views dimension under its name, and band columns under theirs."""
    p = domain(spark, sf_dir, "points").select("ord", "line", c("views").cast("double").alias("scalar_views"), c("x").alias("band_1"), c("y").alias("band_2"))
    return C.renamed_bands(C.fixed_views(p), ["Red", "Blue"], 2)


@query("SELECT filename AS path, upper(filename) AS result, CASE WHEN ord % 256 > 127 THEN 255 ELSE 0 END AS mask FROM photos")
def outside_steps(spark, sf_dir):
    """An outside program run on bytes, and a mask from a model's bytes."""
    p = domain(spark, sf_dir, "photos").withColumn("path", _in_folder(c("ord"), c("filename")))
    done = C.external_step(p.select("path", c("filename").cast("binary").alias("content")), bytes.upper)
    masks = p.select("path", C.mask_threshold(c("ord") % 256).alias("mask"))
    return done.select("path", c("result").cast("string").alias("result")).join(masks, "path").withColumn("path", F.substring_index("path", "/", -1))


@query("""
    WITH q AS (SELECT 'one' AS plan, '0' AS part, count(*) AS n FROM points)
    SELECT * FROM q UNION ALL SELECT 'scene', CAST(CAST(floor((x - (SELECT min(x) FROM points)) / 50) AS BIGINT) AS STRING) || '/' || CAST(CAST(floor((y - (SELECT min(y) FROM points)) / 50) AS BIGINT) AS STRING), count(*) FROM points GROUP BY 2
""")
def cloud_parts(spark, sf_dir):
    """The whole cloud as one partition, and sub-scenes of one area."""
    p = domain(spark, sf_dir, "points")
    one = O.partition_plan(p, "one", (0, 0, 200, 100), 100, 50.0).groupBy("part").agg(F.count("*").alias("n"))
    scenes = C.sub_scenes(p, 2500.0).groupBy(F.concat_ws("/", _string(c("scene_col")), _string(c("scene_row"))).alias("part")).agg(F.count("*").alias("n"))
    return one.select(lit("one").alias("plan"), "part", "n").unionByName(scenes.select(lit("scene").alias("plan"), "part", "n"))


@query("""
    SELECT source, count(*) AS cells, CAST(sum(CASE WHEN alpha <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS opaque, avg(CASE WHEN alpha <> 0 THEN 1.0 ELSE 0 END) AS share, CAST(0 AS BIGINT) AS width, CAST(0 AS BIGINT) AS height FROM raster GROUP BY source
    UNION ALL SELECT 'all', 0, 0, 0, CAST(ceil((max(col + 1) * 4 - min(col) * 4) / 4.0) AS BIGINT), CAST(ceil((max(row + 1) * 4 - min(row) * 4) / 4.0) AS BIGINT) FROM raster
""")
def mosaic_frame(spark, sf_dir):
    """What is opaque of every source, and the frame that holds all of them."""
    r = domain(spark, sf_dir, "raster")
    box = r.groupBy("source").agg((F.min("col") * 4).alias("left"), (F.min("row") * 4).alias("bottom"), ((F.max("col") + 1) * 4).alias("right"), ((F.max("row") + 1) * 4).alias("top"), lit(4.0).alias("res")).withColumnRenamed("source", "ord")
    zero = lit(0).cast("long")
    shares = C.alpha_share(r, "source").select("source", "cells", "opaque", "share", zero.alias("width"), zero.alias("height"))
    return shares.unionByName(C.mosaic_extent(box).select(lit("all").alias("source"), zero.alias("cells"), zero.alias("opaque"), lit(0.0).alias("share"), c("width").cast("long").alias("width"), c("height").cast("long").alias("height")))


# ---- containers --------------------------------------------------------------

_DSM = "SELECT CAST(floor(y / 4) AS BIGINT) AS row, CAST(floor(x / 4) AS BIGINT) AS col, max(z) AS value FROM points GROUP BY 1, 2"


def _dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_max(domain(spark, sf_dir, "points"), 4.0).select("row", "col", "value")


@query(f"SELECT row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, 32616 AS epsg FROM ({_DSM}) AS d")
def geotiff_files(spark, sf_dir):
    """An elevation model in GeoTIFF tiles, read back with its system."""
    files = N.geotiff_tiles(_dsm(spark, sf_dir), 4.0, 32616, 16)
    return N.geotiff_cells(files).select("row", "col", "value", "epsg")


@query(f"""
    WITH d AS ({_DSM}), m AS (SELECT min(value) AS low, max(value) AS high FROM d)
    SELECT row, col, CAST(round_even((value - low) / (high - low) * 255, 0) AS INT) AS value FROM d, m
""")
def png_files(spark, sf_dir):
    """An elevation model as byte-scaled PNG tiles, decoded again."""
    d = _dsm(spark, sf_dir)
    ends = d.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    bytes_ = d.crossJoin(F.broadcast(ends)).select(lit(3).alias("z"), "row", "col", X.to_8bit(c("value"), c("low"), c("high")).alias("value"))
    ship(spark)

    def decode(batches):
        for frame in batches:
            for x, y, content in zip(frame["x"], frame["y"], frame["content"]):
                pixels = N.png_pixels(content)
                i, j = np.nonzero(pixels[:, :, 1])
                yield pd.DataFrame({"row": y * 16 + 15 - i, "col": x * 16 + j, "value": pixels[i, j, 0].astype(np.int32)})

    return N.png_tiles(bytes_, 16).select("x", "y", "content").mapInPandas(decode, "row long, col long, value int")


@query("SELECT 'ply' AS kind, x, y, z, red, views FROM (SELECT CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, red, CAST(views AS INT) AS views FROM points WHERE class = 2) AS p UNION ALL SELECT 'las', round(x, 3), round(y, 3), round(z, 3), red, NULL FROM points WHERE class <> 2")
def cloud_files(spark, sf_dir):
    """Points in PLY and LAS files, read by their type; the LAS files state their system."""
    ship(spark)
    cut = S.chunks(domain(spark, sf_dir, "points"), 20_000, ["class", "ord", "line", "x", "y", "z"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["class"].iloc[0] != 2:
            content = B.las_bytes(frame[["x", "y", "z", "red"]], epsg=32616)
            if B.las_header(content)["epsg"] != 32616:
                raise ValueError("the reference system is lost")
            return pd.DataFrame({"path": ["a.LAS"], "content": [content]})
        rows = np.zeros(len(frame), [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("views", "u1")])
        for k in rows.dtype.names:
            rows[k] = frame[k]
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n" + "".join(f"property {'float' if k in 'xyz' else 'uchar'} {k}\n" for k in rows.dtype.names) + "end_header\n"
        return pd.DataFrame({"path": ["a.ply"], "content": [head.encode() + rows.tobytes()]})

    files = cut.select("class", "chunk", "x", "y", "z", "red", "views").groupBy("class", "chunk").applyInPandas(pack, "path string, content binary")
    found = N.points_from_binary(files)
    las = c("views").isNull()
    near = lambda k: F.when(las, F.round(k, 3)).otherwise(c(k)).alias(k)
    return found.select(F.when(las, "las").otherwise("ply").alias("kind"), *map(near, "xyz"), "red", "views")


@query("SELECT CAST(id // 100 AS STRING) AS path, count(*) AS vertices, CAST(max(row) - min(row) AS DOUBLE) AS wide, (max(row) + min(row)) / 2 AS centre, CAST(3 * sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS corners FROM pixels GROUP BY 1")
def binary_meshes(spark, sf_dir):
    """Meshes as binary glTF about their centre."""
    p = domain(spark, sf_dir, "pixels").withColumn("path", _string(F.floor(c("id") / 100)))
    ship(spark)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame[["row", "col", "id"]].to_numpy(float)
        faces = np.array([[0, 1, 2]] * int((frame["id"] % 3 == 0).sum())).reshape(-1, 3)
        scene = N.glb_scene(N.glb_bytes(at, np.full((len(at), 2), 0.25), faces))
        one, _, three = scene["accessors"]
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "vertices": [one["count"]], "wide": [one["max"][0] - one["min"][0]], "centre": [scene["extensions"]["CESIUM_RTC"]["center"][0]], "corners": [three["count"]]})

    return p.select("path", "id", "row", "col").groupBy("path").applyInPandas(pack, "path string, vertices long, wide double, centre double, corners long")


@query("""
    WITH a AS (SELECT ord, latitude, abs(latitude) AS v FROM photos), m AS (SELECT ord, latitude, floor(v) AS d, floor((v - floor(v)) * 60) AS m FROM a)
    SELECT ord, CAST(CAST(d AS BIGINT) AS STRING) || '/1' AS degrees, CAST(CAST(m AS BIGINT) AS STRING) || '/1' AS minutes, CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END AS ref, '2024:01:02 03:04:05' AS time, 'skycam' AS make FROM m
""")
def stamped_frames(spark, sf_dir):
    """Frames with positions and times in their tags, read back."""
    p = domain(spark, sf_dir, "photos")
    refs = _text(F.when(c("latitude") < 0, "S").otherwise("N"), F.when(c("longitude") < 0, "W").otherwise("E"))
    frames = p.select(_string(c("ord")).alias("path"), F.unhex(lit("FFD8FFD9")).alias("content"), K.exif_rationals(c("latitude")).alias("latitude"), K.exif_rationals(c("longitude")).alias("longitude"), refs.alias("refs"), lit("2024:01:02 03:04:05").alias("time"), lit("skycam").alias("make"))
    found = B.with_image_metadata(N.with_stamps(frames))
    tag = lambda n: F.try_element_at("tags", lit(n))
    parts = F.split(tag("2"), ",")
    return found.select(c("path").cast("long").alias("ord"), parts[0].alias("degrees"), parts[1].alias("minutes"), tag("1").alias("ref"), tag("306").alias("time"), tag("271").alias("make"))


@query("SELECT '<gml:featureMember><gcp><filename>' || filename || '</filename><gml:Point><gml:coordinates>' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || ',' || CAST(z AS STRING) || '</gml:coordinates></gml:Point></gcp></gml:featureMember>' AS feature FROM gcp")
def gml_features(spark, sf_dir):
    """K4."""
    return N.gml_member(domain(spark, sf_dir, "gcp"))


@query("SELECT CAST(z AS INT) AS zoom, round(156543.03392804097::DOUBLE / pow(2, z), 9) AS resolution FROM range(3, 9) r(z)")
def tile_descriptions(spark, sf_dir):
    """The levels that a tile directory's description states."""
    text = N.tile_document("a", 3857, (0.0, 0.0, 1.0, 1.0), (3, 8), 156543.03392804097)
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.regexp_extract_all("t", lit(r'<TileSet ([^/]*)/>'), lit(1))).alias("s"))
    return rows.select(F.regexp_extract("s", r'order="(\d+)"', 1).cast("int").alias("zoom"), F.round(F.regexp_extract("s", r'units-per-pixel="([\d.]+)"', 1).cast("double"), 9).alias("resolution"))
