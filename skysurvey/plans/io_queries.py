"""Queries through the text and binary formats, frame selection and the sinks' columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skysurvey.functions import geodesy as G, sensor as X
from skysurvey.operators import sets as S
from skysurvey.plans.adapters import domain, oracle
from skysurvey.session import ship, table
from skysurvey.sources import binary as B, sinks as K, text as T
from skysurvey.streaming import frames as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same result."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = oracle(sql)
        return fn

    return add


def texts_by(df: DataFrame, path: str, line: str, order: str, head: str | None = None, sep: str = "\n") -> DataFrame:
    """One text a path, of a head and the lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c(order).alias("o"), c(line).alias("l")))), lambda r: r["l"]), sep)
    text = F.concat(F.lit(head + sep), body) if head else body
    return df.groupBy(c(path).cast("string").alias("path")).agg(text.alias("text"))


@query("SELECT CAST(survey AS STRING) AS path, 'WGS84 UTM 16N' AS srs, x, y, z, px, py, filename, concat('gcp', CAST(id AS STRING)) AS extras FROM gcp WHERE id % 10 <> 3")
def gcp_text(spark, sf_dir):
    """Ground control from texts with a mark, comments, blank lines and short lines."""
    g = domain(spark, sf_dir, "gcp")
    whole = F.concat_ws(" ", *(c(k).cast("string") for k in ("x", "y", "z", "px", "py")), "filename", F.concat(F.lit("gcp"), c("id").cast("string")))
    g = g.withColumn("line", F.when(c("id") % 10 == 3, F.concat(F.lit("# "), whole)).otherwise(F.concat(whole, F.when(c("id") % 4 == 0, "\n\n1 2 3").otherwise(""))))
    files = texts_by(g, "survey", "line", "id", "WGS84 UTM 16N")
    return T.parse_gcp(files).select("path", "srs", "x", "y", "z", "px", "py", "filename", "extras")


@query("""
    SELECT CAST(capture // 10 AS STRING) AS path, max_by(band_name, ord) AS filename, CAST(max(ord) AS DOUBLE) AS x, CAST(CASE WHEN max(ord) % 3 = 0 THEN NULL ELSE max(ord) % 360 END AS DOUBLE) AS yaw FROM photos GROUP BY capture // 10, band_name
""")
def geo_text(spark, sf_dir):
    """Positions from texts; the last line of a name wins, angles need all three."""
    p = domain(spark, sf_dir, "photos").withColumn("file", F.floor(c("capture") / 10))
    angles = F.when(c("ord") % 3 == 0, "NaN 0 0").otherwise(F.concat((c("ord") % 360).cast("string"), F.lit(" 0 0")))
    p = p.withColumn("line", F.concat_ws(" ", "band_name", c("ord").cast("string"), F.lit("1 2"), angles))
    return T.parse_geo(texts_by(p, "file", "line", "ord", "EPSG:4326")).select("path", "filename", "x", "yaw")


@query("""
    SELECT CAST(id // 500 AS STRING) AS path, CAST(id % 3600 AS DOUBLE) + 0.5 AS start_s, CAST(id % 3600 AS DOUBLE) + 1.25 AS end_s, CAST(100 + id % 300 AS INT) AS iso, CAST(60 + id % 100 AS DOUBLE) AS shutter,
           CAST(id % 90 AS DOUBLE) + 0.25 AS latitude, CAST(id % 180 AS DOUBLE) + 0.5 AS longitude, CAST(id % 500 AS DOUBLE) AS altitude FROM fixes
""")
def srt_text(spark, sf_dir):
    """Cues of four dialects."""
    f = domain(spark, sf_dir, "fixes")
    s = c("id") % 3600
    stamp = lambda frac: F.format_string(f"%02d:%02d:%02d,{frac}", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    late = F.format_string("%02d:%02d:%02d,250", F.floor((s + 1) / 3600), F.floor((s + 1) % 3600 / 60), (s + 1) % 60)
    one = F.format_string("[iso : %d] [shutter : 1/%d.0] [fnum : 280] [latitude: %d.25] [longitude: %d.5] [altitude: %d.0]", 100 + c("id") % 300, 60 + c("id") % 100, c("id") % 90, c("id") % 180, c("id") % 500)
    place = [100 + c("id") % 300, 60 + c("id") % 100, c("id") % 180, c("id") % 90, c("id") % 500]
    two = F.format_string("<font size=28>ISO:%d Shutter:%d GPS(%d.5,%d.25,%d) H 17.0m</font>", *place)
    three = F.format_string("F/6.3, ISO %d, SS %d, EV 0, RTK (%d.5, %d.25, %d), HOME (1.5, 2.5, 103.55m), D 75.36m, H 76.19m", *place)
    four = F.format_string("[iso : %d] [shutter : 1/%d.0] [longtitude : %d.5] [latitude : %d.25] [rel_alt: 0.300 abs_alt: %d.0]", *place)
    line = F.concat(c("id").cast("string"), F.lit("\n"), stamp("500"), F.lit(" --> "), late, F.lit("\n"), F.when(c("id") % 4 == 0, one).when(c("id") % 4 == 1, two).when(c("id") % 4 == 2, three).otherwise(four))
    files = texts_by(f.withColumn("line", line).withColumn("file", F.floor(c("id") / 500)), "file", "line", "id", sep="\n\n")
    return T.parse_srt(files).select("path", "start_s", "end_s", "iso", "shutter", "latitude", "longitude", "altitude")


@query("SELECT CAST(capture // 100 AS STRING) AS path, filename, CAST(ord AS STRING) AS rest FROM photos")
def nvm_text(spark, sf_dir):
    """S18, W7."""
    p = domain(spark, sf_dir, "photos").withColumn("file", F.floor(c("capture") / 100))
    n = p.groupBy(c("file").cast("string").alias("path")).agg(F.count("*").alias("n"))
    files = texts_by(p.withColumn("line", F.concat_ws(" ", "filename", c("ord").cast("string"))), "file", "line", "ord").join(n, "path")
    files = files.select("path", F.concat(F.lit("NVM_V3\n\n"), c("n").cast("string"), F.lit("\n"), "text", F.lit("\n0\n")).alias("text"))
    return T.parse_nvm(files).select("path", "filename", "rest")


@query("SELECT CAST(CAST(floor(id / 100) AS BIGINT) AS STRING) AS path, id % 100 + 1 AS id, CAST(row AS DOUBLE) AS x, CAST(col AS DOUBLE) AS y FROM pixels")
def obj_text(spark, sf_dir):
    """Vertices of mesh texts; comments and faces between them."""
    p = domain(spark, sf_dir, "pixels").withColumn("file", F.floor(c("id") / 100))
    line = F.concat(F.format_string("v %d %d 1.5\nvt 0.5 0.25\n# note", c("row"), c("col")), F.when(c("id") % 3 == 0, "\nusemtl m\nf 1/1 2/1 3/1").otherwise(""))
    vertices, _, _ = T.parse_obj(texts_by(p.withColumn("line", line), "file", "line", "id"))
    return vertices.select("path", c("id").cast("long").alias("id"), "x", "y")


@query("SELECT CAST(submodel AS STRING) AS path, max(x) AS x, count(*) AS n FROM submodels GROUP BY submodel")
def boundary_text(spark, sf_dir):
    """Rings of GeoJSON boundaries."""
    s = domain(spark, sf_dir, "submodels")
    ring = F.to_json(F.array(F.array_sort(F.collect_list(F.array("x", "y")))))
    files = s.groupBy(c("submodel").cast("string").alias("path")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}]}")).alias("text"))
    rings = T.parse_boundary(files)
    return rings.select("path", F.array_max(F.transform("ring", lambda p: p["x"])).alias("x"), F.size("ring").cast("long").alias("n"))


@query("SELECT submodel, count(*) AS n, round(sum(x), 3) AS x, sum(class) AS class, max(red) AS red FROM points GROUP BY submodel")
def las_round_trip(spark, sf_dir):
    """Points written as LAS files of bounded size and read back."""
    ship(spark)
    cut = S.chunks(domain(spark, sf_dir, "points"), 50_000, ["submodel", "ord", "line", "x", "y", "z"])
    p = cut.select("submodel", "chunk", "x", "y", "z", c("class").alias("classification"), "red", F.ascii("submodel").alias("point_source_id"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [B.las_bytes(frame)]})

    files = p.groupBy("submodel", "chunk").applyInPandas(pack, "content binary")
    back = B.las_from_binary(files).withColumn("submodel", F.char("point_source_id"))
    return back.groupBy("submodel").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.sum("classification").alias("class"), F.max("red").alias("red"))


@query("""
    WITH RECURSIVE f AS (SELECT track, ts, value, row_number() OVER (PARTITION BY track ORDER BY ts) AS rn FROM fixes WHERE value * 4 >= 20 AND id % 50 <> 0),
    g AS (SELECT track, ts, value, rn, value AS last, true AS kept FROM f WHERE rn = 1 UNION ALL SELECT f.track, f.ts, f.value, f.rn, CASE WHEN abs(f.value - g.last) >= 10 THEN f.value ELSE g.last END, abs(f.value - g.last) >= 10 FROM g JOIN f ON f.track = g.track AND f.rn = g.rn + 1)
    SELECT x.id, CASE WHEN x.value * 4 < 20 THEN 'blurry' WHEN x.id % 50 = 0 THEN 'black' WHEN g.kept THEN 'kept' ELSE 'similar' END AS verdict FROM fixes x LEFT JOIN g ON x.track = g.track AND x.ts = g.ts
""")
def frame_selection(spark, sf_dir):
    """V1, V2, W3."""
    f = domain(spark, sf_dir, "fixes").select("id", c("track").alias("video"), "ts", c("value").alias("feature"), (c("value") * 4).alias("blur"), F.when(c("id") % 50 == 0, 1.0).otherwise(0.1).alias("black"))
    return V.select_frames(f.withColumn("blur", c("blur") * 10), "video", "ts", "feature").select("id", "verdict")


@query("""
    WITH f AS (SELECT track, ts, lag(ts) OVER (PARTITION BY track ORDER BY ts) AS p FROM fixes), s AS (SELECT track, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY ts) AS k FROM f)
    SELECT track, count(*) AS n, epoch_us(min(ts)) AS start FROM s GROUP BY track, k
""")
def flight_sessions(spark, sf_dir):
    """Sessions of fixes; the same function runs on a stream."""
    f = domain(spark, sf_dir, "fixes").withColumn("ts", c("ts").cast("timestamp")).select("ts", "track")
    return V.stream_flights(f, "6 hours").select("track", "n", F.unix_micros("start").alias("start"))


@query("""
    SELECT ord, replace(CAST(CAST(ord % 1000 AS DOUBLE) / 8 AS STRING), '.', ',') AS score, concat('POLYGON((', CAST(CAST(ord AS DOUBLE) AS STRING), ' 0.0, ', CAST(CAST(ord AS DOUBLE) AS STRING), ' 1.0, 2.0 3.0, ', CAST(CAST(ord AS DOUBLE) AS STRING), ' 0.0))') AS wkt,
           concat_ws(chr(10), '2.0', '0.0', '0.0', '-2.0', CAST(CAST(ord AS DOUBLE) AS STRING), '7.0') AS world FROM photos
""")
def sink_columns(spark, sf_dir):
    """K6, K19, K20, K31."""
    p = domain(spark, sf_dir, "photos").withColumn("score", (c("ord") % 1000).cast("double") / 8)
    o = c("ord").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    ring = F.array(at(o, 0.0), at(o, 1.0), at(F.lit(2.0), 3.0))
    rows = p.select("ord", "score", K.ring_wkt(ring).alias("wkt"), K.world_file(F.lit(2.0), F.lit(0.0), o, F.lit(0.0), F.lit(-2.0), F.lit(7.0)).alias("world"))
    return K.decimal_commas(rows, ["score"])


@query("""
    SELECT lower(concat_ws(' ', make, model)) AS camera, min_by(width, ord) AS width, min_by(height, ord) AS height, CASE WHEN lower(concat_ws(' ', make, model)) = 'gopro hero8 black' THEN 0.7 ELSE 0.9 END AS focal FROM photos GROUP BY 1, 4
""")
def camera_overrides(spark, sf_dir):
    """Camera models by id, overridden by id or for all."""
    p = domain(spark, sf_dir, "photos").select("ord", F.lower(F.concat_ws(" ", "make", "model")).alias("camera"), "width", "height", F.lit(0.85).alias("focal"))
    given = spark.createDataFrame([("all", 0.9), ("gopro hero8 black", 0.7)], "camera string, focal double")
    return K.camera_models(p, given)


@query("SELECT id, x + 500000 AS x, y + 4000000 AS y, z, px / 2 AS px, py / 2 AS py FROM gcp")
def gcp_resized_copy(spark, sf_dir):
    """Pixel places at half size, and a translation."""
    g = K.gcp_resized(domain(spark, sf_dir, "gcp"), 0.5)
    moved = G.affine([1, 0, 0, 500000, 0, 1, 0, 4000000, 0, 0, 1, 0, 0, 0, 0, 1], c("x"), c("y"), c("z"))
    return g.withColumn("m", moved).select("id", c("m.x").alias("x"), c("m.y").alias("y"), c("m.z").alias("z"), "px", "py")


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def markup_fields(spark, sf_dir):
    """Text functions on markup: counts and first matches (string coverage of 2.12)."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""
    SELECT id, (red * (id % 9 - 4) + 5 * nir) / (0.001::DOUBLE * red + 1) AS x, floor((1 + red) / 256 * 65535) AS wide, CASE WHEN id % 2 = 0 THEN 1 - ((1 - 0.25::DOUBLE) * 128 + 64) / 1024 ELSE 0 END AS v FROM pixels
""")
def warped_pixels(spark, sf_dir):
    """R17, R28, X13, X29."""
    p = domain(spark, sf_dir, "pixels")
    h = F.array((c("id") % 9 - 4).cast("double"), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.001), F.lit(0.0), F.lit(1.0))
    _, v = K.packed_uv(F.lit(0.5), F.lit(0.25), F.lit(0.0), F.lit(64.0), F.lit(128.0), F.lit(128.0), F.lit(1024.0), F.lit(1024.0))
    return p.select("id", X.warp(h, c("red"), c("nir"))["x"].alias("x"), F.floor((1 + c("red")) / 256 * 65535).cast("double").alias("wide"), F.when(c("id") % 2 == 0, v).otherwise(0.0).alias("v"))
