"""Writers of survey formats: lines and JSON documents as columns, for any text or table sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skysurvey.functions.checks import checked
from skysurvey.functions.geodesy import Srs, transform


def gcp_lines(gcp: DataFrame, srs: str) -> DataFrame:
    """K3: the lines of a ground-control file, its system first."""
    text = F.format_string("%.6f %.6f %.3f %.2f %.2f %s", *(F.col(k).cast("double") for k in ("x", "y", "z", "px", "py")), F.col("filename"))
    extras = F.when(F.coalesce(F.col("extras"), F.lit("")) != "", F.concat(F.lit(" "), "extras")).otherwise("") if "extras" in gcp.columns else F.lit("")
    head = gcp.sparkSession.createDataFrame([(0, srs)], "place long, line string")
    return head.unionByName(gcp.select((F.monotonically_increasing_id() + 1).alias("place"), F.concat(text, extras).alias("line")))


def gcp_in_system(gcp: DataFrame, source: Srs, target: Srs) -> DataFrame:
    """K3: ground control in another system; heights stay."""
    return gcp.withColumn("_p", transform(source, target, F.col("x"), F.col("y"))).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")


def gcp_resized(gcp: DataFrame, ratio: float) -> DataFrame:
    """K3, C4: pixel places on resized images."""
    return gcp.withColumn("px", F.col("px") * ratio).withColumn("py", F.col("py") * ratio)


def resize_ratio(width: Column, height: Column, to: int | str) -> Column:
    """C4: to pixels of the longest side, or to a share as in '50%'."""
    if isinstance(to, str) and to.endswith("%"):
        return F.lit(float(to[:-1]) / 100)
    return F.lit(float(to)) / F.greatest(width, height)


def gcp_geojson(gcp: DataFrame) -> DataFrame:
    """K4: one feature a row."""
    point = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    return gcp.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("filename", "px", "py").alias("properties"), point.alias("geometry"))).alias("feature"))


def shots_geojson(shots: DataFrame, properties: Sequence[str]) -> DataFrame:
    """K5: shots as features of their positions."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", F.coalesce("altitude", F.lit(0.0))).alias("coordinates"))
    return shots.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))).alias("feature"))


def feature_lines(features: DataFrame) -> DataFrame:
    """K5: features as lines of a collection: newline-delimited GeoJSON, which needs no single task."""
    return features.select(F.col("feature").alias("value"))


def ring_wkt(ring: Column) -> Column:
    """A closed ring as WKT."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def ring_geojson(ring: Column) -> Column:
    """K6."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def extent_ring(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, width: Column, height: Column) -> Column:
    """The corners of a raster under its affine."""
    corner = lambda i, j: F.struct((a * i + b * j + c).alias("x"), (d * i + e * j + f).alias("y"))
    zero = F.lit(0.0)
    return F.array(corner(zero, zero), corner(width, zero), corner(width, height), corner(zero, height))


def world_file(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Six lines in the order a, d, b, e, c, f."""
    return F.concat_ws("\n", *(v.cast("string") for v in (a, d, b, e, c, f)))


def coords_lines(srs: str, east: int, north: int) -> list[str]:
    """K2: a system and its whole-number offsets."""
    return [srs, f"{east} {north}"]


def decimal_commas(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers with decimal commas, for a table separated by semicolons."""
    return df.select(*(F.translate(F.col(c).cast("string"), ".", ",").alias(c) if c in columns else F.col(c) for c in df.columns))


def write_frame_stats(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """K31."""
    decimal_commas(df, columns).write.option("sep", ";").option("header", "true").csv(path)


def write_xyz(points: DataFrame, path: str) -> None:
    """K8."""
    points.select("x", "y", "z").write.option("header", "true").csv(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile rows in folders of zoom and column."""
    tiles.repartition("z", "x").write.partitionBy("z", "x").parquet(path)


def write_octree(points: DataFrame, path: str, size: float, levels: int) -> None:
    """Points partitioned by the key of their octree cell."""
    cell = size / 2**levels
    key = F.concat_ws("-", F.lit(str(levels)), *(F.floor(F.col(k) / cell).cast("string") for k in "xyz"))
    points.withColumn("node", key).repartition("node").write.partitionBy("node").parquet(path)


def cameras_json(cameras: DataFrame) -> DataFrame:
    """One object of camera models by id; there are as many as different cameras."""
    rest = [c for c in cameras.columns if c != "camera"]
    return cameras.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("camera"), F.struct(*rest))))).alias("cameras"))


def camera_models(photos: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """A model for each camera id, overridden by id or by the id 'all'."""
    models = photos.groupBy("camera").agg(F.min_by(F.struct("width", "height", "focal"), "ord").alias("m")).select("camera", "m.*")
    if overrides is None:
        return models
    every = overrides.filter("camera = 'all'").select(F.col("focal").alias("_all")).limit(1)
    own = overrides.select("camera", F.col("focal").alias("_own"))
    joined = models.join(own, "camera", "left").join(F.broadcast(every), F.lit(True), "left")
    return joined.select("camera", "width", "height", F.coalesce("_own", "_all", "focal").alias("focal"))


def camera_fields(camera: Column, keep: Sequence[str]) -> Column:
    """a camera's whitelisted values, without the suffix of priors."""
    stripped = F.transform_keys(camera, lambda k, v: F.regexp_replace(k, "_prior$", ""))
    return F.map_filter(stripped, lambda k, v: k.isin(*keep))


def camera_priors(camera: Column, keys: Sequence[str]) -> Column:
    """a camera's values with a copy of some of them as priors."""
    prior = F.transform_keys(F.map_filter(camera, lambda k, v: k.isin(*keys)), lambda k, v: F.concat(k, F.lit("_prior")))
    return F.map_concat(camera, prior)


def nvm_lines(images: DataFrame, renamed: DataFrame) -> DataFrame:
    """An NVM file's lines with new image names; an error if one is missing; points are dropped."""
    joined = images.join(renamed, "filename", "left")
    body = joined.select("path", (F.col("place") + 3).alias("line_no"), checked(F.col("new_name").isNotNull(), F.concat_ws(" ", "new_name", "rest"), "an image has no new name").alias("line"))
    head = images.groupBy("path").agg(F.count("*").alias("n")).select("path", F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("NVM_V3").alias("line")), F.struct(F.lit(1).alias("line_no"), F.lit("").alias("line")), F.struct(F.lit(2).alias("line_no"), F.col("n").cast("string").alias("line")))).alias("h")).select("path", "h.*")
    return head.unionByName(body)


def packed_uv(u: Column, v: Column, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A texture place moved into its block of the packed image."""
    return (u * w + x) / width, 1 - ((1 - v) * h + y) / height


def exif_rationals(value: Column, scale: int = 100_000) -> Column:
    """Degrees, minutes and seconds as rationals."""
    size = F.abs(value)
    d, m = F.floor(size), F.floor((size - F.floor(size)) * 60)
    s = F.rint((size - d - m / 60.0) * 3600 * scale).cast("long")
    return F.format_string(f"%d/1 %d/1 %d/{scale}", d, m, s)


def run_log(stages: DataFrame) -> DataFrame:
    """Stages with their seconds and the running total."""
    took = F.unix_micros("ended") / F.lit(1e6) - F.unix_micros("started") / F.lit(1e6)
    w = Window.partitionBy("run").orderBy("started").rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("seconds", F.round(took, 2)).withColumn("total", F.round(F.sum(took).over(w), 2))
