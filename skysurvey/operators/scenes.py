"""Operators on whole scenes: photo sets, cameras and alignment, orthorectification, packing and cut lines."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skysurvey.functions import geodesy as G
from skysurvey.functions.checks import checked
from skysurvey.operators.raster import bilinear
from skysurvey.operators.sets import ranked
from skysurvey.session import ship


# ---- photo sets --------------------------------------------------------------

# Column names and defaults of the photos table, and options of raster files.
#: Columns of the photos table; nullable but for the defaults of band, orientation, projection and focal ratio.
PHOTO_SCHEMA = (
    "filename string, mask string, width int, height int, camera_make string, camera_model string, orientation int, latitude double, longitude double, altitude double, band_name string, band_index string, "
    "capture_uuid string, fnumber double, radiometric_calibration string, black_level string, gain double, gain_adjustment double, exposure_time double, iso_speed int, bits_per_sample int, "
    "vignetting_center string, vignetting_polynomial string, spectral_irradiance double, horizontal_irradiance double, irradiance_scale_to_si double, utc_time double, yaw double, pitch double, roll double, "
    "omega double, phi double, kappa double, sun_sensor double, dls_yaw double, dls_pitch double, dls_roll double, speed_x double, speed_y double, speed_z double, exif_width int, exif_height int, "
    "gps_xy_stddev double, gps_z_stddev double, camera_projection string, focal_ratio double"
)
PHOTO_DEFAULTS = {"band_name": "RGB", "band_index": "0", "orientation": 1, "camera_projection": "brown", "focal_ratio": 0.85}


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """The photos table from JSON, with its defaults."""
    return spark.read.schema(PHOTO_SCHEMA).json(path).fillna(PHOTO_DEFAULTS)


def write_photos(photos: DataFrame, path: str) -> None:
    """K1."""
    photos.write.json(path)


def overridden(photos: DataFrame, dop: float | None = None, projection: str | None = None, z_offset: float = 0.0) -> DataFrame:
    """Accuracy and projection for all photos, and a height offset; a missing height becomes the offset."""
    out = photos
    if dop is not None:
        out = out.withColumn("gps_xy_stddev", F.lit(dop)).withColumn("gps_z_stddev", F.lit(dop))
    if projection is not None and projection != "auto":
        out = out.withColumn("camera_projection", F.lit(projection))
    return out.withColumn("altitude", F.coalesce("altitude", F.lit(0.0)) + z_offset) if z_offset else out


def with_masks(photos: DataFrame, masks: DataFrame, photo_key: Column, mask_key: Column) -> DataFrame:
    """Photos with the mask of their base name."""
    named = masks.select(mask_key.alias("_k"), F.col("filename").alias("mask")).filter("_k IS NOT NULL").groupBy("_k").agg(F.min("mask").alias("mask"))
    return photos.withColumn("_k", photo_key).join(named, "_k", "left").drop("_k")


def ground_control_subset(gcp: DataFrame, files: DataFrame, least: int) -> DataFrame:
    """Entries whose image is among the files; none if fewer than ``least`` are left."""
    kept = gcp.join(files.select("filename"), "filename", "left_semi")
    enough = kept.agg((F.count("*") >= least).alias("_ok"))
    return kept.crossJoin(F.broadcast(enough)).filter("_ok").drop("_ok")


def epoch_shots(shots: DataFrame, epochs: DataFrame, epoch: str) -> DataFrame:
    """Shots of an epoch's images, by names up to the first dot."""
    base = F.substring_index("filename", ".", 1)
    own = epochs.filter(F.col("group") == epoch).select(F.substring_index("name", ".", 1).alias("_b")).distinct()
    return shots.withColumn("_b", base).join(own, "_b", "left_semi").drop("_b")


def merged_reconstructions(parts: DataFrame, observations: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of partial reconstructions, and the observations of their shots; an error unless all parts have one reference."""
    c = F.col
    one = references.agg(*(F.min(k).alias(f"_{k}0") for k in ("latitude", "longitude", "altitude")), *(F.max(k).alias(f"_{k}1") for k in ("latitude", "longitude", "altitude")))
    same = (c("_latitude0") == c("_latitude1")) & (c("_longitude0") == c("_longitude1")) & (c("_altitude0") == c("_altitude1"))
    one = one.select(same.alias("_same"))
    parts = parts.crossJoin(F.broadcast(one)).withColumn("part", checked(c("_same"), c("part"), "the partial reconstructions have different references"))
    points = parts.select(F.concat_ws("_", "part", "id").alias("id"), "x", "y", "z")
    kept = observations.select(F.concat_ws("_", "part", "track").alias("track"), "shot")
    return points, kept.join(points.select(F.col("id").alias("track")), "track", "left_semi")


def duplicated_masks(files: DataFrame, mask: str) -> DataFrame:
    """One mask under the base name of every file."""
    return files.select("filename", F.concat(F.regexp_replace("filename", r"\.[^.]+$", ""), F.lit("_mask."), F.substring_index(F.lit(mask), ".", -1)).alias("copy"), F.lit(mask).alias("source"))


def renamed_bands(raster: DataFrame, names: Sequence[str], expected: int = 7) -> DataFrame:
    """Band columns under known names, if there are as many as expected."""
    bands = [c for c in raster.columns if re.fullmatch(r"band_\d+", c)]
    return raster.withColumnsRenamed(dict(zip(bands, names))) if len(bands) == expected == len(names) else raster


def fixed_views(points: DataFrame) -> DataFrame:
    """The views dimension under its name, as a byte."""
    if "scalar_views" not in points.columns:
        raise ValueError("the cloud has no dimension scalar_views")
    return points.withColumnRenamed("scalar_views", "views").withColumn("views", F.col("views").cast("short"))


def utm_listing(photos: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Names with their place in one zone, three decimals."""
    u = G.to_utm(F.col("longitude"), F.col("latitude"), F.lit(zone), F.lit(south))
    return photos.withColumn("_u", u).select("filename", *(F.format_number(c, 3).alias(k) for c, k in ((F.col("_u.x"), "x"), (F.col("_u.y"), "y"), (F.coalesce("altitude", F.lit(0.0)), "z"))))


def reference_place(zone: int, south: bool, east: float, north: float) -> tuple[Column, Column]:
    """Longitude and latitude of a scene's origin."""
    p = G.from_utm(F.lit(float(east)), F.lit(float(north)), F.lit(zone), F.lit(south))
    return p["lon"], p["lat"]


def total_times(log: DataFrame) -> DataFrame:
    """Seconds of every run and the number of its stages."""
    return log.groupBy("run").agg(F.round((F.max(F.unix_micros("ended")) - F.min(F.unix_micros("started"))) / 1e6, 2).alias("seconds"), F.count("*").alias("stages"))


def raster_tags(photos: DataFrame, software: str) -> DataFrame:
    """One row of tags: the mean capture time and the software."""
    return photos.agg(F.date_format(F.timestamp_millis(F.avg("utc_time").cast("long")), "yyyy:MM:dd HH:mm:ss").alias("datetime"), F.lit(software).alias("software"))


#: Options of raster files (fixed values).
RASTER_OPTIONS = {"orthophoto": {"TILED": "YES", "COMPRESS": "DEFLATE", "PREDICTOR": "2", "BIGTIFF": "IF_SAFER", "BLOCKXSIZE": "512", "BLOCKYSIZE": "512"}, "dem": {"TILED": "YES", "COMPRESS": "DEFLATE", "PREDICTOR": "3", "BIGTIFF": "IF_SAFER"}}


def ascii_grid_rows(raster: DataFrame, frame: tuple[int, int, int, int], nodata: float = -9999.0) -> DataFrame:
    """(row, line) of an ASCII grid over rows and columns of a frame; one line a row, missing cells as no data."""
    r0, r1, c0, c1 = frame
    cells = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    rows = raster.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).groupBy("row").agg(cells.alias("m"))
    all_rows = raster.sparkSession.range(r0, r1 + 1).select(F.col("id").alias("row")).join(rows, "row", "left")
    value = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(nodata)).cast("string")
    return all_rows.select("row", F.array_join(F.transform(F.sequence(F.lit(c0).cast("long"), F.lit(c1).cast("long")), value), " ").alias("line"))


def window(raster: DataFrame, rows: tuple[int, int], cols: tuple[int, int], fill: float | None = None) -> DataFrame:
    """The cells of a window, with a fill value outside the raster (boundless) if given."""
    inside = raster.filter(F.col("row").between(*rows) & F.col("col").between(*cols)).select("row", "col", "value")
    if fill is None:
        return inside
    grid = raster.sparkSession.range(rows[0], rows[1] + 1).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(cols[0]).cast("long"), F.lit(cols[1]).cast("long"))))
    return grid.join(inside, ["row", "col"], "left").fillna({"value": fill})


def with_alpha(raster: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Alpha 0 where any band is missing, 255 elsewhere; missing in one band is missing in all."""
    whole = F.lit(True)
    for b in bands:
        whole = whole & F.col(b).isNotNull()
    return raster.select(*(c for c in raster.columns if c not in bands), *(F.when(whole, F.col(b)).alias(b) for b in bands), F.when(whole, 255).otherwise(0).alias("alpha"))


def reprojected(raster: DataFrame, size: float, source: G.Srs, target: G.Srs, target_size: float) -> DataFrame:
    """The mean of the cells whose centres fall into each cell of another system."""
    centre = G.transform(source, target, (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size)
    moved = raster.withColumn("_p", centre)
    return moved.groupBy(F.floor(F.col("_p.y") / target_size).alias("row"), F.floor(F.col("_p.x") / target_size).alias("col")).agg(F.avg("value").alias("value"))


def unwritten(tiles: DataFrame, existing: DataFrame) -> DataFrame:
    """Tiles that do not exist yet."""
    return tiles.join(existing.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def dem_points(raster: DataFrame, size: float, step: int) -> DataFrame:
    """Points of every step-th row and column of an elevation model."""
    kept = raster.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.select(((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"), F.col("value").alias("z"))


def radii(resolution: float, steps: int, factor: float = 2.0) -> list[float]:
    """Radii of the stand-alone gridding tool: half a cell, doubled at each step."""
    return [resolution / 2 * factor**k for k in range(steps)]


def occupied_cells(points: DataFrame, size: float, least: int = 1) -> DataFrame:
    """Hexagonal cells with enough points, in axial coordinates."""
    q = F.col("x") * (2 / 3) / size
    r = (F.col("y") * (math.sqrt(3) / 3) - F.col("x") / 3) / size
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    axial_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    axial_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return points.groupBy(axial_q.cast("long").alias("q"), axial_r.cast("long").alias("r")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def uv_bounds(corners: DataFrame) -> DataFrame:
    """By material, the box of the texture places and the number of corners."""
    return corners.groupBy("material").agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.max("u").alias("u1"), F.max("v").alias("v1"), F.count("*").alias("corners"))


def share_inside(points: DataFrame, inside: Column, by: str) -> DataFrame:
    """Percent of points inside, and whether the group counts as surrounded."""
    return points.groupBy(by).agg((F.avg(inside.cast("double")) * 100).alias("percent")).withColumn("surrounded", F.col("percent") > 90)


def members_near(members: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Points within three distances (city-block) of any member of each cluster."""
    reach = 3 * distance
    cell = lambda c: F.floor(F.col(c) / reach)
    step = F.sequence(F.lit(-1), F.lit(1))
    spread = members.select("cluster", F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_cx"), cell("y").alias("_cy")).withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    spread = spread.select("cluster", "_x", "_y", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
    near = points.withColumn("_cx", cell("x")).withColumn("_cy", cell("y")).join(spread, ["_cx", "_cy"]).filter(F.abs(F.col("x") - F.col("_x")) + F.abs(F.col("y") - F.col("_y")) <= reach)
    return near.select("cluster", *points.columns).distinct()


def sub_scenes(points: DataFrame, area: float = 660_000.0) -> DataFrame:
    """Points with the square sub-scene (scene_col, scene_row) of an area that holds them, from the cloud's corner on.

    Points without a place are in no sub-scene and left out.
    """
    side = math.sqrt(area)
    corner = points.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    at = lambda k: F.floor((F.col(k) - F.col(f"_{k}0")) / side)
    return points.filter("x IS NOT NULL AND y IS NOT NULL").crossJoin(F.broadcast(corner)).withColumn("scene_col", at("x")).withColumn("scene_row", at("y")).drop("_x0", "_y0")


def mosaic_extent(rasters: DataFrame) -> DataFrame:
    """The frame that holds all rasters (left, bottom, right, top, res), at the first one's resolution, and its size in cells."""
    c = F.col
    ends = rasters.agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"), F.min_by("res", "ord").alias("res"))
    return ends.withColumn("width", F.ceil((c("right") - c("left")) / c("res"))).withColumn("height", F.ceil((c("top") - c("bottom")) / c("res")))


def alpha_share(raster: DataFrame, by: str) -> DataFrame:
    """Of each source, its cells, those that are not transparent, and their share."""
    seen = F.sum((F.col("alpha") != 0).cast("long"))
    return raster.groupBy(by).agg(F.count("*").alias("cells"), seen.alias("opaque"), (seen / F.count("*")).alias("share"))


# ---- alignment ---------------------------------------------------------------


def sane_homographies(matrices: DataFrame, column: str, least: float = 0.25, most: float = 1e5) -> DataFrame:
    """3 by 3 matrices with a determinant off zero and a bounded ratio of singular values."""
    ship(matrices.sparkSession)

    @F.pandas_udf("boolean")
    def sane(column_: pd.Series) -> pd.Series:
        h = np.array(column_.tolist(), float).reshape(-1, 3, 3)
        s = np.linalg.svd(h, compute_uv=False)
        return pd.Series((np.abs(np.linalg.det(h)) >= least) & (s[:, -1] > 0) & (s[:, 0] <= most * np.maximum(s[:, -1], 1e-300)))

    return matrices.filter(sane(column))


def consensus(matrices: DataFrame, band: str, key: str, values: str, most: int = 30) -> DataFrame:
    """By band, the matrix whose eigenvalues differ least from those of the others.

    At most ``most`` samples of a band take part (the first by key), which bounds the pairs.
    """
    some = matrices.withColumn("_i", F.row_number().over(Window.partitionBy(band).orderBy(key))).filter(F.col("_i") <= most).drop("_i")
    other = some.select(F.col(band), F.col(values).alias("_v"))
    apart = F.aggregate(F.zip_with(values, "_v", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    scores = some.join(other, band).groupBy(band, key).agg(F.sum(apart).alias("score"))
    return scores.groupBy(band).agg(F.min_by(F.struct(key, "score"), F.struct("score", key)).alias("_b")).select(band, "_b.*")


def collinearity(points: DataFrame, camera: dict[str, float], rotation: Sequence[float]) -> DataFrame:
    """Image places of terrain points under a camera; only points inside the image."""
    a1, b1, c1, a2, b2, c2, a3, b3, c3 = rotation
    dx, dy, dz = F.col("x") - camera["x"], F.col("y") - camera["y"], F.col("z") - camera["z"]
    den = a3 * dx + b3 * dy + c3 * dz
    u = camera["width"] / 2 - camera["focal"] * (a1 * dx + b1 * dy + c1 * dz) / den
    v = camera["height"] / 2 - camera["focal"] * (a2 * dx + b2 * dy + c2 * dz) / den
    return points.withColumn("u", u).withColumn("v", v).filter(F.col("u").between(0, camera["width"] - 1) & F.col("v").between(0, camera["height"] - 1))


def visible(cells: DataFrame, dem: DataFrame, camera: dict[str, float], size: float) -> DataFrame:
    """Cells whose ray to the camera no terrain on the way rises above; samples are a cell apart.

    Along the way to the camera a ray only rises, so it is sampled until it is higher than
    all terrain.
    """
    cx, cy = camera["x"] / size, camera["y"] / size
    dx, dy = cx - (F.col("col") + 0.5), cy - (F.col("row") + 0.5)
    length = F.sqrt(dx * dx + dy * dy)
    top = dem.agg(F.max("value").alias("_top"))
    share = F.when(F.col("_top") <= F.col("value"), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("_top") - F.col("value"), camera["z"] - F.col("value")), F.lit(1.0))))
    share = F.when(F.lit(camera["z"]) <= F.col("value"), 1.0).otherwise(share)
    steps = cells.crossJoin(F.broadcast(top)).withColumn("_n", F.least(F.floor(length), F.ceil(length * share)).cast("long")).drop("_top")
    steps = steps.withColumn("_k", F.explode(F.when(F.col("_n") >= 1, F.sequence(F.lit(1).cast("long"), F.col("_n"))).otherwise(F.array(F.lit(0).cast("long")))))
    t = F.col("_k") / F.greatest(length, F.lit(1e-9))
    at = steps.withColumn("_c", F.floor(F.col("col") + 0.5 + dx * t)).withColumn("_r", F.floor(F.col("row") + 0.5 + dy * t)).withColumn("_h", F.col("value") + (camera["z"] - F.col("value")) * t)
    ground = dem.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_g"))
    hidden = F.max(((F.col("_g") > F.col("_h")) & (F.col("_k") > 0)).cast("int"))
    judged = at.join(ground, ["_r", "_c"], "left").groupBy("row", "col", "value").agg(F.coalesce(hidden, F.lit(0)).alias("_hidden"))
    return judged.filter("_hidden = 0").select("row", "col", "value")


def orthorectified(cells: DataFrame, dem: DataFrame, image: DataFrame, camera: dict[str, float], rotation: Sequence[float], size: float) -> DataFrame:
    """Image values of the visible terrain cells."""
    seen = visible(cells, dem, camera, size)
    placed = collinearity(seen.select("row", "col", ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"), F.col("value").alias("z")), camera, rotation)
    samples = placed.select(F.col("row").alias("out_row"), F.col("col").alias("out_col"), F.col("u").alias("x"), F.col("v").alias("y"))
    return bilinear(samples, image).select(F.col("out_row").alias("row"), F.col("out_col").alias("col"), "value")


# ---- sorting, packing, cutting -----------------------------------------------


def in_order(df: DataFrame, keys: dict[str, Column], out: str = "place") -> DataFrame:
    """Df with its place from 1 in an order of several keys, the last of which makes it total."""
    named = df.select("*", *(v.alias(f"_k{i}") for i, v in enumerate(keys.values())))
    return ranked(named, [f"_k{i}" for i in range(len(keys))], out).select(*df.columns, out)


def largest_feature(features: DataFrame) -> DataFrame:
    """The feature with most ring points, the first among equals."""
    return features.groupBy().agg(F.min_by(F.struct(*features.columns), F.struct(-F.size("ring"), F.col("ord"))).alias("_f")).select("_f.*")


def packed(blocks: Sequence[tuple[str, int, int]]) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Places of a few dozen texture blocks (name, width, height) in one image that grows to the right or down.

    Returns the places and the image's size. Wide blocks come first. A block goes into the
    first free rectangle that holds it; what is left of that to its right is tried before
    what is left below. The image grows to the side that keeps it square, else to the right.
    """
    places: dict[str, tuple[int, int]] = {}
    if not blocks:
        return places, 0, 0
    order = sorted(blocks, key=lambda b: -b[1])
    width, height = order[0][1], order[0][2]
    free = [(0, 0, width, height)]
    for name, w, h in order:
        if not any(fw >= w and fh >= h for _, _, fw, fh in free):
            right, down = h <= height, w <= width
            if not right and not down:
                raise ValueError(f"no room for block {name!r}")
            if right and (height >= width + w or not (down and width >= height + h)):
                free.insert(0, (width, 0, w, height))
                width += w
            else:
                free.append((0, height, width, h))
                height += h
        at = next(i for i, (_, _, fw, fh) in enumerate(free) if fw >= w and fh >= h)
        x, y, fw, fh = free[at]
        places[name] = (x, y)
        free[at : at + 1] = [(x + w, y, fw - w, h), (x, y + h, fw, fh - h)]
    return places, width, height


def cut_lines(raster: DataFrame, source: str, edge: float, barrier: float = 9999.0) -> DataFrame:
    """By source, the cheapest path from the left to the right side of a (downscaled) raster.

    Cells on strong edges cost nothing, missing cells are barriers, others cost 1. One
    source is one group; it is as large as its downscaled image.
    """
    ship(raster.sparkSession)
    kind = raster.schema[source].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells = {(r, c): v for r, c, v in zip(frame["row"], frame["col"], frame["value"])}
        rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
        low, high = cols[0], cols[-1]

        def cost(r: int, c: int) -> float:
            if (r, c) not in cells:
                return barrier
            steep = max((abs(cells[r, c] - cells[q]) for q in ((r + 1, c), (r, c + 1), (r - 1, c), (r, c - 1)) if q in cells), default=0.0)
            return 0.0 if steep >= edge else 1.0

        best = {(r, low): cost(r, low) for r in range(rows[0], rows[-1] + 1)}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(v, p) for p, v in best.items()]
        heapq.heapify(heap)
        end = None
        while heap:
            v, (r, c) = heapq.heappop(heap)
            if v > best[r, c]:
                continue
            if c == high:
                end = (r, c)
                break
            for q in ((r, c + 1), (r + 1, c), (r - 1, c), (r, c - 1)):
                if rows[0] <= q[0] <= rows[-1] and low <= q[1] <= high:
                    w = v + cost(*q)
                    if w < best.get(q, math.inf):
                        best[q], came[q] = w, (r, c)
                        heapq.heappush(heap, (w, q))
        path = []
        while end is not None:
            path.append(end)
            end = came.get(end)
        path.reverse()
        return pd.DataFrame({source: [frame[source].iloc[0]] * len(path), "place": range(len(path)), "row": [p[0] for p in path], "col": [p[1] for p in path]})

    return raster.select(source, "row", "col", "value").groupBy(source).applyInPandas(run, f"{source} {kind}, place long, row long, col long")


# ---- small helpers and hooks ---------------------------------------------------


def shell_quoted(text: str) -> str:
    """Text in double quotes for a shell."""
    return '"' + re.sub(r'([\\"$`])', r"\\\1", text) + '"'


def related_path(path: str, prefix: str = "", postfix: str = "", ext: str | None = None, folder: str | None = None) -> str:
    """A path next to another, with name parts added or replaced."""
    head, _, name = path.rpartition("/")
    base, dot, old = name.rpartition(".")
    if not dot:
        base, old = name, ""
    new = f"{prefix}{base}{postfix}" + (f".{(ext or old).lstrip('.')}" if ext or old else "")
    where = head if folder is None else folder
    return f"{where}/{new}" if where else new


def is_url(text: str) -> bool:
    """X30."""
    return re.fullmatch(r"https?://[\w.-]+(:\d+)?(/\S*)?", text, re.I) is not None


def decoded_field(json: Column, name: str) -> Column:
    """A binary value of a metadata document, as in 'base64:...'."""
    return F.unbase64(F.regexp_replace(F.get_json_object(json, f"$[0].{name}"), "^base64:", ""))


def obj_lines(vertices: DataFrame, places: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines of a mesh file: vertices, texture places, then faces under their material."""
    number = lambda *cs: F.concat_ws(" ", *(F.format_string("%.6f", c) for c in cs))
    corner = F.concat_ws("/", F.col("vertex").cast("string"), F.col("texture").cast("string"))
    polygon = faces.groupBy("path", "material", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("corner", corner.alias("t")))), lambda c: c["t"]), " ").alias("f"))
    v = vertices.select("path", F.lit(0).alias("part"), F.lit("").alias("material"), F.col("id").cast("long").alias("place"), F.concat(F.lit("v "), number("x", "y", "z")).alias("line"))
    t = places.select("path", F.lit(1).alias("part"), F.lit("").alias("material"), F.col("id").cast("long").alias("place"), F.concat(F.lit("vt "), number("u", "v")).alias("line"))
    m = faces.select("path", "material").distinct().select("path", F.lit(2).alias("part"), "material", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("usemtl "), "material").alias("line"))
    f = polygon.select("path", F.lit(2).alias("part"), "material", F.col("line_no").cast("long").alias("place"), F.concat(F.lit("f "), "f").alias("line"))
    return v.unionByName(t).unionByName(m).unionByName(f)


def external_step(images: DataFrame, run: Callable[[bytes], bytes], key: str = "path", content: str = "content") -> DataFrame:
    """An outside model or program applied to each image's bytes, as a hook: masks, classification, registration."""
    ship(images.sparkSession)

    def step(batches):
        for frame in batches:
            yield pd.DataFrame({key: frame[key], "result": [run(c) for c in frame[content]]})

    return images.select(key, content).mapInPandas(step, f"{key} string, result binary")


def mask_threshold(probability: Column) -> Column:
    """A mask's byte from a model's byte."""
    return F.when(probability > 127, 255).otherwise(0)
