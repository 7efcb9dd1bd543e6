"""Rasters in long form (source, row, col, value): gridding, mosaics, focal operators and tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skysurvey.functions.geodesy import lonlat_to_mercator, metres_to_tile
from skysurvey.session import ship

#: Weight of a cell whose distance to no data is 0.
FLOOR_WEIGHT = 0.001953125


def grid_max(points: DataFrame, size: float) -> DataFrame:
    """The highest point of every cell, and how many there are."""
    return points.groupBy(F.floor(F.col("x") / size).alias("col"), F.floor(F.col("y") / size).alias("row")).agg(F.max("z").alias("value"), F.count("*").alias("n"))


def grid_radius(points: DataFrame, size: float, radius: float, kind: str = "max", power: float = 1.0, value: str = "z") -> DataFrame:
    """Per cell centre, the maximum or the inverse-distance mean of the points within a radius."""
    reach = int(radius / size + 1)
    step = F.sequence(F.lit(-reach), F.lit(reach))
    spread = (
        points.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
        .withColumn("col", F.floor(F.col("x") / size) + F.col("_dx")).withColumn("row", F.floor(F.col("y") / size) + F.col("_dy"))
        .withColumn("_d", F.hypot(F.col("x") - (F.col("col") + 0.5) * size, F.col("y") - (F.col("row") + 0.5) * size))
        .filter(F.col("_d") <= radius)
    )
    if kind == "max":
        return spread.groupBy("row", "col").agg(F.max(value).alias("value"))
    weight = F.when(F.col("_d") > 0, 1 / F.pow("_d", F.lit(power)))
    exact = F.min(F.when(F.col("_d") == 0, F.col(value)))
    return spread.groupBy("row", "col").agg(F.coalesce(exact, F.sum(F.col(value) * weight) / F.sum(weight)).alias("value"))


def finest(layers: Sequence[tuple[float, DataFrame]]) -> DataFrame:
    """Per cell the value of the smallest radius that has one."""
    tagged = [d.select("row", "col", "value", F.lit(float(r)).alias("_r")) for r, d in layers]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out.groupBy("row", "col").agg(F.min_by("value", "_r").alias("value"))


def neighbours(raster: DataFrame, reach: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell's value handed to the cells around it: (keys, row, col, dr, dc, value)."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        raster.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
        .select(*keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (-F.col("dr")).alias("dr"), (-F.col("dc")).alias("dc"), "value")
    )


def focal_median(raster: DataFrame, radius: int) -> DataFrame:
    """The median of the valid cells around each valid cell."""
    around = neighbours(raster, radius).groupBy("row", "col").agg(F.median("value").alias("value"))
    return raster.select("row", "col").join(around, ["row", "col"])


def kernel(raster: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """A weighted sum of each cell's neighbours (missing ones add nothing)."""
    reach = max(max(abs(r), abs(c)) for r, c in weights)
    cases = F.lit(0.0)
    for (r, c), w in weights.items():
        cases = F.when((F.col("dr") == r) & (F.col("dc") == c), w).otherwise(cases)
    sums = neighbours(raster, reach).groupBy("row", "col").agg(F.sum(F.col("value") * cases).alias("value"))
    return raster.select("row", "col").join(sums, ["row", "col"])


LAPLACIAN = {(0, 0): -4.0, (0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0}


def blur_score(raster: DataFrame) -> DataFrame:
    """The variance of the Laplacian."""
    return kernel(raster, LAPLACIAN).agg(F.var_pop("value").alias("score"))


def hillshade(raster: DataFrame, size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Horn's shaded relief, 1 to 255, of cells with eight neighbours."""
    at = {(r, c): F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("value"))).alias(f"_{r + 1}{c + 1}") for r in (-1, 0, 1) for c in (-1, 0, 1)}
    cells = neighbours(raster, 1).groupBy("row", "col").agg(*at.values(), F.count("*").alias("_n")).filter("_n = 9")
    v = lambda r, c: F.col(f"_{r + 1}{c + 1}")
    dx = ((v(-1, 1) + 2 * v(0, 1) + v(1, 1)) - (v(-1, -1) + 2 * v(0, -1) + v(1, -1))) / (8 * size)
    dy = ((v(1, -1) + 2 * v(1, 0) + v(1, 1)) - (v(-1, -1) + 2 * v(-1, 0) + v(-1, 1))) / (8 * size)
    slope, aspect = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(dy, -dx)
    zenith, light = F.radians(F.lit(90 - altitude)), F.radians(F.lit((360 - azimuth + 90) % 360))
    shade = F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(light - aspect)
    return cells.select("row", "col", F.greatest(F.lit(1.0), 1 + 254 * shade).alias("value"))


def box_mean(raster: DataFrame, radius: int) -> DataFrame:
    """The mean over a square, truncated at the edges, by rows and then by columns; cells must be complete."""
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    rows = raster.withColumn("_s", F.sum("value").over(across)).withColumn("_k", F.count("value").over(across))
    return rows.select("row", "col", (F.sum("_s").over(down) / F.sum("_k").over(down)).alias("value"))


def guided_filter(raster: DataFrame, guide: DataFrame, radius: int, epsilon: float) -> DataFrame:
    """An edge-preserving mean of the raster, led by a guide."""
    both = raster.join(guide.withColumnRenamed("value", "g"), ["row", "col"])

    def mean(value: Column, name: str, of: DataFrame) -> DataFrame:
        return box_mean(of.select("row", "col", value.alias("value")), radius).withColumnRenamed("value", name)

    parts = mean(F.col("value"), "p", both)
    for value, name in ((F.col("g"), "i"), (F.col("g") * F.col("value"), "ip"), (F.col("g") * F.col("g"), "ii")):
        parts = parts.join(mean(value, name, both), ["row", "col"])
    a = (F.col("ip") - F.col("i") * F.col("p")) / (F.col("ii") - F.col("i") * F.col("i") + epsilon)
    linear = parts.select("row", "col", a.alias("a"), (F.col("p") - a * F.col("i")).alias("b"))
    out = mean(F.col("a"), "a", linear).join(mean(F.col("b"), "b", linear), ["row", "col"]).join(guide, ["row", "col"])
    return out.select("row", "col", (F.col("a") * F.col("value") + F.col("b")).alias("value"))


def edge_distance(raster: DataFrame) -> DataFrame:
    """Euclidean distance, in cells, of valid cells to the nearest missing one; cells beyond the raster are missing.

    Exact, in two passes: the distance along each row is the place in a run of valid cells;
    along a column the least of d * d + row distance * row distance is a lower envelope of
    parabolas, found in linear time for each run of valid cells of a column.
    """
    ship(raster.sparkSession)
    w = Window.partitionBy("row").orderBy("col")
    cells = raster.select("row", "col").withColumn("_run", F.col("col") - F.row_number().over(w))
    run = Window.partitionBy("row", "_run")
    cells = cells.select("row", "col", F.least(F.col("col") - F.min("col").over(run), F.max("col").over(run) - F.col("col")).alias("_g"))

    def column(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        rows, along = frame["row"].to_numpy(), frame["_g"].to_numpy() + 1.0
        cut = np.concatenate([[0], np.nonzero(np.diff(rows) != 1)[0] + 1, [len(rows)]])
        parts = [lower_envelope(np.concatenate([[0.0], along[a:b] ** 2, [0.0]]))[1:-1] for a, b in zip(cut[:-1], cut[1:])]
        return pd.DataFrame({"row": rows, "col": frame["col"].to_numpy(), "dist": np.sqrt(np.concatenate(parts))})

    found = cells.groupBy("col").applyInPandas(column, "row long, col long, dist double")
    return raster.join(found, ["row", "col"])


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q) ** 2 + f[q] for every place p."""
    n = len(f)
    hull, bound = [0], [-np.inf]
    for q in range(1, n):
        while True:
            v = hull[-1]
            s = ((f[q] + q * q) - (f[v] + v * v)) / (2 * q - 2 * v)
            if s > bound[-1]:
                break
            hull.pop()
            bound.pop()
        hull.append(q)
        bound.append(s)
    at = np.searchsorted(np.array(bound), np.arange(n), "right") - 1
    nearest = np.array(hull)[at]
    return (np.arange(n) - nearest) ** 2 + f[nearest]


def blend(raster: DataFrame, distance: str) -> DataFrame:
    """The distance-weighted mean of overlapping sources; distance 0 has the floor weight."""
    weight = F.when(F.col("value").isNotNull(), F.when(F.col(distance) == 0, FLOOR_WEIGHT).otherwise(F.col(distance))).otherwise(0.0)
    sums = raster.groupBy("row", "col").agg(F.sum(F.col("value") * weight).alias("_v"), F.sum(weight).alias("weight"))
    return sums.filter("weight <> 0").select("row", "col", (F.col("_v") / F.col("weight")).alias("value"), "weight")


def fill_low_weight(blended: DataFrame, block: int = 512) -> DataFrame:
    """Cells of very low weight take the nearest other value of their block (of equally near ones that of the smallest row, then column).

    A block is one group of block * block cells at most; the nearest value is found along
    rows first and then along columns, not by pairs of cells.
    """
    ship(blended.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        weight = frame["weight"].to_numpy()
        low = (weight > FLOOR_WEIGHT) & (weight < 1)
        if low.any() and not low.all():
            r0, c0 = frame["row"].min(), frame["col"].min()
            r, c = (frame["row"] - r0).to_numpy(), (frame["col"] - c0).to_numpy()
            grid = np.full((r.max() + 1, c.max() + 1), np.nan)
            grid[r[~low], c[~low]] = frame["value"].to_numpy()[~low]
            frame["value"] = frame["value"].where(~low, 0.0)
            frame.loc[low, "value"] = nearest_values(grid, ~np.isnan(grid), r[low], c[low])
        return frame[["row", "col", "value", "weight"]]

    keyed = blended.select("row", "col", "value", "weight", F.floor(F.col("row") / block).alias("_br"), F.floor(F.col("col") / block).alias("_bc"))
    return keyed.groupBy("_br", "_bc").applyInPandas(run, "row long, col long, value double, weight double")


def nearest_values(grid: np.ndarray, there: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The value of the nearest cell that is there, for the given places: the first in order of rows and columns among equals."""
    height, width = grid.shape
    at = np.arange(width)
    left = np.maximum.accumulate(np.where(there, at, -(4 * width + 4 * height)), axis=1)
    right = np.minimum.accumulate(np.where(there, at, 5 * width + 4 * height)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(at - left <= right - at, left, right)
    along = (near - at) ** 2
    out = np.empty(len(rows))
    down = (np.arange(height)[:, None] - np.arange(height)) ** 2
    for c in np.unique(cols):
        mine = np.nonzero(cols == c)[0]
        best = (down[rows[mine]] + along[:, c]).argmin(axis=1)
        out[mine] = grid[best, near[best, c]]
    return out


def first_wins(raster: DataFrame, order: str, alpha: str = "alpha") -> DataFrame:
    """U8: per cell the first source with a non-zero alpha."""
    return raster.filter(F.col(alpha) != 0).groupBy("row", "col").agg(F.min_by(F.struct(order, "value", alpha), order).alias("_f")).select("row", "col", "_f.*")


def alpha_fold(raster: DataFrame, order: str, alpha: str = "alpha") -> DataFrame:
    """Sources laid over each other in order, truncating to whole numbers after each."""
    layers = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(alpha).alias("a"), F.floor("value").cast("double").alias("v"))))
    over = lambda d, s: F.floor(s["a"] / 255.0 * s["v"] + (1 - s["a"] / 255.0) * d).cast("double")
    cells = raster.filter(F.col(alpha) != 0).groupBy("row", "col").agg(layers.alias("_l"))
    # The base is the first layer itself; every layer, the first one too, is then laid over it.
    return cells.select("row", "col", F.aggregate("_l", F.col("_l")[0]["v"], over).alias("value"))


def feather(alpha: Column, distance: Column, width: float = 20.0) -> Column:
    """Alpha falling off towards the edge."""
    return alpha * F.least(distance / width, F.lit(1.0))


def fill_gaps(raster: DataFrame, frame: DataFrame, rounds: int) -> DataFrame:
    """Missing cells of a frame take the mean of their neighbours, round by round."""
    known = raster.select("row", "col", "value")
    for _ in range(rounds):
        means = neighbours(known, 1).groupBy("row", "col").agg(F.avg("value").alias("value"))
        new = frame.select("row", "col").join(known, ["row", "col"], "left_anti").join(means, ["row", "col"])
        known = known.unionByName(new)
    return known


def coarsen(raster: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Block means."""
    return raster.groupBy(*keys, F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))


def bilinear(samples: DataFrame, raster: DataFrame) -> DataFrame:
    """Raster values at fractional (x, y) in cells, renormalised where neighbours are missing."""
    step = F.sequence(F.lit(0), F.lit(1))
    corner = samples.withColumn("_dr", F.explode(step)).withColumn("_dc", F.explode(step)).withColumn("row", F.floor("y") + F.col("_dr")).withColumn("col", F.floor("x") + F.col("_dc"))
    w = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    hit = corner.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    some = F.when(F.col("value").isNotNull(), w)
    return hit.groupBy(*samples.columns).agg(F.try_divide(F.sum(F.col("value") * some), F.sum(some)).alias("value"))


def resample_nearest(samples: DataFrame, raster: DataFrame) -> DataFrame:
    """The value of the nearest cell, null where there is none."""
    keyed = samples.withColumn("row", F.floor(F.col("y") + 0.5)).withColumn("col", F.floor(F.col("x") + 0.5))
    return keyed.join(raster.select("row", "col", "value"), ["row", "col"], "left").select(*samples.columns, "value")


def kernel_weight(name: str, d: Column) -> Column:
    """Weight of a neighbour at distance d by resampling kernel."""
    import math

    a = F.abs(d)
    if name == "near":
        return F.when(a <= 0.5, 1.0).otherwise(0.0)
    if name == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if name == "cubic":
        return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)
    if name == "cubicspline":
        return F.when(a <= 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)
    if name in ("lanczos", "antialias"):
        x = math.pi * a
        return F.when(a == 0, 1.0).when(a < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)
    raise ValueError(f"unknown kernel {name!r}")


def resample(samples: DataFrame, raster: DataFrame, kernel_name: str) -> DataFrame:
    """Raster values at fractional (x, y) under a separable kernel, renormalised where neighbours are missing; null where none is there, or where their weights cancel out."""
    reach = {"near": 1, "bilinear": 1, "cubic": 2, "cubicspline": 2}.get(kernel_name, 3)
    step = F.sequence(F.lit(1 - reach), F.lit(reach))
    # Every cell goes to the places around it, of which there are fewer than samples; a sample then meets all its cells at once.
    spread = raster.filter("value IS NOT NULL").select("row", "col", "value", F.explode(step).alias("_dr")).withColumn("_dc", F.explode(step))
    around = spread.groupBy((F.col("row") - F.col("_dr")).alias("_r"), (F.col("col") - F.col("_dc")).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("_near"))

    def term(n: Column) -> Column:
        return F.struct((kernel_weight(kernel_name, F.col("y") - n["row"]) * kernel_weight(kernel_name, F.col("x") - n["col"])).alias("w"), n["value"].cast("double").alias("v"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"))
    sums = F.aggregate(F.filter(F.transform("_near", term), lambda t: t["w"] != 0), zero, lambda s, t: F.struct((s["w"] + t["w"]).alias("w"), (s["v"] + t["v"] * t["w"]).alias("v")))
    found = samples.withColumn("_r", F.floor("y")).withColumn("_c", F.floor("x")).join(around, ["_r", "_c"], "left").withColumn("_s", sums)
    return found.select(*samples.columns, F.when(F.abs("_s.w") > 1e-6, F.col("_s.v") / F.col("_s.w")).alias("value"))


def contours(raster: DataFrame, interval: float) -> DataFrame:
    """Crossings of cell edges with contour levels: (level, row, col, axis, place along the edge)."""
    right = raster.select("row", (F.col("col") - 1).alias("col"), F.col("value").alias("other"), F.lit("x").alias("axis"))
    down = raster.select((F.col("row") - 1).alias("row"), "col", F.col("value").alias("other"), F.lit("y").alias("axis"))
    edges = raster.join(right.unionByName(down), ["row", "col"]).filter("value <> other")
    low, high = F.least("value", "other"), F.greatest("value", "other")
    levels = F.sequence((F.floor(low / interval) + 1).cast("long"), F.floor(high / interval).cast("long"))
    some = edges.filter(F.floor(high / interval) >= F.floor(low / interval) + 1).withColumn("_k", F.explode(levels))
    level = F.col("_k") * interval
    return some.select(level.alias("level"), "row", "col", "axis", ((level - F.col("value")) / (F.col("other") - F.col("value"))).alias("place"))


def base_tiles(points: DataFrame, zoom: int, value: str) -> DataFrame:
    """The mean value and count of every tile at a zoom, from (lon, lat)."""
    place = lonlat_to_mercator(F.col("lon"), F.col("lat"))
    tile = metres_to_tile(place["x"], place["y"], F.lit(zoom))
    return points.select(F.lit(zoom).alias("z"), tile["tx"].alias("x"), tile["ty"].alias("y"), F.col(value).alias("_v")).groupBy("z", "x", "y").agg(F.sum("_v").alias("total"), F.count("_v").alias("n"))


def pyramid(tiles: DataFrame, first: int) -> DataFrame:
    """Overview tiles down to a zoom; sums and counts add up, so one pass makes all levels."""
    up = F.explode(F.sequence(F.lit(0), F.col("z") - first))
    spread = tiles.withColumn("_k", up).withColumn("_f", F.pow(F.lit(2.0), "_k"))
    keys = [(F.col("z") - F.col("_k")).alias("z"), F.floor(F.col("x") / F.col("_f")).alias("x"), F.floor(F.col("y") / F.col("_f")).alias("y")]
    return spread.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
