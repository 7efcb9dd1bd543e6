"""Point clouds: filters, statistics, hulls, partitions and ground rectification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skysurvey.operators.sets import nearest
from skysurvey.session import checkpointed, ship


def in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """even-odd test against a ring of constants."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if ay == by:
            continue
        crosses = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside = inside != crosses
    return inside


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed on all sides."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_hull(x: Column, y: Column, hull: Sequence[tuple[float, float]]) -> Column:
    """inside or on a convex ring given counter-clockwise."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]]):
        out = out & (((bx - ax) * (y - ay) - (by - ay) * (x - ax)) >= -1e-9)
    return out


def bounds(points: DataFrame, *columns: str) -> DataFrame:
    """Count and, by column, minimum, maximum, mean and deviation."""
    return points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))))


def cell_sample(points: DataFrame, radius: float) -> DataFrame:
    """one point of every cell of the radius' size, the one nearest to the cell's centre."""
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    d = F.hypot(F.col("x") - (cx + 0.5) * radius, F.col("y") - (cy + 0.5) * radius)
    rest = points.columns
    return points.groupBy(cx.alias("_cx"), cy.alias("_cy")).agg(F.min_by(F.struct(*rest), F.struct(d, *rest)).alias("_p")).select("_p.*")


def outliers(points: DataFrame, key: str, k: int, times: float, cell: float) -> DataFrame:
    """points with the mean distance to their k nearest neighbours; ``keep`` is below mean + times * deviation."""
    queries = points.select(key, "x", "y")
    others = points.select("x", "y", F.col(key).alias("_other"))
    near = nearest(queries, others, key, k + 1, cell).filter(F.col("_other") != F.col(key))
    own = Window.partitionBy(key).orderBy("distance", "_other")
    mean = near.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).groupBy(key).agg(F.avg("distance").alias("mean_distance"))
    limit = mean.agg((F.avg("mean_distance") + times * F.stddev_samp("mean_distance")).alias("_limit"))
    return points.join(mean, key).crossJoin(F.broadcast(limit)).withColumn("keep", F.col("mean_distance") < F.col("_limit")).drop("_limit")


def convex_hull(points: DataFrame, groups: int = 64) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise; empty without points.

    Each task keeps the hull of its points, groups of tasks' hulls are merged, and the
    hulls of the groups reach the driver: no more points than those hulls have corners.
    """
    ship(points.sparkSession)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[float, float]] = []
        for frame in batches:
            xy = np.unique(np.concatenate([frame[["x", "y"]].dropna().to_numpy(float), np.array(found).reshape(-1, 2)]), axis=0)
            found = monotone_chain(set(map(tuple, outer_points(xy).tolist())))
        yield pd.DataFrame(found, columns=["x", "y"]).astype(float)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(monotone_chain(set(map(tuple, frame[["x", "y"]].to_numpy().tolist()))), columns=["x", "y"]).astype(float)

    hulls = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(own, "x double, y double")
    hulls = hulls.withColumn("_g", F.spark_partition_id() % groups).groupBy("_g").applyInPandas(merged, "x double, y double")
    return monotone_chain({(r["x"], r["y"]) for r in hulls.collect()})


def outer_points(xy: np.ndarray, directions: int = 16) -> np.ndarray:
    """xy without the points inside the polygon of those farthest in some directions."""
    if len(xy) < 3 * directions:
        return xy
    angle = np.arange(directions) * 2 * np.pi / directions
    far = xy[np.argmax(xy @ np.stack([np.cos(angle), np.sin(angle)]), axis=0)]
    ring = np.array(monotone_chain(set(map(tuple, far.tolist()))))
    if len(ring) < 3:
        return xy
    side = np.roll(ring, -1, axis=0) - ring
    inside = np.ones(len(xy), bool)
    for (ax, ay), (dx, dy) in zip(ring, side):
        inside &= dx * (xy[:, 1] - ay) - dy * (xy[:, 0] - ax) > 1e-9
    return xy[~inside]


def monotone_chain(points: set[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull of a few points, counter-clockwise."""
    ordered = sorted(points)
    if len(ordered) < 3:
        return ordered

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ordered) + half(ordered[::-1])


def buffered(hull: list[tuple[float, float]], distance: float) -> list[tuple[float, float]]:
    """A convex ring moved outwards (or inwards) by a distance, corners mitred; empty if nothing is left."""
    if len(hull) < 3:
        return []
    lines = []
    for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]]):
        n = math.hypot(bx - ax, by - ay)
        nx, ny = (by - ay) / n, -(bx - ax) / n
        lines.append((nx, ny, nx * ax + ny * ay + distance))
    if distance < 0:
        ring = [(float(x), float(y)) for x, y in hull]
        for nx, ny, limit in lines:
            out = []
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]] if ring else []):
                u, v = limit - nx * ax - ny * ay, limit - nx * bx - ny * by
                if u >= 0:
                    out.append((ax, ay))
                if u * v < 0:
                    out.append((ax + (bx - ax) * u / (u - v), ay + (by - ay) * u / (u - v)))
            ring = out
        return ring if len(ring) >= 3 and area(ring) > 0 else []
    ring = []
    for (a, b, c), (d, e, f) in zip([lines[-1], *lines[:-1]], lines):
        det = a * e - b * d
        if abs(det) > 1e-12:
            ring.append(((c * e - b * f) / det, (a * f - c * d) / det))
    return ring


def area(ring: Sequence[tuple[float, float]]) -> float:
    """Signed area, positive for counter-clockwise rings."""
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]])) / 2


def ring_area(ring: Column) -> Column:
    """Area of an array of (x, y) structures."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2


def plane_fit(points: DataFrame, by: str) -> DataFrame:
    """The least-squares plane z = a x + b y + c of each partition, and its slope in degrees; flat where singular."""
    m = {k: F.avg(e) for k, e in (("x", F.col("x")), ("y", F.col("y")), ("z", F.col("z")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")), ("xz", F.col("x") * F.col("z")), ("yz", F.col("y") * F.col("z")))}
    g = points.groupBy(by).agg(*(v.alias(k) for k, v in m.items()), F.count("*").alias("n"))
    c = F.col
    sxx, syy, sxy = c("xx") - c("x") * c("x"), c("yy") - c("y") * c("y"), c("xy") - c("x") * c("y")
    sxz, syz = c("xz") - c("x") * c("z"), c("yz") - c("y") * c("z")
    det = sxx * syy - sxy * sxy
    solid = det > 1e-9
    a, b = F.when(solid, (sxz * syy - syz * sxy) / det).otherwise(0.0), F.when(solid, (syz * sxx - sxz * sxy) / det).otherwise(0.0)
    out = g.select(by, "n", a.alias("a"), b.alias("b"), "x", "y", "z")
    return out.select(by, "n", "a", "b", (c("z") - c("a") * c("x") - c("b") * c("y")).alias("c"), F.degrees(F.atan(F.hypot("a", "b"))).alias("slope"))


def consensus_planes(points: DataFrame, by: str, order: Sequence[str], trials: int = 32) -> DataFrame:
    """The plane that most points of each partition lie near, fitted to these points (random sample consensus).

    Trials are triples among the partition's first points by a hash of ``order``, so a
    result depends on the rows alone. A point is near within the median absolute deviation
    of z. Among equals the first trial wins; where no trial spans a plane all points count.
    """
    c = F.col
    middle = points.groupBy(by).agg(F.median("z").alias("_m"))
    spread = points.join(middle, by).groupBy(by).agg(F.median(F.abs(c("z") - c("_m"))).alias("_near"))
    place = F.struct(F.xxhash64(*order).alias("h"), *(c(o) for o in order), c("x").alias("_x"), c("y").alias("_y"), c("z").alias("_z"))
    drawn = points.select(by, place.alias("_p"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_p"))  # the rank limit is applied before the shuffle
    drawn = drawn.withColumn("_r", rank).filter(c("_r") <= 3 * trials).groupBy(by).agg(F.array_sort(F.collect_list("_p")).alias("_s"))

    def plane(i: Column) -> Column:
        p, q, r = (c("_s")[3 * i + k] for k in range(3))
        ux, uy, uz, vx, vy, vz = q["_x"] - p["_x"], q["_y"] - p["_y"], q["_z"] - p["_z"], r["_x"] - p["_x"], r["_y"] - p["_y"], r["_z"] - p["_z"]
        det = ux * vy - uy * vx
        a, b = (uz * vy - uy * vz) / F.when(F.abs(det) > 1e-9, det), (ux * vz - uz * vx) / F.when(F.abs(det) > 1e-9, det)
        return F.struct(a.alias("a"), b.alias("b"), (p["_z"] - a * p["_x"] - b * p["_y"]).alias("c"))

    full = F.floor(F.size("_s") / 3).cast("int")
    tried = drawn.select(by, F.when(full > 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(full, F.lit(1)) - 1), plane), lambda t: t["a"].isNotNull())).alias("_t")).join(spread, by)
    judged = points.join(tried, by)
    off = lambda t: F.abs(c("z") - t["a"] * c("x") - t["b"] * c("y") - t["c"])
    votes = judged.groupBy(by).agg(*(F.sum((off(F.get("_t", F.lit(i))) <= c("_near")).cast("int")).alias(f"_v{i}") for i in range(trials)))
    every = F.array(*(F.struct(F.coalesce(f"_v{i}", F.lit(-1)).alias("v"), F.lit(-i).alias("i")) for i in range(trials)))
    best = votes.select(by, F.array_max(every).alias("_b"))
    chosen = tried.join(best, by).select(by, "_near", F.when(c("_b.v") > 0, F.get("_t", -c("_b.i"))).alias("_w"))
    inliers = points.join(chosen, by).filter(c("_w").isNull() | (off(c("_w")) <= c("_near"))).select(*points.columns)
    return plane_fit(inliers, by)


def residuals(points: DataFrame, by: str, steep: float = 45.0, order: Sequence[str] | None = None) -> DataFrame:
    """Height above the partition's plane, 0 below it and in steep partitions; with ``order`` the consensus plane, else the least-squares one."""
    planes = (consensus_planes(points, by, order) if order else plane_fit(points, by)).select(by, "a", "b", "c", "slope")
    above = F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c")
    return points.join(planes, by).withColumn("distance", F.when(F.col("slope") >= steep, 0.0).otherwise(F.greatest(above, F.lit(0.0)))).drop("a", "b", "c", "slope")


def reclassify(points: DataFrame, by: str, threshold: float, ground: int = 2, other: int = 1, order: Sequence[str] | None = None) -> DataFrame:
    """Ground points far above their partition's plane become unclassified."""
    low = points.filter(F.col("class") == ground)
    judged = residuals(low, by, order=order).withColumn("class", F.when(F.col("distance") > threshold, other).otherwise(F.col("class"))).drop("distance")
    return judged.select(*points.columns).unionByName(points.filter(F.col("class") != ground))


def quad_split(points: DataFrame, box: tuple[float, float, float, float], min_points: int, min_area: float, median: bool = False) -> DataFrame:
    """Points with ``node``, the path of their quad, and its box; a node splits only if all four children are large enough.

    Points on a cut go to the lower side. Points with a null place are left out.
    """
    points = points.filter("x IS NOT NULL AND y IS NOT NULL")
    return _median_split(points, box, min_points, min_area) if median else _centre_split(points, box, min_points, min_area)


def _centre_split(points: DataFrame, box: tuple[float, float, float, float], min_points: int, min_area: float) -> DataFrame:
    """Cuts at centres are known beforehand: points are counted once, in the smallest cells a split may make, and counts are rolled up."""
    x0, y0, x1, y1 = map(float, box)
    levels = max(0, int(math.floor(math.log((x1 - x0) * (y1 - y0) / min_area, 4) + 1e-9))) if min_area > 0 else 24
    side = 1 << levels

    def cell(column: str, low: float, high: float) -> Column:
        width, at = (high - low) / side, F.col(column)
        guess = F.ceil((at - low) / width) - 1
        exact = F.when(at <= low + guess * width, guess - 1).when(at > low + (guess + 1) * width, guess + 1).otherwise(guess)
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), exact)).cast("long")

    c = F.col
    placed = points.withColumn("_i", cell("x", x0, x1)).withColumn("_j", cell("y", y0, y1))
    counts = placed.groupBy("_i", "_j").agg(F.count("*").alias("_n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_l")
    shift = lambda k, by: F.floor(c(k) / F.pow(F.lit(2.0), by)).cast("long")
    rolled = counts.select("*", every).groupBy("_l", shift("_i", levels - c("_l")).alias("_u"), shift("_j", levels - c("_l")).alias("_v")).agg(F.sum("_n").alias("_n"))
    children = rolled.filter("_l > 0").groupBy((c("_l") - 1).alias("_l"), shift("_u", F.lit(1)).alias("_u"), shift("_v", F.lit(1)).alias("_v")).agg(F.count("*").alias("_k"), F.min("_n").alias("_least"))
    if min_points > 0:
        open_ = children.filter((c("_k") == 4) & (c("_least") >= min_points))
    else:
        open_ = children
    open_ = open_.select("_l", "_u", "_v", F.lit(True).alias("_open"))
    # A cell's leaf is the first of its nodes, from the top, that does not split.
    own = counts.select("_i", "_j", every).select("*", shift("_i", levels - c("_l")).alias("_u"), shift("_j", levels - c("_l")).alias("_v"))
    leaf = own.join(open_, ["_l", "_u", "_v"], "left").filter("_open IS NULL").groupBy("_i", "_j").agg(F.min("_l").alias("_l"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(max(levels, 1))), lambda k: F.when(k <= c("_l"), ((shift("_i", levels - k) % 2) + 2 * (shift("_j", levels - k) % 2)).cast("string")).otherwise(""))
    width, height = (x1 - x0) / F.pow(F.lit(2.0), "_l"), (y1 - y0) / F.pow(F.lit(2.0), "_l")
    u, v = shift("_i", levels - c("_l")), shift("_j", levels - c("_l"))
    nodes = leaf.select("_i", "_j", F.array_join(digits, "").alias("node"), (x0 + u * width).alias("x0"), (y0 + v * height).alias("y0"), (x0 + (u + 1) * width).alias("x1"), (y0 + (v + 1) * height).alias("y1"))
    return placed.join(nodes, ["_i", "_j"]).drop("_i", "_j")


def _median_split(points: DataFrame, box: tuple[float, float, float, float], min_points: int, min_area: float) -> DataFrame:
    """Cuts at medians depend on the points: level by level, until no node splits; only the cuts of a level are kept."""
    c = F.col
    current = points.select("*", F.lit("").alias("node"), *(F.lit(float(v)).alias(k) for v, k in zip(box, ("x0", "y0", "x1", "y1"))), F.lit(False).alias("_leaf"))
    while True:
        open_ = current.filter(~c("_leaf"))
        cut = open_.groupBy("node", "x0", "y0", "x1", "y1").agg(F.median("x").alias("_mx"), F.median("y").alias("_my"))
        right, up = c("x") > c("_mx"), c("y") > c("_my")
        quad = F.when(up, F.when(right, 3).otherwise(2)).otherwise(F.when(right, 1).otherwise(0))
        widths, heights = (c("_mx") - c("x0"), c("x1") - c("_mx")), (c("_my") - c("y0"), c("y1") - c("_my"))
        smallest = F.least(*(a * b for a in widths for b in heights))
        large = cut.filter(smallest >= min_area).select("node", "_mx", "_my")
        counts = open_.join(large, "node").groupBy("node", "_mx", "_my").agg(*(F.sum((quad == i).cast("int")).alias(f"_n{i}") for i in range(4)))
        splits = checkpointed(counts.filter(F.least(*(c(f"_n{i}") for i in range(4))) >= min_points).select("node", "_mx", "_my"))
        if splits.isEmpty():
            return current.drop("_leaf")
        joined = current.join(splits, "node", "left")
        go = c("_mx").isNotNull() & ~c("_leaf")
        digit = F.when(up, F.when(right, "3").otherwise("2")).otherwise(F.when(right, "1").otherwise("0"))
        current = joined.select(
            *points.columns, F.when(go, F.concat("node", digit)).otherwise(c("node")).alias("node"),
            F.when(go & right, c("_mx")).otherwise(c("x0")).alias("x0"), F.when(go & up, c("_my")).otherwise(c("y0")).alias("y0"),
            F.when(go & ~right, c("_mx")).otherwise(c("x1")).alias("x1"), F.when(go & ~up, c("_my")).otherwise(c("y1")).alias("y1"),
            (~go).alias("_leaf"),
        )


def grid_in_hull(hull: Sequence[tuple[float, float]], distance: float, points: DataFrame) -> DataFrame:
    """Grid places of a step inside a hull; the grid goes one step past the largest coordinates."""
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]

    def axis(low: float, high: float) -> Column:
        return F.sequence(F.lit(0), F.lit(math.ceil((high + distance - low) / distance) - 1))

    spark = points.sparkSession
    grid = spark.range(1).select(F.explode(axis(min(xs), max(xs))).alias("i")).withColumn("j", F.explode(axis(min(ys), max(ys))))
    grid = grid.select((min(xs) + F.col("i") * distance).alias("x"), (min(ys) + F.col("j") * distance).alias("y"))
    return grid.filter(in_hull(F.col("x"), F.col("y"), hull))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each component of edges (a, b), by min-label rounds with pointer jumping until nothing changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy("a").agg(F.min("component").alias("_n"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("component", F.coalesce("_n", "component")).alias("component"), F.col("component").alias("_old"))
        hop = new.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        new = new.join(hop, new["component"] == hop["_i"]).select("id", F.least("component", "_c").alias("component"), "_old")
        new = checkpointed(new)
        changed = not new.filter("component <> _old").isEmpty()
        labels = new.select("id", "component")
        if not changed:
            return labels


def cell_clusters(places: DataFrame, distance: float) -> DataFrame:
    """Clusters of grid places that are neighbours within a city-block distance."""
    cell = lambda c: F.floor(F.col(c) / distance)
    keyed = places.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    step = F.sequence(F.lit(-1), F.lit(1))
    spread = keyed.select(F.col("id").alias("b"), F.col("x").alias("_x"), F.col("y").alias("_y"), "_cx", "_cy").withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    spread = spread.select("b", "_x", "_y", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
    edges = keyed.join(spread, ["_cx", "_cy"]).filter((F.col("id") < F.col("b")) & (F.abs(F.col("x") - F.col("_x")) + F.abs(F.col("y") - F.col("_y")) <= distance)).select(F.col("id").alias("a"), "b")
    return places.join(components(places, edges), "id")


def grown_box(box: tuple[float, float, float, float], centre: tuple[float, float], step: float, enough: Callable[[tuple[float, float, float, float]], bool], limit: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """A box whose corner nearest to the centre moves on step by step until the box is large enough, or holds the limit's far corner."""
    x, y = [box[0], box[2]], [box[1], box[3]]
    i, j = (min((0, 1), key=lambda k: abs(v[k] - m)) for v, m in ((x, centre[0]), (y, centre[1])))
    while not enough((x[0], y[0], x[1], y[1])):
        done = (x[0] <= limit[0] if i == 0 else x[1] >= limit[2]) and (y[0] <= limit[1] if j == 0 else y[1] >= limit[3])
        if done:
            break
        x[i] += step * (2 * i - 1)
        y[j] += step * (2 * j - 1)
    return x[0], y[0], x[1], y[1]


def partition_plan(points: DataFrame, plan: str, box: tuple[float, float, float, float], min_points: int, min_area: float, distance: float = 5.0) -> DataFrame:
    """Points with ``part``: 'one' partition, 'uniform' or 'median' quads, or partitions 'surrounding' uncovered places."""
    if plan == "one":
        return points.withColumn("part", F.lit("0"))
    if plan in ("uniform", "median"):
        return quad_split(points, box, min_points, min_area, median=plan == "median").drop("x0", "y0", "x1", "y1").withColumnRenamed("node", "part")
    if plan == "surrounding":
        return surrounding_partitions(points, box, min_points, min_area, distance)
    raise ValueError(f"unknown partition plan {plan!r}")


def surrounding_partitions(points: DataFrame, box: tuple[float, float, float, float], min_points: int, min_area: float, distance: float) -> DataFrame:
    """Points with ``part``: the cluster of uncovered grid places they lie around, '0' for the rest.

    A cluster takes the points within three distances of its places if more than 90 percent
    of its places are inside their hull, else those of its box, grown towards the centre.
    A point near several clusters is in a partition of each, as each fits a plane of its own.
    """
    from skysurvey.operators.scenes import members_near
    from skysurvey.operators.sets import range_anti

    c, spark = F.col, points.sparkSession
    steps = [max(0, math.ceil((box[k + 2] + distance - box[k]) / distance) - 1) for k in (0, 1)]
    grid = spark.range(steps[0] + 1).select((box[0] + c("id") * distance).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(steps[1]))).alias("_j")).select("x", (box[1] + c("_j") * distance).alias("y"))
    free = range_anti(grid, points.select("x", "y"), distance).withColumn("id", (F.rint((c("x") - box[0]) / distance) * (steps[1] + 1) + F.rint((c("y") - box[1]) / distance)).cast("long"))
    clusters = checkpointed(cell_clusters(free, distance + 1e-4).select("x", "y", c("component").alias("cluster")))
    near = checkpointed(members_near(clusters, points, distance))
    # The number of clusters is bounded by the area of the box over that of a grid cell; their outlines are handled one at a time.
    found = None
    for row in clusters.groupBy("cluster").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).orderBy("cluster").toLocalIterator():
        own, places = near.filter(c("cluster") == row[0]), clusters.filter(c("cluster") == row[0])
        hull = convex_hull(own.select("x", "y"))
        share = places.agg(F.avg(in_hull(c("x"), c("y"), hull).cast("double"))).first()[0] if len(hull) >= 3 else 0.0
        if share > 0.9:
            part = own.drop("cluster")
        else:
            count = lambda b: b[2] > b[0] and (b[2] - b[0]) * (b[3] - b[1]) >= min_area and points.filter(in_box(c("x"), c("y"), b)).count() >= min_points
            grown = grown_box((row[1] - distance, row[2] - distance, row[3] + distance, row[4] + distance), ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), distance, count, box)
            part = points.filter(in_box(c("x"), c("y"), grown))
        part = part.withColumn("part", F.lit(str(row[0] + 1)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return points.withColumn("part", F.lit("0"))
    rest = points.join(found.select(*points.columns).distinct(), points.columns, "left_anti")
    return rest.withColumn("part", F.lit("0")).unionByName(found)


def ground_points(points: DataFrame, size: float, window: int, slope: float, threshold: float, scalar: float) -> DataFrame:
    """Simple morphological ground classification: lowest cells, progressive opening, slope-scaled threshold."""
    from skysurvey.operators.raster import neighbours

    cells = points.withColumn("col", F.floor(F.col("x") / size)).withColumn("row", F.floor(F.col("y") / size))
    surface = cells.groupBy("row", "col").agg(F.min("z").alias("value"))
    floor = surface
    for radius in range(1, window + 1):
        eroded = neighbours(floor, radius).groupBy("row", "col").agg(F.min("value").alias("value")).join(surface.select("row", "col"), ["row", "col"])
        opened = neighbours(eroded, radius).groupBy("row", "col").agg(F.max("value").alias("_o"))
        kept = floor.join(opened, ["row", "col"]).withColumn("_cut", F.col("value") - F.col("_o") > slope * radius * size)
        floor = kept.select("row", "col", F.when(F.col("_cut"), F.col("_o")).otherwise(F.col("value")).alias("value"))
    ok = F.col("z") - F.col("value") <= threshold + scalar * slope * size
    return cells.join(floor, ["row", "col"]).withColumn("ground", ok).select(*points.columns, "ground")


def overlapping_submodels(points: DataFrame, size: float, overlap: float) -> DataFrame:
    """Points with every submodel (cell of a size) whose box, grown by the overlap, holds them."""
    low = lambda c: F.floor((F.col(c) - overlap) / size)
    high = lambda c: F.floor((F.col(c) + overlap) / size)
    out = points.withColumn("sub_col", F.explode(F.sequence(low("x"), high("x")))).withColumn("sub_row", F.explode(F.sequence(low("y"), high("y"))))
    return out.withColumn("core", (F.floor(F.col("x") / size) == F.col("sub_col")) & (F.floor(F.col("y") / size) == F.col("sub_row")))
