"""Operators on sets of records: filters, joins, aggregations, order-sensitive and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skysurvey.session import checkpointed

#: Order of known bands; others come after, by the text '9' and their index.
BAND_ORDER = {"RGB": "0", "RED": "1", "R": "1", "GREEN": "2", "G": "2", "BLUE": "3", "B": "3", "NIR": "4", "N": "4", "REDEDGE": "5", "RE": "5", "PANCHRO": "6", "LWIR": "7", "L": "7"}


def band_key(name: Column, index: Column) -> Column:
    """The sort key of a band, a string."""
    table = F.create_map(*(F.lit(x) for kv in BAND_ORDER.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(name)), F.concat(F.lit("9"), index.cast("string")))


def ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with its place from 1 in a total order, without sorting it in one task.

    Rows are range-partitioned and kept so; a row's place is its place in its partition
    after the counts of the partitions before it, of which there are few.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_b")).drop("_part", "_own", "_b")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row for each key and task."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(least.alias("_r")).select(*keys, "_r.*")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_r")).select(*keys, "_r.*")


def drop_redundant_bands(photos: DataFrame, band: str = "band_name", make: str | None = None, model: str | None = None, order: str | None = None) -> DataFrame:
    """where photos of a combined band lie among photos of single red, green and blue bands, one kind goes.

    The combined band goes if all three single bands are there, or red and green of a
    camera whose colour lens differs (known by make and model of the first photo by
    ``order``); otherwise the single ones go. Without a combined band nothing goes, and
    neither does it for fewer than two bands.
    """
    name = F.lower(band)
    marks = {b: F.coalesce(F.max(name == b), F.lit(False)).alias(f"_{b}") for b in ("red", "green", "blue", "rgb", "redgreenblue")}
    other_lens = F.lit(False)
    if make and model and order:
        other_lens = F.min_by(F.upper(make).eqNullSafe("DJI") & F.upper(model).eqNullSafe("M3M"), order)
    has = photos.agg(*marks.values(), F.coalesce(other_lens, F.lit(False)).alias("_lens"))
    c = F.col
    mixed, drop_mixed = c("_rgb") | c("_redgreenblue"), c("_red") & c("_green") & (c("_blue") | c("_lens"))
    main = F.when(c("_rgb"), "rgb").otherwise("redgreenblue")
    gone = has.select(F.when(~mixed, F.array().cast("array<string>")).when(drop_mixed, F.array(main)).otherwise(F.array(F.lit("red"), F.lit("green"), F.lit("blue"))).alias("_gone"))
    return photos.crossJoin(F.broadcast(gone)).filter(~F.coalesce(F.array_contains("_gone", name), F.lit(False))).drop("_gone")


def complete_captures(photos: DataFrame, capture: str, band: str) -> DataFrame:
    """photos of captures that have every band."""
    bands = photos.select(band).distinct().agg(F.count("*").alias("_n"))
    full = photos.groupBy(capture).agg(F.countDistinct(band).alias("_k")).join(F.broadcast(bands), F.col("_k") == F.col("_n"))
    return photos.join(full.select(capture), capture, "left_semi")


def band_counts(photos: DataFrame, band: str, order: str) -> DataFrame:
    """A1: photos of each band; ``most`` marks the band with most photos, the first one among equals."""
    counts = photos.groupBy(band).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = counts.agg(F.min_by(band, F.struct(-F.col("n"), F.col("first"))).alias("_top"))
    return counts.crossJoin(F.broadcast(top)).select(band, "n", (F.col(band) == F.col("_top")).alias("most"))


def overwrite(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], together: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Left with the columns of right where a row matches; groups in ``together`` only if all are present."""
    grouped = {c: g for g in together for c in g}
    slim = right.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = left.join(slim, key, "left")

    def new(c: str) -> Column:
        ready = F.col("_hit")
        for g in grouped.get(c, ()):
            ready = ready & F.col(f"_{g}").isNotNull()
        value = F.col(f"_{c}")
        return F.when(F.coalesce(ready, F.lit(False)), value).otherwise(F.col(c)) if c in grouped else F.coalesce(value, F.col(c))

    return joined.select(*(new(c).alias(c) if c in columns else F.col(c) for c in left.columns))


def match_bands(photos: DataFrame, capture: str, band: str, primary: str, filename: str, order: str) -> DataFrame:
    """(secondary, primary) file names.

    By capture id if it is present everywhere, unique on the primary band and known
    there; otherwise by file names without their last word, for all photos.
    """
    main = F.col(band) == primary
    keys = photos.filter(main).groupBy(capture).agg(F.count("*").alias("_k"))
    known = photos.join(keys, capture, "left").agg(F.max((F.col("_k").isNull() | (F.col("_k") > 1)).cast("int")).alias("_bad"))
    stem = F.regexp_replace(F.col(filename), r"^(.+)[-_]\w+(\.[A-Za-z]{3,4})$", "$1$2")
    tagged = photos.crossJoin(F.broadcast(known)).withColumn("_key", F.when(F.coalesce("_bad", F.lit(0)) == 1, stem).otherwise(F.col(capture).cast("string")))
    lead = tagged.filter(main).groupBy("_key").agg(F.max_by(filename, order).alias("primary"))
    return tagged.join(lead, "_key", "left").select(F.col(filename).alias("secondary"), "primary")


def interval_join(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, by: Sequence[str], carry: Sequence[str], width: float) -> DataFrame:
    """Points with the columns of the first span that holds their time, null outside all spans.

    Times meet through buckets of ``width`` seconds, so the join is on equal keys and a
    long recording is spread over many buckets.
    """
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    low, high = F.floor(seconds(F.col(start)) / width), F.floor(seconds(F.col(end)) / width)
    cut = spans.filter(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), *(F.col(c).alias(f"_{c}") for c in carry), F.explode(F.sequence(low, high)).alias("_b"))
    keyed = points.withColumn("_b", F.floor(seconds(F.col(time)) / width)).withColumn("_id", F.monotonically_increasing_id())
    hits = keyed.join(cut, [*by, "_b"], "left").withColumn("_in", (F.col(time) >= F.col("_s")) & (F.col(time) <= F.col("_e")))
    value = F.struct(*(F.col(f"_{c}").alias(c) for c in carry))
    best = F.min_by(F.when(F.col("_in"), value), F.when(F.col("_in"), F.col("_s")))
    return hits.groupBy(*points.columns, "_id").agg(best.alias("_v")).select(*points.columns, *(F.col(f"_v.{c}").alias(c) for c in carry))


def _time_bucket(time: str, width: float) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6) / width)


def _beside(buckets: DataFrame, by: str, last: str, first: str) -> DataFrame:
    """(by, _b) with _before and _after: the last entry of the buckets before and the first of those after, of the same recording."""
    w = Window.partitionBy(by).orderBy("_b")
    before = F.last(last, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(first, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return buckets.select(by, "_b", before.alias("_before"), after.alias("_after"))


def distinct_fixes(fixes: DataFrame, by: str, time: str, width: float = 3600.0) -> DataFrame:
    """Fixes that are first, last, or at another place than the one before.

    A recording is cut into buckets of ``width`` seconds, which are ordered each for itself;
    a bucket's first fix is compared with the last one of the buckets before.
    """
    cut = fixes.withColumn("_b", _time_bucket(time, width))
    place = F.struct(F.col(time).alias("t"), F.col("x").alias("x"), F.col("y").alias("y"))
    ends = _beside(cut.groupBy(by, "_b").agg(F.max(place).alias("_l"), F.min(place).alias("_f")), by, "_l", "_f")
    w = Window.partitionBy(by, "_b").orderBy(time, "x", "y")
    last = F.coalesce(F.lag(place).over(w), F.col("_before"))
    moved = (last["x"] != F.col("x")) | (last["y"] != F.col("y"))
    ended = F.lead(time).over(w).isNull() & F.col("_after").isNull()
    return cut.join(ends, [by, "_b"]).withColumn("_m", F.coalesce(moved, F.lit(True)) | ended).filter("_m").select(*fixes.columns)


def asof_interpolate(queries: DataFrame, fixes: DataFrame, by: str, time: str, columns: Sequence[str], width: float = 3600.0) -> DataFrame:
    """Queries with columns interpolated between the fixes before and after them.

    An exact time takes that fix; before the first and after the last fix the values are
    null. A recording is cut into buckets of ``width`` seconds, which are ordered each for
    itself; the nearest fixes of other buckets come from the buckets' ends.
    """
    left = queries.select(*queries.columns, F.lit(1).alias("_q"), *(F.lit(None).cast(fixes.schema[c].dataType).alias(f"_{c}") for c in columns), F.lit(None).cast("timestamp").alias("_t"))
    shape = [F.lit(None).cast(queries.schema[c].dataType).alias(c) if c not in (by, time) else F.col(c) for c in queries.columns]
    right = fixes.select(*shape, F.lit(0).alias("_q"), *(F.col(c).alias(f"_{c}") for c in columns), F.col(time).alias("_t"))
    value = F.when(F.col("_q") == 0, F.struct(F.col("_t").alias("t"), *(F.col(f"_{c}").alias(c) for c in columns)))
    both = left.unionByName(right).withColumn("_v", value).withColumn("_b", _time_bucket(time, width))
    ends = _beside(both.groupBy(by, "_b").agg(F.max("_v").alias("_l"), F.min("_v").alias("_f")), by, "_l", "_f")
    before = Window.partitionBy(by, "_b").orderBy(time, "_q").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by, "_b").orderBy(time, F.desc("_q")).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_p", F.last("_v", ignorenulls=True).over(before)).withColumn("_n", F.first("_v", ignorenulls=True).over(after)).filter("_q = 1")
    near = near.join(ends, [by, "_b"]).withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    at, t0, t1 = (F.unix_micros(c).cast("double") for c in (F.col(time), F.col("_p.t"), F.col("_n.t")))
    share = F.when(t1 > t0, (at - t0) / (t1 - t0)).when(t1 == t0, 0.0)
    return near.select(*queries.columns, *((F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * share).alias(c) for c in columns))


def nearest(queries: DataFrame, points: DataFrame, key: str, k: int, cell: float, distinct: bool = False) -> DataFrame:
    """(key, x, y, point columns, distance, rank) of the k nearest points in the plane, of all where there are fewer.

    Points of a query's cell and the eight around it meet by equal cell keys. A query is
    done if k of them are nearer than the edge of these cells; the others go on with cells
    of twice the size, of the last round's results written to the shared folder. Queries
    of one place share one search, and places of points are ranked before the points of the
    first few: no more than k points of a place can be among the nearest. With distinct,
    equal points count once. Queries and points without a place are left out.
    """
    c = F.col
    placed = "x IS NOT NULL AND y IS NOT NULL"
    left, points = queries.filter(placed), points.filter(placed)
    ends = lambda df: df.agg(*(f(v) for v in "xy" for f in (F.min, F.max)), F.count("*")).first()
    a, b = ends(left), ends(points)
    extra = [v for v in points.columns if v not in ("x", "y")]
    if not a[4] or not b[4]:
        return left.join(points.select(F.lit(None).cast("double").alias("_px"), F.lit(None).cast("double").alias("_py"), *extra), F.lit(False)).withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(0))
    extent = max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2]))
    renamed = points.withColumnsRenamed({"x": "_px", "y": "_py"})
    here, there = ["x", "y"], ["_px", "_py"]
    step, size = F.sequence(F.lit(-1), F.lit(1)), cell
    places = checkpointed(left.select(*here).distinct())
    done: DataFrame | None = None
    while count := places.count():
        last = size > extent  # every point is in the cells around every query
        at = lambda v: F.floor(c(v) / size)  # noqa: E731, B023
        near = places.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumn("_cx", at("x") + c("_dx")).withColumn("_cy", at("y") + c("_dy")).drop("_dx", "_dy")
        cells = near.select("_cx", "_cy").distinct()
        close = renamed.withColumn("_cx", at("_px")).withColumn("_cy", at("_py")).join(F.broadcast(cells) if count <= 10_000 else cells, ["_cx", "_cy"], "left_semi")
        first = Window.partitionBy(*there).orderBy(*(extra or there))
        close = close.distinct() if distinct else close
        close = checkpointed(close.withColumn("_i", F.row_number().over(first)).filter(c("_i") <= k))
        spots = close.groupBy("_cx", "_cy", *there).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*here).orderBy("distance", *there)
        pairs = near.join(spots, ["_cx", "_cy"]).withColumn("distance", F.hypot(c("x") - c("_px"), c("y") - c("_py")))
        pairs = pairs.withColumn("_r", F.row_number().over(order)).filter(c("_r") <= k)
        before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pairs = pairs.withColumn("_before", before).filter(c("_before") < k).select(*here, *there, "distance", "_before")
        found = pairs.join(close.select(*there, *extra, "_i"), there).withColumn("rank", (c("_before") + c("_i")).cast("int")).filter(c("rank") <= k)
        edge = size + F.least(*(f for v in "xy" for f in (F.pmod(c(v), F.lit(size)), size - F.pmod(c(v), F.lit(size)))))
        sure = F.lit(True) if last else F.sum((c("distance") <= edge).cast("int")).over(Window.partitionBy(*here)) >= k
        found = checkpointed(found.select(*here, *there, *extra, "distance", "rank", sure.alias("_sure")))
        fine = found.filter("_sure").drop("_sure")
        done = fine if done is None else done.unionByName(fine)
        if last:
            break
        places = checkpointed(places.join(fine.select(*here).distinct(), here, "left_anti"))
        size *= 2
    return left.join(done, here).select(*left.columns, *there, *extra, "distance", "rank")


def range_anti(grid: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Grid places with no point within distance - 1e-5 (city-block)."""
    limit = distance - 1e-5
    cell = lambda c: F.floor(F.col(c) / distance)
    cells = points.select(F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    step = F.sequence(F.lit(-1), F.lit(1))
    cells = cells.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select("_x", "_y", (F.col("_cx") + F.col("_dx")).alias("_gx"), (F.col("_cy") + F.col("_dy")).alias("_gy"))
    near = (F.abs(F.col("x") - F.col("_x")) + F.abs(F.col("y") - F.col("_y"))) <= limit
    return grid.join(cells, (cell("x") == F.col("_gx")) & (cell("y") == F.col("_gy")) & near, "left_anti")


def ramp_lookup(values: DataFrame, stops: Sequence[tuple[float, float]], column: str, out: str) -> DataFrame:
    """Values interpolated between a few constant stops; the ends are held."""
    expr = F.lit(float(stops[-1][1]))
    for (a, u), (b, v) in reversed(list(zip(stops, stops[1:]))):
        expr = F.when(F.col(column) < b, u + (F.col(column) - a) / (b - a) * (v - u)).otherwise(expr)
    return values.withColumn(out, F.when(F.col(column) <= stops[0][0], float(stops[0][1])).otherwise(expr))


def gcp_quality(gcp: DataFrame) -> DataFrame:
    """Observations of each ground point: insufficient below 2, not ideal below 3."""
    counts = gcp.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    return counts.withColumn("quality", F.when(F.col("n") < 2, "insufficient").when(F.col("n") < 3, "not ideal").otherwise("good"))


def numbered_by_first(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Groups numbered from 1 by their first appearance."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_f"))
    numbers = ranked(first, ["_f"], out).drop("_f")
    return df.join(numbers, list(keys))


def mean_offset(x: Column, y: Column, ground_control: bool = False) -> list[Column]:
    """The whole-number origin of a set: floor for camera places, half-even rounding for ground control."""
    turn = (lambda c: F.rint(F.avg(c))) if ground_control else (lambda c: F.floor(F.avg(c)))
    return [turn(x).cast("long").alias("east"), turn(y).cast("long").alias("north")]


def valid_captures(photos: DataFrame, capture: str, expected: int, order: Sequence[str], digits: int = 4) -> DataFrame:
    """Captures with the expected number of photos, numbered in order, equal ones by their id, and padded."""
    groups = photos.groupBy(capture).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_o"))
    good = ranked(groups.filter(F.col("_n") == expected), ["_o", capture], "number").select(capture, F.lpad(F.col("number").cast("string"), digits, "0").alias("number"))
    return photos.join(good, capture, "left").withColumn("valid", F.col("number").isNotNull())


def linspace_pick(frames: DataFrame, limit: int, order: str) -> DataFrame:
    """``limit`` of the rows at even steps from the first to the last, by their order."""
    placed = ranked(frames, [order], "_i").withColumn("_i", F.col("_i") - 1)
    numbered = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("_n"))))
    # Row i is picked if it is the truncated place of some step k.
    step = (F.col("_n") - 1) / F.lit(max(limit - 1, 1))
    k = F.ceil(F.col("_i") / step)
    hit = (F.col("_n") <= limit) | (step == 0) | ((F.floor(k * step) == F.col("_i")) & (k < limit))
    return numbered.filter(hit).drop("_i", "_n")


def union_clouds(first: DataFrame, second: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Both clouds with all dimensions, defaults where one lacks a dimension."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.fillna({k: v for k, v in defaults.items() if k in both.columns})


def remaining(whole: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """U11, U12."""
    return whole.join(marked.select(key), key, "left_anti")


def option_changes(current: dict[str, str], previous: dict[str, str], stage_of: dict[str, str], stages: Sequence[str]) -> list[str]:
    """The stages to run again after options changed: all from the first affected one."""
    changed = {stage_of[k] for k, v in current.items() if stage_of.get(k) in stages and previous.get(k) != v}
    if "split" in current and stage_of.get("split") and previous.get("split") != current["split"]:
        return list(stages[stages.index("dataset") :]) if "dataset" in stages else list(stages)
    return list(stages[min(stages.index(s) for s in changed) :]) if changed else []


def systematic(points: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """every n-th point of a total order, the first one included."""
    return points if n <= 1 else ranked(points, order, "_i").filter((F.col("_i") - 1) % n == 0).drop("_i")


def chunks(points: DataFrame, capacity: int, order: Sequence[str]) -> DataFrame:
    """U4: points with ``chunk``, from 0, of at most so many points each, in a total order."""
    return ranked(points, order, "_i").withColumn("chunk", F.floor((F.col("_i") - 1) / capacity)).drop("_i")
