"""Queries over sets of records: filters, joins, aggregations and order-sensitive operators."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skysurvey.operators import points as O, sets as S
from skysurvey.plans.adapters import domain, oracle
from skysurvey.session import table

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


@query("""
    WITH n AS (SELECT band_name, count(*) AS n, min(ord) AS f FROM photos WHERE ord % 7 <> 3 GROUP BY band_name)
    SELECT band_name, n, band_name = (SELECT band_name FROM n ORDER BY n DESC, f LIMIT 1) AS most FROM n
""")
def band_photo_counts(spark, sf_dir):
    """A1, A2."""
    return S.band_counts(domain(spark, sf_dir, "photos").filter("ord % 7 <> 3"), "band_name", "ord")


@query("""
    WITH p AS (SELECT * FROM photos WHERE ord % 7 <> 3), k AS (SELECT capture FROM p GROUP BY capture HAVING count(DISTINCT band_name) = (SELECT count(DISTINCT band_name) FROM p))
    SELECT ord, capture, band_name FROM p WHERE capture IN (SELECT capture FROM k)
""")
def complete_band_sets(spark, sf_dir):
    """F2, A3."""
    return S.complete_captures(domain(spark, sf_dir, "photos").filter("ord % 7 <> 3"), "capture", "band_name").select("ord", "capture", "band_name")


@query("""
    WITH p AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN 'RGB' ELSE band_name END AS band_name FROM photos)
    SELECT 'all' AS survey, ord, band_name FROM p WHERE band_name <> 'RGB' UNION ALL SELECT 'no_blue', ord, band_name FROM p WHERE band_name NOT IN ('Red', 'Green', 'Blue')
    UNION ALL SELECT 'other_lens', ord, band_name FROM p WHERE band_name NOT IN ('RGB', 'Blue') UNION ALL SELECT 'no_colour', ord, band_name FROM p WHERE band_name <> 'RGB'
    UNION ALL SELECT 'joined', ord, 'RedGreenBlue' FROM p WHERE band_name = 'RGB' UNION ALL SELECT 'joined', ord, band_name FROM p WHERE band_name IN ('NIR', 'RedEdge')
""")
def redundant_bands(spark, sf_dir):
    """five surveys with other bands missing."""
    p = domain(spark, sf_dir, "photos").select("ord", F.when(c("ord") % 9 == 0, "RGB").otherwise(c("band_name")).alias("band_name"))
    m3m = p.filter("band_name <> 'Blue'").select("*", F.lit("DJI").alias("make"), F.lit("M3M").alias("model"))
    joined = p.filter("band_name <> 'Green'").withColumn("band_name", F.when(c("band_name") == "RGB", "RedGreenBlue").otherwise(c("band_name")))
    surveys = {
        "all": S.drop_redundant_bands(p), "no_blue": S.drop_redundant_bands(p.filter("band_name <> 'Blue'")), "other_lens": S.drop_redundant_bands(m3m, make="make", model="model", order="ord"),
        "no_colour": S.drop_redundant_bands(p.filter("band_name <> 'RGB'")), "joined": S.drop_redundant_bands(joined),
    }
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("survey"), "ord", "band_name") for name, df in surveys.items()))


@query("""
    SELECT p.ord, CASE WHEN g.ord IS NULL THEN p.latitude ELSE g.lat END AS latitude, CASE WHEN g.yaw IS NOT NULL AND g.pitch IS NOT NULL THEN g.yaw ELSE p.yaw END AS yaw,
           CASE WHEN g.yaw IS NOT NULL AND g.pitch IS NOT NULL THEN g.pitch ELSE p.pitch END AS pitch
    FROM photos p LEFT JOIN (SELECT ord, latitude + 1 AS lat, CASE WHEN ord % 6 <> 0 THEN 5.0 END AS yaw, CASE WHEN ord % 10 <> 0 THEN 7.0 END AS pitch FROM photos WHERE ord % 2 = 0) g ON p.ord = g.ord
""")
def geo_overrides(spark, sf_dir):
    """Positions from a second file; angles only where all are given."""
    p = domain(spark, sf_dir, "photos").select("ord", "latitude", "yaw", "pitch")
    g = p.filter("ord % 2 = 0").select("ord", (c("latitude") + 1).alias("latitude"), F.when(c("ord") % 6 != 0, 5.0).alias("yaw"), F.when(c("ord") % 10 != 0, 7.0).alias("pitch"))
    return S.overwrite(p, g, "ord", ["latitude", "yaw", "pitch"], [["yaw", "pitch"]])


@query("SELECT g.id, g.filename, p.ord FROM gcp g JOIN photos p ON g.filename = p.filename")
def gcp_photos(spark, sf_dir):
    """Ground control with the photos it is seen in."""
    return domain(spark, sf_dir, "gcp").join(domain(spark, sf_dir, "photos").select("filename", "ord"), "filename").select("id", "filename", "ord")


@query("SELECT id, filename FROM gcp WHERE filename NOT IN (SELECT filename FROM photos)")
def gcp_rejects(spark, sf_dir):
    """Ground control in no photo."""
    return domain(spark, sf_dir, "gcp").join(domain(spark, sf_dir, "photos").select("filename"), "filename", "left_anti").select("id", "filename")


@query("SELECT x, y, z, count(*) AS n, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN count(*) < 3 THEN 'not ideal' ELSE 'good' END AS quality FROM gcp GROUP BY x, y, z")
def gcp_observations(spark, sf_dir):
    """A7."""
    return S.gcp_quality(domain(spark, sf_dir, "gcp"))


@query("SELECT id, dense_rank() OVER (ORDER BY f) AS number FROM (SELECT id, min(id) OVER (PARTITION BY x, y, z) AS f FROM gcp) AS t")
def gcp_numbers(spark, sf_dir):
    """A8, W8."""
    return S.numbered_by_first(domain(spark, sf_dir, "gcp"), ["x", "y", "z"], "id", "number").select("id", c("number").cast("long").alias("number"))


@query("SELECT CAST(floor(avg(x)) AS BIGINT) AS east, CAST(floor(avg(y)) AS BIGINT) AS north, CAST(round_even(avg(x), 0) AS BIGINT) AS east_gcp, CAST(round_even(avg(y), 0) AS BIGINT) AS north_gcp FROM gcp")
def origin_offsets(spark, sf_dir):
    """A6."""
    g = domain(spark, sf_dir, "gcp")
    gps, control = S.mean_offset(c("x"), c("y")), S.mean_offset(c("x"), c("y"), True)
    return g.agg(*gps, *(v.alias(f"{k}_gcp") for v, k in zip(control, ("east", "north"))))


@query("""
    SELECT s.filename AS secondary, p.filename AS "primary" FROM photos s LEFT JOIN photos p ON s.capture = p.capture AND p.band_name = 'Green'
""")
def band_matches(spark, sf_dir):
    """Secondary bands with their capture's primary photo."""
    return S.match_bands(domain(spark, sf_dir, "photos"), "capture", "band_name", "Green", "filename", "ord")


@query("""
    SELECT s.filename AS secondary, p.filename AS "primary" FROM photos s LEFT JOIN photos p ON s.capture = p.capture AND p.band_name = 'Green'
""")
def band_matches_by_name(spark, sf_dir):
    """One missing capture id sends the whole join to the file names."""
    p = domain(spark, sf_dir, "photos").withColumn("capture", F.when(c("ord") != 7, c("capture")))
    return S.match_bands(p, "capture", "band_name", "Green", "filename", "ord")


_CUES = "SELECT id, track, ts AS s, lead(ts) OVER (PARTITION BY track ORDER BY ts) AS e, x FROM fixes"


@query(f"""
    WITH cue AS ({_CUES}), q AS (SELECT id AS qid, track, ts + INTERVAL 10 MINUTE AS t FROM fixes WHERE id % 5 = 0),
    m AS (SELECT qid, x, row_number() OVER (PARTITION BY qid ORDER BY s) AS rn FROM q JOIN cue ON q.track = cue.track AND q.t >= cue.s AND q.t <= cue.e)
    SELECT q.qid, q.track, m.x FROM q LEFT JOIN m ON q.qid = m.qid AND m.rn = 1
""")
def cue_lookup(spark, sf_dir):
    """The first cue that holds a time."""
    f = domain(spark, sf_dir, "fixes").withColumn("ts", c("ts").cast("timestamp"))
    cue = f.select("track", c("ts").alias("s"), F.lead("ts").over(Window.partitionBy("track").orderBy("ts")).alias("e"), "x").filter("e IS NOT NULL")
    q = f.filter("id % 5 = 0").select(c("id").alias("qid"), "track", (c("ts") + F.expr("INTERVAL 10 MINUTE")).alias("t"))
    return S.interval_join(q, cue, "t", "s", "e", ["track"], ["x"], 3600.0).select("qid", "track", "x")


@query("""
    WITH g AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lead(ts) OVER w AS nx FROM (SELECT id, track, ts, floor(x / 40) AS x, floor(y / 40) AS y FROM fixes) AS f WINDOW w AS (PARTITION BY track ORDER BY ts))
    SELECT id, track, x, y FROM g WHERE lx IS NULL OR x <> lx OR y <> ly OR nx IS NULL
""")
def distinct_positions(spark, sf_dir):
    """W1."""
    f = domain(spark, sf_dir, "fixes").select("id", "track", "ts", F.floor(c("x") / 40).cast("double").alias("x"), F.floor(c("y") / 40).cast("double").alias("y"))
    return S.distinct_fixes(f, "track", "ts").select("id", "track", "x", "y")


@query("""
    WITH f AS (SELECT track, ts, x, y FROM fixes WHERE id % 4 <> 0), q AS (SELECT id, track, ts + INTERVAL 7 SECOND AS ts FROM fixes WHERE id % 4 = 0),
    a AS (SELECT q.id, q.track, q.ts, f.ts AS t0, f.x AS x0, f.y AS y0 FROM q ASOF LEFT JOIN f ON q.track = f.track AND q.ts >= f.ts),
    b AS (SELECT a.*, f.ts AS t1, f.x AS x1, f.y AS y1 FROM a ASOF LEFT JOIN f ON a.track = f.track AND a.ts <= f.ts)
    SELECT id, track, round(x0 + (x1 - x0) * CASE WHEN t1 > t0 THEN CAST(epoch_us(ts) - epoch_us(t0) AS DOUBLE) / (epoch_us(t1) - epoch_us(t0)) WHEN t1 = t0 THEN 0 END, 6) AS x,
           round(y0 + (y1 - y0) * CASE WHEN t1 > t0 THEN CAST(epoch_us(ts) - epoch_us(t0) AS DOUBLE) / (epoch_us(t1) - epoch_us(t0)) WHEN t1 = t0 THEN 0 END, 6) AS y FROM b
""")
def asof_positions(spark, sf_dir):
    """J10, W2."""
    f = domain(spark, sf_dir, "fixes").withColumn("ts", c("ts").cast("timestamp"))
    q = f.filter("id % 4 = 0").select("id", "track", (c("ts") + F.expr("INTERVAL 7 SECOND")).alias("ts"))
    out = S.asof_interpolate(q, f.filter("id % 4 <> 0").withColumn("id", F.lit(None).cast("long")), "track", "ts", ["x", "y"])
    return out.select("id", "track", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
    WITH p AS (SELECT DISTINCT x, y, z FROM points), s AS (SELECT id, x, y FROM gcp),
    d AS (SELECT s.id, p.z, row_number() OVER (PARTITION BY s.id ORDER BY sqrt((p.x - s.x)*(p.x - s.x) + (p.y - s.y)*(p.y - s.y)), p.x, p.y, p.z) AS rn FROM s, p)
    SELECT id, round(median(z), 6) AS ground FROM d WHERE rn <= 9 GROUP BY id
""")
def ground_heights(spark, sf_dir):
    """The median height of the 9 nearest points."""
    p = domain(spark, sf_dir, "points").select("x", "y", "z")
    return S.nearest(domain(spark, sf_dir, "gcp").select("id", "x", "y"), p, "id", 9, 4.0, distinct=True).groupBy("id").agg(F.round(F.median("z"), 6).alias("ground"))


@query("""
    WITH p AS (SELECT x, y FROM gaps), g AS (SELECT CAST(i * 4 AS DOUBLE) AS x, CAST(j * 4 AS DOUBLE) AS y FROM range(0, 51) a(i), range(0, 26) b(j))
    SELECT x, y FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE abs(p.x - g.x) + abs(p.y - g.y) <= 4 - 1e-5)
""")
def uncovered_grid(spark, sf_dir):
    """Grid places without a point nearby."""
    p = domain(spark, sf_dir, "gaps").select("x", "y")
    g = spark.range(51).select((c("id") * 4).cast("double").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(25)))).withColumn("y", (c("y") * 4).cast("double"))
    return S.range_anti(g, p, 4.0)


@query("""
    SELECT id, CASE WHEN red <= 0 THEN 10.0 WHEN red < 50 THEN 10 + red / 50 * 20 WHEN red < 150 THEN 30 + (red - 50) / 100 * 40 WHEN red < 255 THEN 70 + (red - 150) / 105 * 30 ELSE 100 END AS shade FROM pixels
""")
def colour_ramp(spark, sf_dir):
    """J19, S30."""
    return S.ramp_lookup(domain(spark, sf_dir, "pixels"), [(0, 10), (50, 30), (150, 70), (255, 100)], "red", "shade").select("id", "shade")


@query("""
    WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT vec_id AS other, embedding AS e FROM embeddings),
    d AS (SELECT q.vec_id, t.other, round(list_sum([(CAST(q.e[i] AS DOUBLE) - t.e[i]) * (CAST(q.e[i] AS DOUBLE) - t.e[i]) for i in range(1, 65)]), 6) AS d2 FROM q, t WHERE q.vec_id <> t.other),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS rn FROM d)
    SELECT a.vec_id, a.other, a.d2 < 0.49 * b.d2 AS kept FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.rn = 1 AND b.rn = 2
""")
def descriptor_matches(spark, sf_dir):
    """The two nearest descriptors of a stated query set, and the ratio test."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select("vec_id", c("embedding").alias("e"))
    blocks = max(1, math.ceil(asked.count() / 4096))  # one block of about 4096 queries is broadcast at a time
    return functools.reduce(DataFrame.unionByName, (_two_nearest(e, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)) for b in range(blocks)))


def _two_nearest(e: DataFrame, asked: DataFrame) -> DataFrame:
    pairs = e.select(c("vec_id").alias("other"), c("embedding").alias("f")).join(F.broadcast(asked), c("vec_id") != c("other"))
    d2 = F.aggregate(F.zip_with("e", "f", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    # The rank limit is applied before the shuffle, so two candidates of each task travel.
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "other"))
    two = pairs.select("vec_id", "other", F.round(d2, 6).alias("d2")).withColumn("rn", rank).filter("rn <= 2")
    best = two.groupBy("vec_id").agg(F.min(F.struct("d2", "other")).alias("a"), F.max("d2").alias("b"))
    return best.select("vec_id", c("a.other").alias("other"), (c("a.d2") < 0.49 * c("b")).alias("kept"))


@query("""
    SELECT filename, ord FROM (SELECT filename, ord, row_number() OVER (PARTITION BY filename ORDER BY pass, ord) AS rn
    FROM (SELECT filename, ord, 1 AS pass FROM photos WHERE ord % 3 <> 0 UNION ALL SELECT filename, ord + 1000000, 2 FROM photos WHERE ord % 2 = 0) AS u) AS t WHERE rn = 1
""")
def merged_shots(spark, sf_dir):
    """Union of files, the first entry of a name wins."""
    p = domain(spark, sf_dir, "photos")
    both = p.filter("ord % 3 <> 0").select("filename", "ord", F.lit(1).alias("pass")).unionByName(p.filter("ord % 2 = 0").select("filename", (c("ord") + 1000000).alias("ord"), F.lit(2).alias("pass")))
    return S.first_by(both, ["filename"], [c("pass"), c("ord")]).select("filename", "ord")


@query("""
    WITH g AS (SELECT capture, count(*) AS n, min(struct_pack(t := taken, f := filename)) AS o FROM photos WHERE ord % 7 <> 3 GROUP BY capture),
    v AS (SELECT capture, lpad(CAST(row_number() OVER (ORDER BY o) AS STRING), 6, '0') AS number FROM g WHERE n = 5)
    SELECT p.ord, v.number, v.number IS NOT NULL AS valid FROM photos p LEFT JOIN v ON p.capture = v.capture WHERE p.ord % 7 <> 3
""")
def exif_bins(spark, sf_dir):
    """A31, C6, T6, W8."""
    return S.valid_captures(domain(spark, sf_dir, "photos").filter("ord % 7 <> 3"), "capture", 5, ["taken", "filename"], 6).select("ord", "number", "valid")


@query("""
    WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM fixes), k AS (SELECT DISTINCT CAST(floor(k * ((SELECT max(n) FROM n) - 1) / 99.0) AS BIGINT) AS i FROM range(0, 100) r(k))
    SELECT id FROM n WHERE i IN (SELECT i FROM k)
""")
def frame_limit(spark, sf_dir):
    """F15, T9."""
    return S.linspace_pick(domain(spark, sf_dir, "fixes").select("id"), 100, "id")


@query("SELECT ord, CASE upper(band_name) WHEN 'RED' THEN '1' WHEN 'GREEN' THEN '2' WHEN 'BLUE' THEN '3' WHEN 'NIR' THEN '4' WHEN 'REDEDGE' THEN '5' END AS band_key, CASE WHEN ord % 2 = 0 THEN concat('9', CAST(band_index AS STRING)) ELSE '7' END AS other_key FROM photos")
def band_order(spark, sf_dir):
    """T1, T8."""
    return domain(spark, sf_dir, "photos").select("ord", S.band_key(c("band_name"), c("band_index")).alias("band_key"), S.band_key(F.when(c("ord") % 2 == 0, "odd").otherwise("LWIR"), c("band_index")).alias("other_key"))


@query("""
    SELECT max(width) AS width, max(height) AS height, max(greatest(width, height)) AS side, (SELECT ord FROM photos ORDER BY width * height DESC, ord LIMIT 1) AS largest, round(avg(epoch_ms(taken) / 1000.0), 0) AS mean_time FROM photos
""")
def largest_photo(spark, sf_dir):
    """A4, A5."""
    return domain(spark, sf_dir, "photos").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.max(F.greatest("width", "height")).alias("side"),
        F.min_by("ord", F.struct(-c("width") * c("height"), c("ord"))).alias("largest"), F.round(F.avg(F.unix_millis(c("taken").cast("timestamp")) / 1000), 0).alias("mean_time"),
    )


@query("SELECT capture, max(CASE WHEN band_name = 'Red' THEN ord END) AS red, max(CASE WHEN band_name = 'Green' THEN ord END) AS green, max(CASE WHEN band_name = 'NIR' THEN ord END) AS nir FROM photos GROUP BY capture")
def band_stack(spark, sf_dir):
    """U15."""
    return domain(spark, sf_dir, "photos").groupBy("capture").pivot("band_name", ["Red", "Green", "NIR"]).agg(F.max("ord")).withColumnsRenamed({"Red": "red", "Green": "green", "NIR": "nir"})


@query("SELECT ord, zero, zero > 0.05 AS no_altitude FROM (SELECT CAST(floor(ord / 1000) AS BIGINT) AS ord, avg(CASE WHEN altitude IS NULL OR altitude < 30 THEN 1.0 ELSE 0 END) AS zero FROM photos GROUP BY 1) AS t")
def altitude_check(spark, sf_dir):
    """F13, F14."""
    low = F.avg(F.when(c("altitude").isNull() | (c("altitude") < 30), 1.0).otherwise(0.0))
    return domain(spark, sf_dir, "photos").groupBy(F.floor(c("ord") / 1000).alias("ord")).agg(low.alias("zero")).withColumn("no_altitude", c("zero") > 0.05)


@query("""
    SELECT band_name, pilot_group, count(*) AS n FROM (SELECT band_name, pilot % 3 AS pilot_group FROM photos) AS t GROUP BY ROLLUP (band_name, pilot_group)
""")
def photo_rollup(spark, sf_dir):
    """Grouping sets over photos."""
    return domain(spark, sf_dir, "photos").select("band_name", (c("pilot") % 3).alias("pilot_group")).rollup("band_name", "pilot_group").agg(F.count("*").alias("n"))


@query("""
    WITH a AS (SELECT map_from_entries([('crop', '3'), ('split', CAST(ord % 3 AS STRING)), ('dsm', 'true')]) AS m, ord FROM photos),
    b AS (SELECT ord, unnest(map_entries(m)) AS e FROM a)
    SELECT ord, e.key AS name, e.value AS now, CASE e.key WHEN 'crop' THEN '3' WHEN 'split' THEN '1' END AS "before" FROM b WHERE e.value IS DISTINCT FROM CASE e.key WHEN 'crop' THEN '3' WHEN 'split' THEN '1' END
""")
def option_differences(spark, sf_dir):
    """Options that differ from an earlier run's."""
    now = F.create_map(F.lit("crop"), F.lit("3"), F.lit("split"), (c("ord") % 3).cast("string"), F.lit("dsm"), F.lit("true"))
    before = F.create_map(F.lit("crop"), F.lit("3"), F.lit("split"), F.lit("1"))
    rows = domain(spark, sf_dir, "photos").select("ord", F.explode(now).alias("name", "now")).withColumn("before", F.try_element_at(before, c("name")))
    return rows.filter(~c("now").eqNullSafe(c("before")))
