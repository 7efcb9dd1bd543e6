"""Queries over point clouds and rasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skysurvey.operators import points as O, raster as R, sets as S
from skysurvey.plans.adapters import domain, oracle

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


_DSM = "SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, max(z) AS value, count(*) AS n FROM points GROUP BY 1, 2"


def _dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_max(domain(spark, sf_dir, "points"), 4.0)


@query(_DSM)
def dsm_cell_max(spark, sf_dir):
    """Highest point of every cell."""
    return _dsm(spark, sf_dir)


@query("""
    WITH s AS (SELECT p.z, CAST(floor(x / 4) AS BIGINT) + i AS col, CAST(floor(y / 4) AS BIGINT) + j AS row, p.x, p.y FROM points p, range(-2, 3) a(i), range(-2, 3) b(j))
    SELECT row, col, max(z) AS value FROM s WHERE sqrt((x - (col + 0.5) * 4) * (x - (col + 0.5) * 4) + (y - (row + 0.5) * 4) * (y - (row + 0.5) * 4)) <= 5 GROUP BY row, col
""")
def dsm_radius_max(spark, sf_dir):
    """Highest point within a radius of each cell."""
    return R.grid_radius(domain(spark, sf_dir, "points"), 4.0, 5.0)


@query("""
    WITH p AS (SELECT * FROM points WHERE class = 2), s AS (SELECT z, CAST(floor(x / 4) AS BIGINT) + i AS col, CAST(floor(y / 4) AS BIGINT) + j AS row, x, y FROM p, range(-2, 3) a(i), range(-2, 3) b(j)),
    d AS (SELECT row, col, z, sqrt((x - (col + 0.5) * 4) * (x - (col + 0.5) * 4) + (y - (row + 0.5) * 4) * (y - (row + 0.5) * 4)) AS d FROM s)
    SELECT row, col, round(coalesce(min(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)), 6) AS value FROM d WHERE d <= 5 GROUP BY row, col
""")
def dtm_idw(spark, sf_dir):
    """Inverse-distance mean of ground points."""
    p = domain(spark, sf_dir, "points").filter("class = 2")
    return R.grid_radius(p, 4.0, 5.0, "idw").withColumn("value", F.round("value", 6))


@query("""
    WITH a AS (SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, max(z) AS v FROM gaps GROUP BY 1, 2), b AS (SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, max(z) + 1 AS v FROM points GROUP BY 1, 2)
    SELECT row, col, coalesce(a.v, b.v) AS value FROM a FULL JOIN b USING (row, col)
""")
def mosaic_finest(spark, sf_dir):
    """The finer layer where it has a value."""
    coarse = R.grid_max(domain(spark, sf_dir, "points"), 4.0).withColumn("value", c("value") + 1)
    return R.finest([(2.0, coarse), (1.0, R.grid_max(domain(spark, sf_dir, "gaps"), 4.0))])


@query(f"""
    WITH d AS ({_DSM}), n AS (SELECT d.row + i AS row, d.col + j AS col, value FROM d, range(-2, 3) a(i), range(-2, 3) b(j))
    SELECT d.row, d.col, round(median(n.value), 6) AS value FROM d JOIN n ON d.row = n.row AND d.col = n.col GROUP BY d.row, d.col
""")
def dem_median_filter(spark, sf_dir):
    """A19."""
    return R.focal_median(_dsm(spark, sf_dir), 2).withColumn("value", F.round("value", 6))


@query(f"""
    WITH d AS ({_DSM}), l AS (SELECT d.row, d.col, -4 * d.value + coalesce(a.value, 0) + coalesce(b.value, 0) + coalesce(e.value, 0) + coalesce(f.value, 0) AS v FROM d LEFT JOIN d a ON a.row = d.row AND a.col = d.col - 1
    LEFT JOIN d b ON b.row = d.row AND b.col = d.col + 1 LEFT JOIN d e ON e.row = d.row - 1 AND e.col = d.col LEFT JOIN d f ON f.row = d.row + 1 AND f.col = d.col) SELECT round(var_pop(v), 4) AS score FROM l
""")
def laplacian_blur(spark, sf_dir):
    """X19, A33, W10."""
    return R.blur_score(_dsm(spark, sf_dir)).select(F.round("score", 4).alias("score"))


@query(f"""
    WITH d AS MATERIALIZED ({_DSM}), k AS (SELECT d.row, d.col, max(CASE WHEN e.row < d.row AND e.col < d.col THEN e.value END) AS nw, max(CASE WHEN e.row < d.row AND e.col = d.col THEN e.value END) AS n, max(CASE WHEN e.row < d.row AND e.col > d.col THEN e.value END) AS ne, max(CASE WHEN e.row = d.row AND e.col < d.col THEN e.value END) AS w, max(CASE WHEN e.row = d.row AND e.col > d.col THEN e.value END) AS e, max(CASE WHEN e.row > d.row AND e.col < d.col THEN e.value END) AS sw, max(CASE WHEN e.row > d.row AND e.col = d.col THEN e.value END) AS s, max(CASE WHEN e.row > d.row AND e.col > d.col THEN e.value END) AS se
    FROM d JOIN (SELECT row, col, row + i AS r, col + j AS c, value FROM d, range(-1, 2) a(i), range(-1, 2) b(j)) e ON e.r = d.row AND e.c = d.col GROUP BY d.row, d.col HAVING count(*) = 9),
    g AS (SELECT row, col, (ne + 2 * e + se - nw - 2 * w - sw) / 32 AS dx, (sw + 2 * s + se - nw - 2 * n - ne) / 32 AS dy FROM k)
    SELECT row, col, round(greatest(1.0, 1 + 254 * (cos(radians(45)) * cos(atan(sqrt(dx*dx + dy*dy))) + sin(radians(45)) * sin(atan(sqrt(dx*dx + dy*dy))) * cos(radians(135) - atan2(dy, -dx)))), 6) AS value FROM g
""")
def dem_hillshade(spark, sf_dir):
    """W11, R22, R35."""
    return R.hillshade(_dsm(spark, sf_dir), 4.0).withColumn("value", F.round("value", 6))


@query(f"""
    WITH d AS ({_DSM}), b AS (SELECT d.row, d.col, sum(e.value) / count(e.value) AS value FROM d JOIN d e ON e.row BETWEEN d.row - 3 AND d.row + 3 AND e.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY d.row, d.col) SELECT row, col, round(value, 6) AS value FROM b
""")
def dem_box_mean(spark, sf_dir):
    """W5."""
    return R.box_mean(_dsm(spark, sf_dir).select("row", "col", "value"), 3).withColumn("value", F.round("value", 6))


@query(f"""
    WITH d AS (SELECT row, col, value AS p, CAST(n AS DOUBLE) AS i FROM ({_DSM}) AS s), m AS (SELECT d.row, d.col, avg(e.p) AS p, avg(e.i) AS i, avg(e.i * e.p) AS ip, avg(e.i * e.i) AS ii FROM d JOIN d e ON e.row BETWEEN d.row - 2 AND d.row + 2 AND e.col BETWEEN d.col - 2 AND d.col + 2 GROUP BY d.row, d.col),
    l AS (SELECT row, col, (ip - i * p) / (ii - i * i + 0.1) AS a, p - (ip - i * p) / (ii - i * i + 0.1) * i AS b FROM m), k AS (SELECT l.row, l.col, avg(e.a) AS a, avg(e.b) AS b FROM l JOIN l e ON e.row BETWEEN l.row - 2 AND l.row + 2 AND e.col BETWEEN l.col - 2 AND l.col + 2 GROUP BY l.row, l.col)
    SELECT row, col, round(a * i + b, 6) AS value FROM k JOIN d USING (row, col)
""")
def dem_guided_filter(spark, sf_dir):
    """W6."""
    d = _dsm(spark, sf_dir)
    return R.guided_filter(d.select("row", "col", "value"), d.select("row", "col", c("n").cast("double").alias("value")), 2, 0.1).withColumn("value", F.round("value", 6))


@query("""
    SELECT row, col, round(sum(value * CASE WHEN n = 1 THEN 0.001953125 ELSE n - 1 END) / sum(CASE WHEN n = 1 THEN 0.001953125 ELSE n - 1 END), 6) AS value, sum(CASE WHEN n = 1 THEN 0.001953125 ELSE n - 1 END) AS weight FROM raster GROUP BY row, col
""")
def dem_blend(spark, sf_dir):
    """A20, J22, C2."""
    r = domain(spark, sf_dir, "raster").withColumn("dist", c("n") - 1)
    return R.blend(r, "dist").withColumn("value", F.round("value", 6))


@query("""
    WITH b AS (SELECT row, col, sum(value * w) / sum(w) AS value, sum(w) AS weight FROM (SELECT *, CASE WHEN n = 1 THEN 0.001953125 ELSE (n - 1) / 8 END AS w FROM raster) AS r GROUP BY row, col),
    l AS (SELECT * FROM b WHERE weight > 0.001953125 AND weight < 1), h AS (SELECT * FROM b WHERE NOT (weight > 0.001953125 AND weight < 1)),
    f AS (SELECT l.row, l.col, l.weight, l.value AS own, h.value, row_number() OVER (PARTITION BY l.row, l.col ORDER BY (l.row - h.row) * (l.row - h.row) + (l.col - h.col) * (l.col - h.col), h.row, h.col) AS rn FROM l LEFT JOIN h ON l.row // 16 = h.row // 16 AND l.col // 16 = h.col // 16)
    SELECT row, col, round(value, 6) AS value, round(weight, 6) AS weight FROM h UNION ALL SELECT row, col, round(coalesce(value, own), 6), round(weight, 6) FROM f WHERE rn = 1
""")
def dem_blend_filled(spark, sf_dir):
    """A21, A22, W12."""
    r = domain(spark, sf_dir, "raster").withColumn("dist", (c("n") - 1) / 8)
    return R.fill_low_weight(R.blend(r, "dist"), 16).select("row", "col", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


@query("SELECT row, col, source, value, alpha FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY source) AS rn FROM raster WHERE alpha <> 0) AS t WHERE rn = 1")
def ortho_first_wins(spark, sf_dir):
    """U8, C3."""
    return R.first_wins(domain(spark, sf_dir, "raster"), "source")


@query("""
    WITH r AS (SELECT row, col, alpha AS a, floor(value) AS v, row_number() OVER (PARTITION BY row, col ORDER BY source) AS rn FROM raster WHERE alpha <> 0),
    a AS (SELECT row, col, v AS d FROM r WHERE rn = 1), b AS (SELECT a.row, a.col, floor(r.a / 255.0::DOUBLE * r.v + (1 - r.a / 255.0::DOUBLE) * d) AS d FROM a JOIN r ON a.row = r.row AND a.col = r.col AND rn = 1),
    e AS (SELECT b.row, b.col, CASE WHEN r.v IS NULL THEN d ELSE floor(r.a / 255.0::DOUBLE * r.v + (1 - r.a / 255.0::DOUBLE) * d) END AS d FROM b LEFT JOIN r ON b.row = r.row AND b.col = r.col AND rn = 2)
    SELECT e.row, e.col, CASE WHEN r.v IS NULL THEN d ELSE floor(r.a / 255.0::DOUBLE * r.v + (1 - r.a / 255.0::DOUBLE) * d) END AS value FROM e LEFT JOIN r ON e.row = r.row AND e.col = r.col AND rn = 3
""")
def ortho_alpha_fold(spark, sf_dir):
    """U9, U10."""
    return R.alpha_fold(domain(spark, sf_dir, "raster"), "source")


@query("""
    WITH d AS (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row FROM gaps), f AS (SELECT i AS row, j AS col FROM range(-1, 28) a(i), range(-1, 53) b(j)),
    m AS (SELECT row, col FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.row = f.row AND d.col = f.col)), e AS (SELECT d.row, d.col, sqrt(min((d.row - m.row) * (d.row - m.row) + (d.col - m.col) * (d.col - m.col))) AS d FROM d, m GROUP BY d.row, d.col)
    SELECT row, col, round(d, 6) AS dist, round(255 * least(d / 20, 1), 6) AS alpha FROM e
""")
def edge_feather(spark, sf_dir):
    """A18, R14."""
    e = R.edge_distance(R.grid_max(domain(spark, sf_dir, "gaps"), 4.0).select("row", "col"))
    return e.select("row", "col", F.round("dist", 6).alias("dist"), F.round(R.feather(F.lit(255.0), c("dist")), 6).alias("alpha"))


@query("""
    WITH f AS (SELECT i AS row, j AS col FROM range(0, 25) a(i), range(0, 50) b(j)), d0 AS (SELECT CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, max(z) AS value FROM gaps GROUP BY 1, 2),
    d1 AS (SELECT row, col, value FROM d0 UNION ALL SELECT f.row, f.col, avg(d.value) FROM f JOIN d0 d ON abs(d.row - f.row) <= 1 AND abs(d.col - f.col) <= 1 WHERE NOT EXISTS (SELECT 1 FROM d0 z WHERE z.row = f.row AND z.col = f.col) GROUP BY f.row, f.col)
    SELECT row, col, round(value, 6) AS value FROM d1 UNION ALL SELECT f.row, f.col, round(avg(d.value), 6) FROM f JOIN d1 d ON abs(d.row - f.row) <= 1 AND abs(d.col - f.col) <= 1 WHERE NOT EXISTS (SELECT 1 FROM d1 z WHERE z.row = f.row AND z.col = f.col) GROUP BY f.row, f.col
""")
def dem_gap_fill(spark, sf_dir):
    """A17, R34."""
    d = R.grid_max(domain(spark, sf_dir, "gaps"), 4.0)
    frame = spark.range(25).select(c("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return R.fill_gaps(d, frame, 2).withColumn("value", F.round("value", 6))


@query(f"""
    WITH d AS ({_DSM}), s AS (SELECT id, CAST(id % 48 AS DOUBLE) + 0.25 AS x, CAST(id % 23 AS DOUBLE) + 0.75 AS y FROM submodels),
    k AS (SELECT s.id, d.value, (1 - abs(s.y - d.row)) * (1 - abs(s.x - d.col)) AS w FROM s LEFT JOIN d ON d.row BETWEEN floor(s.y) AND floor(s.y) + 1 AND d.col BETWEEN floor(s.x) AND floor(s.x) + 1)
    SELECT id, round(sum(value * w) / sum(w), 6) AS value FROM k GROUP BY id
""")
def dem_samples(spark, sf_dir):
    """Bilinear samples of a raster."""
    s = domain(spark, sf_dir, "submodels").select("id", ((c("id") % 48).cast("double") + 0.25).alias("x"), ((c("id") % 23).cast("double") + 0.75).alias("y"))
    return R.bilinear(s, _dsm(spark, sf_dir)).select("id", F.round("value", 6).alias("value"))


@query(f"""
    WITH d AS ({_DSM}), s AS (SELECT id, CAST(id % 44 AS DOUBLE) + 2.25 AS x, CAST(id % 19 AS DOUBLE) + 2.75 AS y FROM submodels),
    k AS (SELECT s.id, d.value, abs(s.y - d.row) AS a, abs(s.x - d.col) AS b FROM s LEFT JOIN d ON d.row BETWEEN floor(s.y) - 1 AND floor(s.y) + 2 AND d.col BETWEEN floor(s.x) - 1 AND floor(s.x) + 2),
    w AS (SELECT id, value, CASE WHEN a <= 1 THEN (1.5 * a - 2.5) * a * a + 1 WHEN a < 2 THEN ((-0.5 * a + 2.5) * a - 4) * a + 2 ELSE 0 END * CASE WHEN b <= 1 THEN (1.5 * b - 2.5) * b * b + 1 WHEN b < 2 THEN ((-0.5 * b + 2.5) * b - 4) * b + 2 ELSE 0 END AS w FROM k)
    SELECT id, CASE WHEN abs(sum(CASE WHEN value IS NOT NULL THEN w END)) > 0.000001 THEN round(sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) END AS value FROM w GROUP BY id
""")
def dem_cubic_samples(spark, sf_dir):
    """R29."""
    s = domain(spark, sf_dir, "submodels").select("id", ((c("id") % 44).cast("double") + 2.25).alias("x"), ((c("id") % 19).cast("double") + 2.75).alias("y"))
    return R.resample(s, _dsm(spark, sf_dir).select("row", "col", "value"), "cubic").select("id", F.round("value", 6).alias("value"))


@query(f"""
    WITH d AS ({_DSM}), e AS (SELECT a.row, a.col, 'x' AS axis, a.value AS u, b.value AS v FROM d a JOIN d b ON a.row = b.row AND b.col = a.col + 1 UNION ALL SELECT a.row, a.col, 'y', a.value, b.value FROM d a JOIN d b ON a.col = b.col AND b.row = a.row + 1),
    l AS (SELECT *, unnest(generate_series(CAST(floor(least(u, v) / 0.25) AS BIGINT) + 1, CAST(floor(greatest(u, v) / 0.25) AS BIGINT))) AS k FROM e WHERE u <> v)
    SELECT row, col, axis, k * 0.25::DOUBLE AS level, round((k * 0.25::DOUBLE - u) / (v - u), 6) AS place FROM l
""")
def dem_contours(spark, sf_dir):
    """R22, C10."""
    return R.contours(_dsm(spark, sf_dir).select("row", "col", "value"), 0.25).withColumn("place", F.round("place", 6))


_TILES = """
    WITH m AS (SELECT ord, longitude * 20037508.342789244 / 180 AS mx, (ln(tan((90 + latitude) * pi() / 360)) / (pi() / 180)) * 20037508.342789244 / 180 AS my, altitude FROM photos),
    t AS (SELECT CAST(ceil((mx + 20037508.342789244) / (156543.03392804097 / 256) / 256) - 1 AS BIGINT) AS x, CAST(ceil((my + 20037508.342789244) / (156543.03392804097 / 256) / 256) - 1 AS BIGINT) AS y, altitude FROM m)
    SELECT CAST(8 - k AS INT) AS z, CAST(floor(x / pow(2, k)) AS BIGINT) AS x, CAST(floor(y / pow(2, k)) AS BIGINT) AS y, sum(altitude) AS total, count(altitude) AS n FROM t, range(0, 6) r(k) GROUP BY 1, 2, 3
"""


@query(_TILES)
def tile_pyramid(spark, sf_dir):
    """R19, R20, A37, K21."""
    p = domain(spark, sf_dir, "photos").select(c("longitude").alias("lon"), c("latitude").alias("lat"), "altitude")
    return R.pyramid(R.base_tiles(p, 8, "altitude"), 3)


@query(f"WITH d AS ({_DSM}) SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, round(avg(value), 6) AS value FROM d GROUP BY 1, 2")
def raster_overview(spark, sf_dir):
    """K16, K15."""
    return R.coarsen(_dsm(spark, sf_dir), 4).withColumn("value", F.round("value", 6))


@query("SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, round(avg(x), 6) AS x_avg, round(stddev_pop(x), 6) AS x_std, min(z) AS z_min, max(z) AS z_max, round(avg(z), 6) AS z_avg, round(stddev_pop(z), 6) AS z_std FROM points")
def cloud_statistics(spark, sf_dir):
    """A11, A12."""
    b = O.bounds(domain(spark, sf_dir, "points"), "x", "z")
    return b.select(*(F.round(k, 6).alias(k) if k.endswith(("avg", "std")) else c(k) for k in b.columns))


_RING = [(20.0, 10.0), (150.0, 5.0), (180.0, 80.0), (90.0, 60.0), (30.0, 90.0)]


def _inside_sql() -> str:
    tests = []
    for (ax, ay), (bx, by) in zip(_RING, [*_RING[1:], _RING[0]]):
        tests.append(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return " + ".join(tests)


@query(f"SELECT class, count(*) AS n, sum(z) AS z FROM points WHERE ({_inside_sql()}) % 2 = 1 AND z BETWEEN 5 AND 40 GROUP BY class")
def boundary_crop(spark, sf_dir):
    """Points inside a boundary and a height range."""
    p = domain(spark, sf_dir, "points")
    return p.filter(O.in_ring(c("x"), c("y"), _RING) & c("z").between(5, 40)).groupBy("class").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


@query("""
    WITH p AS (SELECT DISTINCT x, y, z FROM points), r AS (SELECT x, y, z, row_number() OVER (PARTITION BY CAST(floor(x / 5) AS BIGINT), CAST(floor(y / 5) AS BIGINT) ORDER BY
    sqrt((x - (floor(x / 5) + 0.5) * 5) * (x - (floor(x / 5) + 0.5) * 5) + (y - (floor(y / 5) + 0.5) * 5) * (y - (floor(y / 5) + 0.5) * 5)), x, y, z) AS rn FROM p) SELECT x, y, z FROM r WHERE rn = 1
""")
def thinned_cloud(spark, sf_dir):
    """F6."""
    return O.cell_sample(domain(spark, sf_dir, "points").select("x", "y", "z").distinct(), 5.0)


@query("SELECT ord, line, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY ord, line, x, y, z) AS i FROM points) AS t WHERE i % 10 = 1")
def decimated_cloud(spark, sf_dir):
    """one point in ten of a total order."""
    return S.systematic(domain(spark, sf_dir, "points"), 10, ["ord", "line", "x", "y", "z"]).select("ord", "line", "x", "y", "z")


@query("SELECT chunk, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord, round(sum(z), 4) AS z FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY ord, line, x, y, z) - 1) / 500) AS BIGINT) AS chunk FROM points) AS t GROUP BY chunk")
def cloud_chunks(spark, sf_dir):
    """U4: chunks of at most 500 points."""
    p = S.chunks(domain(spark, sf_dir, "points"), 500, ["ord", "line", "x", "y", "z"])
    return p.groupBy("chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.round(F.sum("z"), 4).alias("z"))


@query("""
    WITH p AS (SELECT id, x, y FROM gcp UNION ALL SELECT 1000000 + id, x / 10, y / 20 FROM submodels), d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rn FROM p a JOIN p b ON a.id <> b.id),
    m AS (SELECT id, avg(d) AS m FROM d WHERE rn <= 4 GROUP BY id) SELECT id, round(m, 6) AS mean_distance, m < (SELECT avg(m) + 2.5 * stddev_samp(m) FROM m) AS keep FROM m
""")
def outlier_filter(spark, sf_dir):
    """F5."""
    p = domain(spark, sf_dir, "gcp").select("id", "x", "y").unionByName(domain(spark, sf_dir, "submodels").select((1000000 + c("id")).alias("id"), (c("x") / 10).alias("x"), (c("y") / 20).alias("y")))
    return O.outliers(p, "id", 4, 2.5, 8.0).select("id", F.round("mean_distance", 6).alias("mean_distance"), "keep")


@query("""
    WITH g AS (SELECT x, y, z, CAST(floor(x / 25) AS BIGINT) AS part FROM points WHERE class = 2), a AS (SELECT part, count(*) AS n, regr_count(z, x) AS k, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, z) AS syz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY part),
    f AS (SELECT *, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) AS a, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) AS b FROM a) SELECT part, n, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 5) AS c FROM f
""")
def ground_planes(spark, sf_dir):
    """Least-squares planes by partition."""
    p = domain(spark, sf_dir, "points").filter("class = 2").withColumn("part", F.floor(c("x") / 25))
    return O.plane_fit(p, "part").select("part", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 5).alias("c"))


@query("""
    WITH g AS (SELECT x, y, z, CAST(floor(x / 25) AS BIGINT) AS part FROM points WHERE class = 2), a AS (SELECT part, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, z) AS syz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY part),
    f AS (SELECT part, mx, my, mz, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) AS a, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) AS b FROM a), r AS (SELECT CASE WHEN greatest(z - a * (x - mx) - b * (y - my) - mz, 0) > 5 THEN 1 ELSE 2 END AS class FROM g JOIN f USING (part))
    SELECT class, count(*) AS n FROM (SELECT class FROM r UNION ALL SELECT class FROM points WHERE class <> 2) AS t GROUP BY class
""")
def rectified_ground(spark, sf_dir):
    """Ground points far above their plane become unclassified."""
    p = domain(spark, sf_dir, "points").withColumn("part", F.floor(c("x") / 25))
    return O.reclassify(p, "part", 5.0).groupBy("class").agg(F.count("*").alias("n"))


@query("""
    WITH RECURSIVE q(node, x0, y0, x1, y1) AS (SELECT CAST('' AS STRING), 0.0::DOUBLE, 0.0::DOUBLE, 200.0::DOUBLE, 100.0::DOUBLE UNION ALL
    SELECT node || d, CASE WHEN d IN ('1', '3') THEN (x0 + x1) / 2 ELSE x0 END, CASE WHEN d IN ('2', '3') THEN (y0 + y1) / 2 ELSE y0 END, CASE WHEN d IN ('0', '2') THEN (x0 + x1) / 2 ELSE x1 END, CASE WHEN d IN ('0', '1') THEN (y0 + y1) / 2 ELSE y1 END
    FROM q, (VALUES ('0'), ('1'), ('2'), ('3')) AS v(d) WHERE (x1 - x0) * (y1 - y0) / 4 >= 50 AND (SELECT min(k) FROM (SELECT count(p.x) AS k FROM (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS w(i, j) LEFT JOIN points p ON
    (p.x > (x0 + x1) / 2) = (i = 1) AND (p.y > (y0 + y1) / 2) = (j = 1) AND (p.x > x0 OR x0 = 0) AND (p.x <= x1 OR x1 = 200) AND (p.y > y0 OR y0 = 0) AND (p.y <= y1 OR y1 = 100) GROUP BY i, j) AS s) >= 100)
    SELECT node, count(*) AS n FROM points p JOIN q ON (p.x > x0 OR x0 = 0) AND (p.x <= x1 OR x1 = 200) AND (p.y > y0 OR y0 = 0) AND (p.y <= y1 OR y1 = 100) WHERE NOT EXISTS (SELECT 1 FROM q r WHERE length(r.node) = length(q.node) + 1 AND starts_with(r.node, q.node)) GROUP BY node
""")
def quad_partitions(spark, sf_dir):
    """R1, R2, R4."""
    return O.quad_split(domain(spark, sf_dir, "points"), (0, 0, 200, 100), 100, 50.0).groupBy("node").agg(F.count("*").alias("n"))


@query()
def median_partitions(spark, sf_dir):
    """R1, R3; tested against a recursive version."""
    return O.quad_split(domain(spark, sf_dir, "points"), (0, 0, 200, 100), 500, 50.0, median=True).groupBy("node").agg(F.count("*").alias("n"))


@query("""
    WITH RECURSIVE g AS (SELECT CAST(i * 4 AS DOUBLE) AS x, CAST(j * 4 AS DOUBLE) AS y FROM range(0, 51) a(i), range(0, 26) b(j)),
    u AS (SELECT x, y, CAST(x * 1000 + y AS BIGINT) AS id FROM g WHERE NOT EXISTS (SELECT 1 FROM gaps p WHERE abs(p.x - g.x) + abs(p.y - g.y) <= 4 - 1e-5)),
    e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON abs(a.x - b.x) + abs(a.y - b.y) <= 4),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT u.x, u.y, min(r.b) AS component FROM u JOIN r ON r.a = u.id GROUP BY u.x, u.y
""")
def grid_clusters(spark, sf_dir):
    """Connected clusters of uncovered grid places."""
    p = domain(spark, sf_dir, "gaps").select("x", "y")
    g = spark.range(51).select((c("id") * 4).cast("double").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(25)))).withColumn("y", (c("y") * 4).cast("double"))
    free = S.range_anti(g, p, 4.0).withColumn("id", (c("x") * 1000 + c("y")).cast("long"))
    return O.cell_clusters(free, 4.0).select("x", "y", "component")


@query()
def consensus_planes(spark, sf_dir):
    """Planes by partition that most ground points lie near; tested against numpy."""
    p = domain(spark, sf_dir, "points").filter("class = 2").withColumn("part", F.floor(c("x") / 25))
    return O.consensus_planes(p, "part", ["ord", "line", "x", "y", "z"]).select("part", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 5).alias("c"))


@query()
def surrounding_parts(spark, sf_dir):
    """Points around uncovered places; tested against a plain version."""
    p = O.partition_plan(domain(spark, sf_dir, "gaps").select("ord", "line", "x", "y", "z"), "surrounding", (0, 0, 200, 100), 500, 750.0, 5.0)
    return p.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query()
def extended_ground(spark, sf_dir):
    """Ground synthesised on uncovered grid places, with plane height and mean colour."""
    p = domain(spark, sf_dir, "gaps").filter("class = 2")
    hull = O.convex_hull(p.select("x", "y"))
    free = S.range_anti(O.grid_in_hull(hull, 4.0, p), p.select("x", "y"), 4.0).withColumn("part", F.floor(c("x") / 50))
    ground = p.withColumn("part", F.floor(c("x") / 50))
    planes = O.plane_fit(ground, "part").join(ground.groupBy("part").agg(*(F.avg(k).cast("int").alias(k) for k in ("red", "green", "blue"))), "part")
    new = free.join(planes, "part").select("x", "y", F.round(c("a") * c("x") + c("b") * c("y") + c("c"), 6).alias("z"), F.lit(2).alias("class"), "red", "green", "blue")
    return S.union_clouds(p.select("x", "y", "z", "class", "red", "green", "blue", "views"), new, {"views": 0})


@query("""
    WITH s AS (SELECT CAST(floor(y / 8) AS BIGINT) AS row, CAST(floor(x / 8) AS BIGINT) AS col, min(z) AS value FROM points GROUP BY 1, 2), f0 AS (SELECT * FROM s),
    e1 AS (SELECT s.row, s.col, min(n.value) AS value FROM s JOIN f0 n ON n.row BETWEEN s.row - 1 AND s.row + 1 AND n.col BETWEEN s.col - 1 AND s.col + 1 GROUP BY s.row, s.col),
    o1 AS (SELECT s.row, s.col, max(n.value) AS o FROM s JOIN e1 n ON n.row BETWEEN s.row - 1 AND s.row + 1 AND n.col BETWEEN s.col - 1 AND s.col + 1 GROUP BY s.row, s.col),
    f1 AS (SELECT row, col, CASE WHEN value - o > 0.15 * 1 * 8 THEN o ELSE value END AS value FROM f0 JOIN o1 USING (row, col)),
    e2 AS (SELECT s.row, s.col, min(n.value) AS value FROM s JOIN f1 n ON n.row BETWEEN s.row - 2 AND s.row + 2 AND n.col BETWEEN s.col - 2 AND s.col + 2 GROUP BY s.row, s.col),
    o2 AS (SELECT s.row, s.col, max(n.value) AS o FROM s JOIN e2 n ON n.row BETWEEN s.row - 2 AND s.row + 2 AND n.col BETWEEN s.col - 2 AND s.col + 2 GROUP BY s.row, s.col),
    f2 AS (SELECT row, col, CASE WHEN value - o > 0.15 * 2 * 8 THEN o ELSE value END AS value FROM f1 JOIN o2 USING (row, col)),
    e3 AS (SELECT s.row, s.col, min(n.value) AS value FROM s JOIN f2 n ON n.row BETWEEN s.row - 3 AND s.row + 3 AND n.col BETWEEN s.col - 3 AND s.col + 3 GROUP BY s.row, s.col),
    o3 AS (SELECT s.row, s.col, max(n.value) AS o FROM s JOIN e3 n ON n.row BETWEEN s.row - 3 AND s.row + 3 AND n.col BETWEEN s.col - 3 AND s.col + 3 GROUP BY s.row, s.col),
    f3 AS (SELECT row, col, CASE WHEN value - o > 0.15 * 3 * 8 THEN o ELSE value END AS value FROM f2 JOIN o3 USING (row, col))
    SELECT class, z - value <= 0.5 + 1.25 * 0.15 * 8 AS ground, count(*) AS n FROM points JOIN f3 ON row = floor(y / 8) AND col = floor(x / 8) GROUP BY 1, 2
""")
def ground_classes(spark, sf_dir):
    """Morphological ground classification."""
    return O.ground_points(domain(spark, sf_dir, "points"), 8.0, 3, 0.15, 0.5, 1.25).groupBy("class", "ground").agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(i AS BIGINT) AS sub_col, CAST(j AS BIGINT) AS sub_row, count(*) AS n, sum(CASE WHEN floor(x / 250) = i AND floor(y / 250) = j THEN 1 ELSE 0 END) AS core FROM submodels, range(-1, 5) a(i), range(-1, 5) b(j)
    WHERE i BETWEEN floor((x - 20) / 250) AND floor((x + 20) / 250) AND j BETWEEN floor((y - 20) / 250) AND floor((y + 20) / 250) GROUP BY 1, 2
""")
def split_submodels(spark, sf_dir):
    """Submodels that overlap."""
    s = O.overlapping_submodels(domain(spark, sf_dir, "submodels"), 250.0, 20.0)
    return s.groupBy("sub_col", "sub_row").agg(F.count("*").alias("n"), F.sum(c("core").cast("long")).alias("core"))


@query()
def survey_hull(spark, sf_dir):
    """The hull of all points shrunk and grown again; tested against a sort-based hull."""
    p = domain(spark, sf_dir, "points").select("x", "y")
    hull = O.convex_hull(p)
    ring = O.buffered(O.buffered(hull, -6.0), 3.0) or hull
    return spark.createDataFrame([(i, round(x, 6), round(y, 6), round(O.area(ring), 3)) for i, (x, y) in enumerate(ring)], "place int, x double, y double, area double")


@query("""
    SELECT x, y, z, class, coalesce(views, 0) AS views FROM (SELECT x, y, z, class, views FROM points UNION ALL SELECT x, y, z + 1, class, NULL FROM gaps) AS t
""")
def merged_clouds(spark, sf_dir):
    """Union with defaults for missing dimensions."""
    p = domain(spark, sf_dir, "points")
    b = domain(spark, sf_dir, "gaps").select("x", "y", (c("z") + 1).alias("z"), "class")
    return S.union_clouds(p.select("x", "y", "z", "class", "views"), b, {"views": 0})
