import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysurvey.functions import geodesy as G, photo as P, sensor as X
from skysurvey.operators import points as O, raster as R, sets as S
from skysurvey.plans import lineage
from skysurvey.plans.adapters import domain
from skysurvey.plans.raster_queries import QUERIES as RASTER
from skysurvey.plans.survey_queries import QUERIES as SURVEY
from tests.compare import SF

lit = F.lit


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_utm_there_and_back(spark):
    there = one(spark, z=G.to_utm(lit(-91.994445), lit(46.842779), lit(15), lit(False))).z
    back = one(spark, b=G.from_utm(lit(there.x), lit(there.y), lit(15), lit(False))).b
    assert abs(back.lon + 91.994445) < 1e-9 and abs(back.lat - 46.842779) < 1e-9


def test_ground_control_goldens(spark):
    place = one(spark, u=G.to_utm(lit(-85.61322729531112), lit(44.701151842605441), lit(16), lit(False))).u
    assert abs(place.x - 609865.7077054137) < 1e-6 and abs(place.y - 4950688.361817497) < 1e-6
    feet = one(spark, p=G.from_michigan_feet(lit(26607594.75468351), lit(-26813.882366498266))).p
    utm = one(spark, u=G.to_utm(lit(feet.lon), lit(feet.lat), lit(16), lit(False))).u
    assert (round(utm.x, 3), round(utm.y, 3)) == (609925.818, 4950688.772)


@pytest.mark.parametrize("text,want", [("WGS84 UTM 16N", ("utm", 16, False)), ("+proj=utm +zone=48 +south", ("utm", 48, True)), ("EPSG:32748", ("utm", 48, True)), ("EPSG:4326", ("lonlat", 0, False)), ("+proj=longlat", ("lonlat", 0, False))])
def test_srs(text, want):
    assert tuple(G.parse_srs(text)) == want


def test_srs_unknown():
    with pytest.raises(ValueError):
        G.parse_srs("EPSG:99999")


def _opk(lon, lat, alt, yaw, pitch, roll):
    y, p, r = map(math.radians, (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = math.cos(y), math.sin(y), math.cos(p), math.sin(p), math.cos(r), math.sin(r)
    body = np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])

    def ecef(lat):
        f = 1 / 298.257223563
        e2 = f * (2 - f)
        n = 6378137.0 / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        return np.array([(n + alt) * math.cos(math.radians(lat)) * math.cos(math.radians(lon)), (n + alt) * math.cos(math.radians(lat)) * math.sin(math.radians(lon)), (n * (1 - e2) + alt) * math.sin(math.radians(lat))])

    north = ecef(lat + 1e-7) - ecef(lat - 1e-7)
    north /= np.linalg.norm(north)
    down = np.array([0, 0, -1.0])
    frame = np.array([north, np.cross(down, north), down]).T
    m = frame @ body @ np.array([[0, 1, 0], [1, 0, 0], [0, 0, -1.0]])
    return math.degrees(math.atan2(-m[1, 2], m[2, 2])), math.degrees(math.asin(m[0, 2])), math.degrees(math.atan2(-m[0, 1], m[0, 0]))


def test_photo_angles_match_numpy(spark):
    photos = {r.ord: r for r in domain(spark, SF, "photos").limit(200).collect()}
    got = SURVEY["photo_angles"](spark, SF).filter(F.col("ord").isin(list(photos))).collect()
    for r in got:
        p = photos[r.ord]
        want = _opk(p.longitude, p.latitude, p.altitude or 0.0, p.yaw, p.pitch, p.roll)
        for a, b in zip((r.omega, r.phi, r.kappa), want):
            assert abs((a - b + 180) % 360 - 180) < 1e-3  # the step of 1e-7 degrees leaves few digits


def test_solar_position(spark):
    # Noon in Greenwich on the March equinox of 2024: the sun stands near 38.5 degrees in the south.
    r = one(spark, s=G.F.struct(X.solar_position(lit(1710936000.0), lit(0.0), lit(51.4779)).alias("p"))).s.p
    assert abs(math.degrees(r.altitude) - 38.6) < 0.6 and abs(math.degrees(r.azimuth) - 177.5) < 2.5


def test_irradiance(spark):
    angle, altitude, spectral = 0.5, 0.9, 0.8
    t = 1.0
    a = angle
    for n1, n2 in ((1.000277, 1.6), (1.6, 1.38)):
        a = math.asin(math.sin(a) / n1)
        root = math.sqrt(1 - (n1 / n2 * math.sin(a)) ** 2)
        s = ((n1 * math.cos(a) - n2 * root) / (n1 * math.cos(a) + n2 * root)) ** 2
        p = ((n1 * root - n2 * math.cos(a)) / (n1 * root + n2 * math.cos(a))) ** 2
        t *= 1 - 0.5 * s - 0.5 * p
    direct = spectral / t / (1 / 6 + math.cos(angle))
    want = direct * math.sin(altitude) + direct / 6
    null = lit(None).cast("double")
    r = one(spark, v=X.irradiance(lit(False), null, null, lit(spectral), lit(angle), lit(altitude)), w=X.irradiance(lit(True), null, null, null, null, null), u=X.irradiance(lit(False), null, null, null, lit(0.1), lit(0.1)))
    assert abs(r.v - want) < 1e-9 and r.w == 1.0 and r.u == 1.0


def test_colours_round_trip(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 256).cast("double").alias("r"), (F.col("id") * 13 % 256).cast("double").alias("g"), (F.col("id") * 29 % 256).cast("double").alias("b"))
    hsv = X.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    for r in rows.withColumn("back", X.hsv_to_rgb(hsv["h"], hsv["s"], hsv["v"])).collect():
        assert max(abs(r.r - r.back.r), abs(r.g - r.back.g), abs(r.b - r.back.b)) < 1e-6


def test_photo_tags(spark):
    r = one(
        spark, a=P.rational(lit("1/4")), b=P.rational(lit("1/0")), c=P.parsed_fraction(lit("3/0")), d=P.rationals(lit("40/1, 26/1, 4614/100")), e=P.filename_band(lit("IMG_0001_nir.jpg"), {"nir": "NIR"}),
        f=P.dark_level(lit("10 20 30")), g=P.calibration_triple(lit("1 2")), h=P.vignetting_polynomial(lit("1 2 3"), lit("Sentera")), i=P.vignetting_polynomial(lit("1 2 3"), lit("x")),
        j=P.rtk_stddev(lit(0.5), lit(0.75), lit(None).cast("double")), k=P.dms_to_decimal(lit(40.0), lit(26.0), lit(46.0), lit("S")), m=P.first_tag(F.create_map(lit("b"), lit("2")), ["a", "b"]),
        n=P.mask_key(lit("A b_mask.png")), o=P.mask_key(lit("IMG_1_mask.png")), p=P.needs_sky_mask(lit(None).cast("string"), lit("brown"), lit(25.0), lit("a.jpg")),
        q=P.sfm_export(lit(1.0), lit(2.0), lit(None).cast("double"), lit(None).cast("double"), lit(7.0), lit(8.0), lit(9.0), lit("c")),
    )
    assert (r.a, r.b, r.c) == (0.25, None, "3/0") and r.d == [40.0, 26.0, 46.14] and tuple(r.e) == ("IMG_0001", "NIR")
    assert r.f == 20 and r.g is None and r.h == [1, 2, 3] and r.i == [3, 2, 1] and r.j == 1.5
    assert abs(r.k + 40.446111) < 1e-5 and r.m == "2" and r.n is None and r.o == "img_1" and r.p
    assert r.q.gps.altitude == 0.0 and r.q.gps.dop == 10.0 and r.q.speed == [8.0, 7.0, 9.0]


def test_thermal_error(spark):
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(X.planck_celsius(lit(7000.0), X.THERMAL)).collect()


def test_homography_scale(spark):
    r = one(spark, h=X.scaled_homography(F.array(*(lit(float(i)) for i in range(1, 10))), 0.5))
    assert r.h == [1, 2, 6, 4, 5, 12, 3.5, 4, 9]


def test_zoomify_and_windows(spark):
    assert G.zoomify_tiers(1000, 600) == [(0, 1, 1, 0), (1, 2, 2, 1), (2, 4, 3, 5)]
    w = one(spark, w=G.clip_window(lit(0.0), lit(100.0), lit(-10.0), lit(110.0), lit(40.0), lit(60.0), lit(1.0), 100, 100, 256)).w
    assert (w.rx, w.ry) == (0, 0) and (w.rw, w.rh, w.wx, w.ww) == (41, 41, 46, 210)


def test_hull_matches_sorted_hull(spark):
    points = {(r.x, r.y) for r in domain(spark, SF, "points").select("x", "y").collect()}
    want = O.monotone_chain(points)
    got = O.convex_hull(domain(spark, SF, "points").select("x", "y"))
    assert sorted(got) == sorted(want)
    assert abs(O.area(O.buffered([(0, 0), (4, 0), (4, 4), (0, 4)], 1.0)) - 36) < 1e-9 and O.buffered([(0, 0), (1, 0), (1, 1)], -5.0) == []


def test_median_partitions(spark):
    pts = [(r.x, r.y) for r in domain(spark, SF, "points").select("x", "y").collect()]

    def split(p, box):
        mx, my = float(np.median([a for a, _ in p])), float(np.median([b for _, b in p]))
        x0, y0, x1, y1 = box
        boxes = [(x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)]
        if min((b[2] - b[0]) * (b[3] - b[1]) for b in boxes) < 50:
            return [len(p)]
        parts = [[q for q in p if (q[0] > mx) == (i % 2 == 1) and (q[1] > my) == (i > 1)] for i in range(4)]
        if min(map(len, parts)) < 50:
            return [len(p)]
        return [n for q, b in zip(parts, boxes) for n in split(q, b)]

    got = O.quad_split(domain(spark, SF, "points"), (0, 0, 200, 100), 50, 50.0, median=True).groupBy("node").count().collect()
    assert sorted(r["count"] for r in got) == sorted(split(pts, (0.0, 0.0, 200.0, 100.0)))


def test_clusters_match_flood_fill(spark):
    rows = RASTER["grid_clusters"](spark, SF).collect()
    places = {(r.x, r.y): r.component for r in rows}
    seen = {}
    for start in places:
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            x, y = todo.pop()
            for d in ((4, 0), (-4, 0), (0, 4), (0, -4)):
                q = (x + d[0], y + d[1])
                if q in places and q not in group:
                    group.add(q)
                    todo.append(q)
        name = min(int(x * 1000 + y) for x, y in group)
        seen.update(dict.fromkeys(group, name))
    assert seen == places


def test_queries_without_sql_read_all_points(spark):
    points = domain(spark, SF, "points")
    xy = np.array([(r.x, r.y) for r in points.select("x", "y").collect()])
    free = {(x, y) for x in range(0, 204, 4) for y in range(0, 104, 4) if (np.abs(xy - (x, y)).sum(axis=1) > 4 - 1e-5).all()}
    assert {(r.x, r.y) for r in RASTER["grid_clusters"](spark, SF).collect()} == free
    assert sum(r.n for r in RASTER["ground_classes"](spark, SF).collect()) == points.count()
    # Points have 1 view at least, synthesised ones have none.
    assert RASTER["extended_ground"](spark, SF).filter("views > 0").count() == points.filter("class = 2").count()


def test_guided_filter(spark):
    rng = np.random.default_rng(4)
    p, g = rng.random((9, 11)), rng.random((9, 11))

    def mean(a, r=2):
        return np.array([[a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1].mean() for j in range(a.shape[1])] for i in range(a.shape[0])])

    a = (mean(g * p) - mean(g) * mean(p)) / (mean(g * g) - mean(g) ** 2 + 0.1)
    want = mean(a) * g + mean(mean(p) - a * mean(g))
    frame = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(11)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in R.guided_filter(frame(p), frame(g), 2, 0.1).collect()}
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(9) for j in range(11))


def test_lineage(spark, tmp_path):
    assert lineage.options({"dtm": True, "cutline": True, "crop": 0})["crop"] == 0.01
    assert lineage.rerun_stages({"dem_resolution": 5}, {"dem_resolution": 4})[0] == "dem"
    assert lineage.rerun_stages({"dem_resolution": 5}, {"dem_resolution": 5}) == []
    assert lineage.submodel_options({"crop": 0, "split": 1}, {"orthophoto_png": True}, ["split"]) == {"crop": 0.015625, "orthophoto_png": True}
    assert lineage.path_or_json('{"test":"1"}', open) == {"test": "1"}
    run = lineage.Run(spark, f"file://{tmp_path}")

    @run.add("double", "numbers")
    def _(numbers):
        return numbers.select((F.col("id") * 2).alias("id"))

    @run.add("total", "double")
    def _(double):
        return double.agg(F.sum("id").alias("s"))

    assert run.execute({"numbers": spark.range(4)})["total"].first().s == 12
    assert run.execute({"numbers": spark.range(9)}, first="total")["total"].first().s == 12


def test_vignette_has_its_constant_term(spark):
    rows = spark.range(20).select((F.col("id") % 5).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"))
    got = rows.select("x", "y", X.vignette(F.col("x"), F.col("y"), F.array(lit(2.0), lit(1.0)), F.array(lit(0.002), lit(0.1)), lit("DJI")).alias("v"), X.vignette(F.col("x"), F.col("y"), F.array(lit(2.0), lit(1.0)), F.array(lit(0.002), lit(0.1)), lit("MicaSense")).alias("w"))
    for r in got.collect():
        want = np.polyval([0.002, 0.1, 1.0], np.hypot(r.x - 2, r.y - 1))
        assert abs(r.v - want) < 1e-12 and abs(r.w - 1 / want) < 1e-12
    assert one(spark, v=X.vignette(lit(7.0), lit(1.0), F.array(lit(2.0), lit(1.0)), F.array(lit(0.1)), lit("dji"))).v == 1.5


def test_nearest_of_few_points(spark):
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, -3000.0), (3, None, 1.0)], "id int, x double, y double")
    points = spark.createDataFrame([(10, 1.0, 1.0)], "p int, x double, y double")
    assert sorted((r.id, r.p, r["rank"]) for r in S.nearest(queries, points, "id", 2, 4.0).collect()) == [(1, 10, 1), (2, 10, 1)]
    assert S.nearest(queries, points.limit(0), "id", 2, 4.0).count() == 0
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.random((60, 2)) * 10, rng.random((5, 2)) * 4000])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "p int, x double, y double")
    got = {(r.id, r.p) for r in S.nearest(queries, points, "id", 7, 0.5).collect()}
    want = {(k, int(p)) for k, q in ((1, (0, 0)), (2, (5000, -3000))) for p in np.argsort(np.hypot(*(xy - q).T))[:7]}
    assert got == want


def test_quads_of_many_levels(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.random((4000, 2)) * 0.01, rng.random((500, 2)) * 1000])

    def split(p, box, level=0):
        x0, y0, x1, y1 = box
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        parts = [p[((p[:, 0] > mx) == (i % 2 == 1)) & ((p[:, 1] > my) == (i > 1))] for i in range(4)]
        if (x1 - x0) * (y1 - y0) / 4 < 1e-6 or min(map(len, parts)) < 1:
            return [len(p)]
        boxes = [(x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)]
        return [n for q, b in zip(parts, boxes) for n in split(q, b, level + 1)]

    points = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double")
    got = O.quad_split(points, (0, 0, 1000, 1000), 1, 1e-6).groupBy("node").count().collect()
    assert sorted(r["count"] for r in got) == sorted(split(xy, (0.0, 0.0, 1000.0, 1000.0))) and sum(r["count"] for r in got) == 4500


def test_edge_distance(spark):
    rng = np.random.default_rng(2)
    there = rng.random((14, 40)) < 0.93
    there[3:11, 5:30] = True
    missing = np.array([(i, j) for i in range(-1, 15) for j in range(-1, 41) if not (0 <= i < 14 and 0 <= j < 40 and there[i, j])])
    cells = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(there)], "row long, col long")
    for r in R.edge_distance(cells).collect():
        assert abs(r.dist - np.sqrt(((missing - (r.row, r.col)) ** 2).sum(axis=1).min())) < 1e-9


def test_consensus_planes(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((400, 2)) * 50
    z = 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + 3 + rng.normal(size=400) * 0.01
    z[:90] += 40  # roofs and trees, which a plane by least squares follows
    rows = [(i, 1, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, z))] + [(1000, 2, 1.0, 1.0, 5.0), (1001, 3, 1.0, 1.0, 5.0), (1002, 3, 1.0, 1.0, 7.0), (1003, 3, 1.0, 1.0, 6.0)]
    points = spark.createDataFrame(rows, "i long, part int, x double, y double, z double")
    found = {r.part: r for r in O.consensus_planes(points, "part", ["i"]).collect()}
    assert abs(found[1].a - 0.2) < 0.01 and abs(found[1].b + 0.1) < 0.01 and abs(found[1].c - 3) < 0.2 and found[1].n <= 310
    assert (found[2].a, found[2].c) == (0.0, 5.0) and (found[3].a, found[3].n) == (0.0, 3)
    plain = {r.part: r for r in O.plane_fit(points, "part").collect()}
    assert plain[1].c > 5
    high = O.reclassify(points.filter("part = 1").withColumn("class", lit(2)), "part", 20.0, order=["i"]).filter("class = 1")
    assert {r.i for r in high.collect()} == set(range(90))


def test_surrounding_partitions(spark):
    pts = [(i, float(i % 41) * 5, float(i // 41) * 5) for i in range(41 * 21)]
    hole, edge = (lambda x, y: 80 <= x <= 100 and 40 <= y <= 60), (lambda x, y: x >= 185 and y <= 20)
    rows = [p for p in pts if not hole(*p[1:]) and not edge(*p[1:])]
    points = spark.createDataFrame(rows, "i long, x double, y double")
    found = O.partition_plan(points, "surrounding", (0, 0, 200, 100), 30, 750.0, 5.0)
    parts = {}
    for r in found.collect():
        parts.setdefault(r.part, set()).add(r.i)
    assert set().union(*parts.values()) == {p[0] for p in rows} and len(parts) == 3
    free = {q for q in [(x * 5.0, y * 5.0) for x in range(41) for y in range(21)] if min(abs(q[0] - x) + abs(q[1] - y) for _, x, y in rows) > 5 - 1e-5}
    inner = {q for q in free if hole(*q)}
    near = {i for i, x, y in rows if min(abs(q[0] - x) + abs(q[1] - y) for q in inner) <= 15}
    assert near in parts.values()
    outer = sorted(q for q in free if edge(*q))
    x0, y0, x1, y1 = outer[0][0] - 5, min(q[1] for q in outer) - 5, outer[-1][0] + 5, max(q[1] for q in outer) + 5
    while (x1 - x0) * (y1 - y0) < 750 or sum(x0 <= x <= x1 and y0 <= y <= y1 for _, x, y in rows) < 30:
        x0, y1 = x0 - 5, y1 + 5
    assert {i for i, x, y in rows if x0 <= x <= x1 and y0 <= y <= y1} in parts.values()
    assert O.grown_box((0, 0, 1, 1), (9, 9), 1, lambda b: False, (0, 0, 5, 5)) == (0, 0, 5, 5)
    with pytest.raises(ValueError):
        O.partition_plan(points, "other", (0, 0, 1, 1), 1, 1.0)


@pytest.mark.parametrize("bands,left", [(["RGB", "Red", "Green", "Blue"], {"Red", "Green", "Blue"}), (["RGB", "Red", "Green", "NIR"], {"RGB", "NIR"}), (["RedGreenBlue", "Red", "NIR"], {"RedGreenBlue", "NIR"}), (["Red", "NIR"], {"Red", "NIR"}), (["RGB"], {"RGB"})])
def test_redundant_bands(spark, bands, left):
    photos = spark.createDataFrame([(i, b, "DJI", "FC330") for i, b in enumerate(bands)], "ord int, band_name string, make string, model string")
    assert {r.band_name for r in S.drop_redundant_bands(photos, make="make", model="model", order="ord").collect()} == left
    if bands[:1] == ["RGB"] and "Green" in bands:
        m3m = photos.withColumn("model", lit("M3M"))
        assert {r.band_name for r in S.drop_redundant_bands(m3m, make="make", model="model", order="ord").collect()} == set(bands) - {"RGB"}


def test_nearest_values_of_a_block():
    rng = np.random.default_rng(8)
    grid = rng.random((17, 23))
    there = rng.random((17, 23)) < 0.15
    rows, cols = np.nonzero(~there)
    at = np.argwhere(there)
    got = R.nearest_values(np.where(there, grid, np.nan), there, rows, cols)
    for r, c, v in zip(rows, cols, got):
        best = min(((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in at)
        assert v == grid[best[1], best[2]]


def test_hull_of_round_and_flat_outlines(spark):
    angle = np.arange(3000) * 2 * np.pi / 3000
    ring = [(float(np.cos(a) * 100), float(np.sin(a) * 100)) for a in angle]
    inner = [(float(x), float(y)) for x, y in np.random.default_rng(1).random((2000, 2)) * 60 - 30]
    frame = lambda rows: spark.createDataFrame(rows, "x double, y double").repartition(5)
    assert sorted(O.convex_hull(frame(ring + inner))) == sorted(O.monotone_chain(set(ring + inner)))
    assert O.convex_hull(frame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (None, 1.0)])) == [(0.0, 0.0), (2.0, 2.0)] and O.convex_hull(frame([(1.0, 1.0)] * 3)) == [(1.0, 1.0)]
    assert O.convex_hull(frame([(0.0, 0.0)]).limit(0)) == []


def test_resample_leaves_out_cells_without_a_value(spark):
    raster = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else 10.0 * r + c) for r in range(4) for c in range(4)], "row long, col long, value double")
    samples = spark.createDataFrame([(1, 1.25, 1.5), (2, 1.25, 1.5), (3, 50.0, 50.0), (4, None, 1.0)], "id int, x double, y double")
    got = {r.id: r.value for r in R.resample(samples, raster, "cubic").collect()}
    assert got == {r.id: r.value for r in R.resample(samples, raster.filter("value IS NOT NULL"), "cubic").collect()}
    assert got[1] == got[2] and 0 < got[1] < 40 and got[3] is None and got[4] is None


def test_nearest_of_many_copies(spark):
    n = 20_000
    queries = spark.range(n).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    points = spark.range(n).select(F.lit(1.5).alias("x"), F.lit(1.0).alias("y"), (F.col("id") % 40).alias("p"))
    got = S.nearest(queries, points, "id", 3, 4.0, distinct=True)
    assert got.count() == 3 * n and sorted((r.p, r["rank"]) for r in got.filter("id = 7").collect()) == [(0, 1), (1, 2), (2, 3)]
    assert {(r.p, r["rank"]) for r in S.nearest(queries.limit(1), points, "id", 3, 4.0).collect()} == {(0, 1), (0, 2), (0, 3)}


def test_equal_captures_are_numbered_by_their_id(spark):
    photos = spark.createDataFrame([(k, "2024-01-01", "a.tif") for k in range(59, -1, -1)], "capture int, taken string, filename string").repartition(7)
    got = {r.capture: r.number for r in S.valid_captures(photos, "capture", 1, ["taken", "filename"], 3).collect()}
    assert got == {k: f"{k + 1:03d}" for k in range(60)}


def test_outliers_of_many_copies(spark):
    n = 20_000
    points = spark.range(n + 2).select("id", F.when(F.col("id") < n, 1.0).otherwise(F.col("id") - n + 3.0).alias("x"), F.lit(0.0).alias("y"))
    got = {r.id: (r.mean_distance, r.keep) for r in O.outliers(points, "id", 4, 2.5, 8.0).filter(f"id IN (0, 7, {n}, {n + 1})").collect()}
    assert got == {0: (0.0, True), 7: (0.0, True), n: (1.75, False), n + 1: (2.5, False)}
