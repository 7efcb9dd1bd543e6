"""Queries over photo metadata, geodesy and sensor values, each with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skysurvey.functions import geodesy as G, photo as P, sensor as X
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


@query("""
    SELECT ord, round(CASE WHEN latitude < 0 THEN -1.0 ELSE 1.0 END * (floor(abs(latitude)) + floor((abs(latitude) - floor(abs(latitude))) * 60) / 60.0), 6) AS lat_dm,
           CASE WHEN ord % 3 = 0 THEN -altitude ELSE altitude END AS altitude_signed,
           CASE WHEN altitude IS NULL THEN NULL ELSE altitude / 4 END AS fraction
    FROM photos
""")
def photo_positions(spark, sf_dir):
    """P1, P3, P4, P5, G27."""
    dms = P.decimal_to_dms(c("latitude"), "N", "S")
    return domain(spark, sf_dir, "photos").select(
        "ord",
        F.round(P.dms_to_decimal(dms["degrees"], dms["minutes"].cast("double"), F.lit(0.0), dms["ref"]), 6).alias("lat_dm"),
        P.signed_altitude(c("altitude"), F.when(c("ord") % 3 == 0, 1).otherwise(0)).alias("altitude_signed"),
        P.rational(F.concat(c("altitude").cast("string"), F.lit("/4"))).alias("fraction"),
    )


@query("""
    SELECT ord, lower(concat_ws(' ', 'v2', make, model, CAST(width AS STRING), CAST(height AS STRING), 'brown', '0.85')) AS camera,
           CASE WHEN lower(make) = 'dji' THEN pitch + 90 ELSE pitch END AS pitch, CASE WHEN lower(make) = 'sensefly' THEN -roll ELSE roll END AS roll,
           CASE WHEN greatest(std_xy, std_z) > 0 THEN greatest(std_xy, std_z) END AS dop,
           width * height / 1000000.0 AS megapixels,
           CASE WHEN make = 'Sentera' THEN 1 ELSE 0 END AS sentera
    FROM (SELECT *  FROM photos) AS t
""")
def photo_cameras(spark, sf_dir):
    """P11, P13, P18, P20, P29."""
    p = domain(spark, sf_dir, "photos")
    ypr = P.normalized_ypr(c("make"), c("pitch"), c("roll"))
    return p.select(
        "ord",
        P.camera_id(c("make"), c("model"), c("width"), c("height"), F.lit("brown"), F.lit("0.85")).alias("camera"),
        ypr["pitch"].alias("pitch"), ypr["roll"].alias("roll"),
        P.gps_dop(c("std_xy"), c("std_z")).alias("dop"),
        P.megapixels(F.lit(None).cast("int"), F.lit(None).cast("int"), c("width"), c("height")).alias("megapixels"),
        (c("make") == "Sentera").cast("int").alias("sentera"),
    )


@query("""
    SELECT ord, CASE lower(concat(make, ' ', model)) WHEN 'dji fc7203' THEN CASE WHEN width * height / 1000000.0 < 10 THEN 19.0 ELSE 25.0 END
           WHEN 'dji fc330' THEN 33.0 WHEN 'gopro hero8 black' THEN 17.0 ELSE 30.0 END AS readout_ms FROM photos
""")
def rolling_shutter(spark, sf_dir):
    """P31, J-range: the read-out table joined by model and size."""
    p = domain(spark, sf_dir, "photos").withColumn("camera", F.concat_ws(" ", "make", "model")).withColumn("mp", c("width") * c("height") / 1e6)
    return P.with_readout(p, "camera", "mp").select("ord", c("readout_ms").cast("double").alias("readout_ms"))


@query("""
    SELECT ord, epoch_ms(taken) + (ord % 1000) AS millis, concat(CAST(capture AS STRING)) AS capture_id,
           CASE WHEN (ord % 8 + 1) > 0 THEN (1.0 / (ord % 100 + 1)) / ((ord % 8 + 1) * (ord % 8 + 1)) END AS exposure,
           coalesce(CASE WHEN ord % 2 = 0 THEN (ord % 5 + 1) / 2 END, (ord % 16 + 1) * 50 / 100.0) AS gain,
           CASE WHEN ord % 2 = 0 THEN 65536.0 ELSE 256.0 END AS bit_max
    FROM photos
""")
def photo_exposures(spark, sf_dir):
    """P7, P23, P25, P27, P28."""
    p = domain(spark, sf_dir, "photos")
    stamp, sub = F.date_format("taken", "yyyy:MM:dd HH:mm:ss"), F.lpad((c("ord") % 1000).cast("string"), 3, "0")
    iso = (c("ord") % 16 + 1) * 50
    return p.select(
        "ord",
        F.rint(P.capture_millis(stamp, sub)).cast("long").alias("millis"),
        P.capture_id(c("capture").cast("string"), c("ord")).alias("capture_id"),
        P.photometric_exposure(1.0 / (c("ord") % 100 + 1), (c("ord") % 8 + 1).cast("double")).alias("exposure"),
        P.photo_gain(F.when(c("ord") % 2 == 0, (c("ord") % 5 + 1) / 2), iso).alias("gain"),
        P.bit_depth_max(F.when(c("ord") % 2 == 0, 16), F.concat(F.lit("a"), c("ord").cast("string"), F.lit(".JPG"))).alias("bit_max"),
    )


@query("""
    SELECT ord, coalesce(CASE WHEN ord % 3 = 0 THEN (20 + ord % 30) / 36.0 END,
                         CASE WHEN ord % 3 = 1 THEN CAST(8 + ord % 10 AS DOUBLE) / (width * 10.0 / 2000) END, 0.85) AS focal_ratio,
           CASE ord % 5 WHEN 2 THEN 25.4 WHEN 3 THEN 10.0 WHEN 4 THEN 1.0 END AS unit_mm,
           regexp_replace(concat(' B ', band_name, '-', CAST(band_index AS STRING)), '[^a-zA-Z0-9]', '', 'g') AS band,
           CAST(ord % 50 AS DOUBLE) + 0.5 AS lens_focal
    FROM photos
""")
def photo_focals(spark, sf_dir):
    """P8, P14, P15, P16."""
    p = domain(spark, sf_dir, "photos")
    ratio = P.focal_ratio(
        F.when(c("ord") % 3 == 0, (20 + c("ord") % 30).cast("double")), F.when(c("ord") % 3 == 1, (8 + c("ord") % 10).cast("double")),
        F.lit(None).cast("double"), F.lit(2000.0), F.lit(3), c("width").cast("double"),
    )
    lens = F.concat(F.lit("EF"), (c("ord") % 50).cast("string"), F.lit(".5mm f/2"))
    return p.select("ord", ratio.alias("focal_ratio"), P.unit_mm(c("ord") % 5).alias("unit_mm"), P.band_name(F.concat(F.lit(" B "), "band_name", F.lit("-"), c("band_index").cast("string"))).alias("band"), P.lens_focal(lens).alias("lens_focal"))


@query("""
    SELECT ord, CAST(((CAST(floor((longitude + 180) / 6) AS BIGINT) % 60) + 60) % 60 + 1 AS INT) AS zone, latitude < 0 AS south,
           concat('WGS84 UTM ', CAST(CAST(floor((longitude + 180) / 6) AS BIGINT) % 60 + 1 AS STRING), CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END) AS srs
    FROM photos
""")
def utm_zones(spark, sf_dir):
    """G1, G6."""
    return domain(spark, sf_dir, "photos").select("ord", G.utm_zone(c("longitude")).alias("zone"), G.is_south(c("latitude")).alias("south"), G.utm_srs(c("longitude"), c("latitude")).alias("srs"))


_UTM_SQL = """
    WITH k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f), n AS (SELECT a, f, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM k),
    p AS (SELECT ord, longitude AS lon, latitude AS lat, radians(latitude) AS phi, radians(longitude - ((CAST(floor((longitude + 180) / 6) AS BIGINT) % 60 + 1) * 6 - 183)) AS lam, n.*
          FROM photos, n WHERE abs(latitude) < 79),
    t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS tau FROM p),
    u AS (SELECT *, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta,
          a / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS r,
          n/2 - 2*n**2/3 + 5*n**3/16 + 41*n**4/180 - 127*n**5/288 AS a1, 13*n**2/48 - 3*n**3/5 + 557*n**4/1440 + 281*n**5/630 AS a2,
          61*n**3/240 - 103*n**4/140 + 15061*n**5/26880 AS a3, 49561*n**4/161280 - 179*n**5/168 AS a4, 34729*n**5/80640 AS a5 FROM t)
    SELECT ord, round(500000 + 0.9996 * r * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta) + a5*cos(10*xi)*sinh(10*eta)), 3) AS x,
           round(CASE WHEN lat < 0 THEN 10000000.0 ELSE 0 END + 0.9996 * r * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta) + a5*sin(10*xi)*cosh(10*eta)), 3) AS y,
           lon AS lon_back, lat AS lat_back
    FROM u
"""


@query(_UTM_SQL)
def utm_round_trip(spark, sf_dir):
    """Projected and back."""
    p = domain(spark, sf_dir, "photos").filter(F.abs("latitude") < 79)
    zone, south = G.utm_zone(c("longitude")), G.is_south(c("latitude"))
    p = p.withColumn("u", G.to_utm(c("longitude"), c("latitude"), zone, south))
    back = G.from_utm(c("u.x"), c("u.y"), zone, south)
    return p.withColumn("b", back).select("ord", F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"), F.round("b.lon", 3).alias("lon_back"), F.round("b.lat", 3).alias("lat_back"))


@query("""
    SELECT ord, round((a / sqrt(1 - e2 * sin(phi) * sin(phi)) + h) * cos(phi) * cos(lam), 3) AS x, round((a / sqrt(1 - e2 * sin(phi) * sin(phi)) + h) * cos(phi) * sin(lam), 3) AS y,
           round((a / sqrt(1 - e2 * sin(phi) * sin(phi)) * (1 - e2) + h) * sin(phi), 3) AS z
    FROM (SELECT ord, radians(latitude) AS phi, radians(longitude) AS lam, coalesce(altitude, 0) AS h, 6378137.0::DOUBLE AS a, (1/298.257223563::DOUBLE) * (2 - 1/298.257223563::DOUBLE) AS e2 FROM photos) AS t
""")
def ecef_positions(spark, sf_dir):
    """G8."""
    at = G.to_ecef(c("longitude"), c("latitude"), F.coalesce("altitude", F.lit(0.0)))
    return domain(spark, sf_dir, "photos").withColumn("e", at).select("ord", *(F.round(f"e.{k}", 3).alias(k) for k in "xyz"))


@query("""
    WITH p AS (SELECT ord, radians(yaw) / 7 AS rx, radians(pitch) AS ry, radians(roll) AS rz, longitude AS tx, latitude AS ty, coalesce(altitude, 0) AS tz FROM photos), a AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS w FROM p),
    n AS (SELECT *, CASE WHEN w > 0 THEN rx / w ELSE rx END AS x, CASE WHEN w > 0 THEN ry / w ELSE ry END AS y, CASE WHEN w > 0 THEN rz / w ELSE rz END AS z, cos(w) AS c, sin(w) AS s, 1 - cos(w) AS t FROM a)
    SELECT ord, round(0 - ((c + x * x * t) * tx + (y * x * t + z * s) * ty + (z * x * t - y * s) * tz), 6) AS x, round(0 - ((x * y * t - z * s) * tx + (c + y * y * t) * ty + (z * y * t + x * s) * tz), 6) AS y,
           round(0 - ((x * z * t + y * s) * tx + (y * z * t - x * s) * ty + (c + z * z * t) * tz), 6) AS z FROM n
""")
def pose_origins(spark, sf_dir):
    """The camera's origin under a rotation vector."""
    origin = G.pose_origin(F.radians("yaw") / 7, F.radians("pitch"), F.radians("roll"), c("longitude"), c("latitude"), F.coalesce("altitude", F.lit(0.0)))
    return domain(spark, sf_dir, "photos").withColumn("p", origin).select("ord", *(F.round(f"p.{k}", 6).alias(k) for k in "xyz"))


@query()
def photo_angles(spark, sf_dir):
    """Omega, phi, kappa, with the camera's origin; tested against numpy."""
    p = domain(spark, sf_dir, "photos")
    opk = G.omega_phi_kappa(c("longitude"), c("latitude"), F.coalesce("altitude", F.lit(0.0)), c("yaw"), c("pitch"), c("roll"))
    origin = G.pose_origin(F.radians("yaw") / 7, F.radians("pitch"), F.radians("roll"), c("longitude"), c("latitude"), F.coalesce("altitude", F.lit(0.0)))
    return p.withColumn("o", opk).withColumn("p", origin).select("ord", *(F.round(f"o.{k}", 6).alias(k) for k in ("omega", "phi", "kappa")), *(F.round(f"p.{k}", 6).alias(f"origin_{k}") for k in "xyz"))


@query("""
    WITH m AS (SELECT ord, z, longitude * 20037508.342789244 / 180 AS mx, (ln(tan((90 + latitude) * pi() / 360)) / (pi() / 180)) * 20037508.342789244 / 180 AS my FROM photos, (VALUES (3), (7), (12)) AS v(z)),
    t AS (SELECT ord, z, CAST(ceil((mx + 20037508.342789244) / (156543.03392804097 / 2**z) / 256) - 1 AS BIGINT) AS tx, CAST(ceil((my + 20037508.342789244) / (156543.03392804097 / 2**z) / 256) - 1 AS BIGINT) AS ty FROM m)
    SELECT ord, z, tx, ty, CAST(2**z AS BIGINT) - 1 - ty AS google_y,
           list_aggregate([CAST(((tx >> (z - i)) & 1) + 2 * (((CAST(2**z AS BIGINT) - 1 - ty) >> (z - i)) & 1) AS STRING) for i in range(1, z + 1)], 'string_agg', '') AS quadkey
    FROM t
""")
def photo_tiles(spark, sf_dir):
    """Tiles and quadkeys at three zooms."""
    p = domain(spark, sf_dir, "photos").withColumn("z", F.explode(F.array(F.lit(3), F.lit(7), F.lit(12))))
    m = G.lonlat_to_mercator(c("longitude"), c("latitude"))
    p = p.withColumn("m", m).withColumn("t", G.metres_to_tile(c("m.x"), c("m.y"), c("z")))
    return p.select("ord", "z", c("t.tx").alias("tx"), c("t.ty").alias("ty"), G.google_y(c("t.ty"), c("z")).alias("google_y"), G.quadkey(c("t.tx"), c("t.ty"), c("z")).alias("quadkey"))


@query("""
    SELECT z, round(156543.03392804097 / 2**z, 6) AS resolution, round(CAST(tx AS DOUBLE) * (156543.03392804097 / 2**z) * 256 - 20037508.342789244, 3) AS min_x,
           CAST(least(30, greatest(-1, floor(log2(156543.03392804097 / (z + 0.3))))) AS INT) AS zoom_for, CAST(least(23, greatest(5, ceil(log2(156543.03392804097 / (z + 0.3))))) AS INT) AS max_zoom
    FROM (SELECT DISTINCT CAST(ord % 20 AS INT) AS z, ord % 8 AS tx FROM photos) AS t
""")
def tile_arithmetic(spark, sf_dir):
    """G20, G21, G26."""
    t = domain(spark, sf_dir, "photos").select((c("ord") % 20).cast("int").alias("z"), (c("ord") % 8).alias("tx")).distinct()
    box = G.tile_bounds(c("tx"), F.lit(0), c("z"))
    return t.select("z", F.round(G.resolution(c("z")), 6).alias("resolution"), F.round(box["min_x"], 3).alias("min_x"), G.zoom_for_pixel(c("z") + 0.3).alias("zoom_for"), G.max_zoom(c("z") + 0.3).alias("max_zoom"))


@query("""
    SELECT ord, z, CAST(ceil((180 + longitude) / (0.703125 / 2**z) / 256) - 1 AS BIGINT) AS tx, CAST(ceil((90 + latitude) / (0.703125 / 2**z) / 256) - 1 AS BIGINT) AS ty
    FROM photos, (VALUES (2), (9)) AS v(z)
""")
def geodetic_tiles(spark, sf_dir):
    """G23, R32."""
    p = domain(spark, sf_dir, "photos").withColumn("z", F.explode(F.array(F.lit(2), F.lit(9))))
    t = G.geodetic_tile(c("longitude"), c("latitude"), c("z"))
    return p.select("ord", "z", t["tx"].alias("tx"), t["ty"].alias("ty"))


@query("""
    SELECT id, CASE WHEN nir + red = 0 THEN -1 ELSE (nir - red) / (nir + red) END AS ndvi, CASE WHEN nir + edge <> 0 THEN (nir - edge) / (nir + edge) END AS ndre,
           CASE WHEN nir + green <> 0 THEN (nir - green) / (nir + green) END AS gndvi, CASE WHEN green + red <> 0 THEN (green - red) / (green + red) END AS ngrdi,
           CASE WHEN green + red - blue <> 0 THEN (green - red) / (green + red - blue) END AS vari,
           CASE WHEN red - green + blue - 255 <> 0 THEN green - 0.39 * red - 0.61 * blue END AS tgi, CASE WHEN red - green + blue - 255 <> 0 THEN green - 0.39 * red END AS tgi_legacy
    FROM pixels
""")
def vegetation_indices(spark, sf_dir):
    """X14 to X17, C11."""
    r, g, b, n, e = (c(k) for k in ("red", "green", "blue", "nir", "edge"))
    return domain(spark, sf_dir, "pixels").select(
        "id", X.ndvi(n, r).alias("ndvi"), X.ratio_index(n, e).alias("ndre"), X.ratio_index(n, g).alias("gndvi"), X.ngrdi(r, g).alias("ngrdi"), X.vari(r, g, b).alias("vari"),
        X.tgi(r, g, b).alias("tgi"), X.tgi_legacy(r, g, b).alias("tgi_legacy"),
    )


@query("""
    WITH v AS (SELECT *, 1 / (((0.0001::DOUBLE * q - 0.002::DOUBLE) * q + 0.01::DOUBLE) * q + 1) AS vig FROM (SELECT *, sqrt((col - 25)*(col - 25) + (row - 20)*(row - 20)) AS q FROM pixels) AS t),
    d AS (SELECT id, row, (red - 8) / 256 * vig AS a FROM v), g AS (SELECT id, a * (1 / (1 + 0.0002 * row / 0.01 - 0.0003 * row)) AS a FROM d)
    SELECT id, round(greatest(a, 0) / (2 * 0.01) * 1.5 * 0.9, 9) AS radiance, round(greatest(0, least(1, greatest(a, 0) / (2 * 0.01) * 1.5 * 0.9 * pi() / 25)), 9) AS reflectance FROM g
""")
def pixel_radiance(spark, sf_dir):
    """X1, X2, X3, P21, P24."""
    p = domain(spark, sf_dir, "pixels")
    vig = X.vignette(c("col").cast("double"), c("row").cast("double"), P.exactly(F.lit("25 20"), 2), P.vignetting_polynomial(F.lit("0.01 -0.002 0.0001"), F.lit("micasense")), F.lit("micasense"))
    rad = X.radiance(c("red"), F.lit(8.0), F.lit(256.0), vig, P.calibration_triple(F.lit("1.5 0.0002 0.0003")), c("row"), F.lit(0.01), F.lit(2.0), F.lit(0.9), F.lit(False))
    return p.withColumn("r", rad).select("id", F.round("r", 9).alias("radiance"), F.round(X.reflectance(c("r"), F.lit(25.0)), 9).alias("reflectance"))


_THERMAL_SQL = """
    WITH p AS (SELECT id, raw, 21106.77::DOUBLE AS r1, 1501.0::DOUBLE AS b, 1.0::DOUBLE AS f, -7340.0::DOUBLE AS o, 0.012545258::DOUBLE AS r2, 50/100.0 * exp(1.5587 + 0.06939*20 - 0.00027816*400 + 0.00000068455*8000) AS h2o FROM pixels),
    q AS (SELECT *, 1.9 * exp(-sqrt(0.5) * (0.006569 - 0.002276 * sqrt(h2o))) + (1 - 1.9) * exp(-sqrt(0.5) * (0.01262 - 0.00667 * sqrt(h2o))) AS tau, r1 / (r2 * (exp(b / 293.15) - f)) - o AS air FROM p),
    w AS (SELECT *, raw / tau / tau - (1 - tau) / tau * air - (1 - tau) / tau / tau * air AS obj FROM q)
    SELECT id, round(b / ln(r1 / (r2 * (obj + o)) + f) - 273.15, 6) AS celsius, round((raw - 27315) * 0.01, 6) AS altum FROM w
"""


@query(_THERMAL_SQL)
def thermal_celsius(spark, sf_dir):
    """X8, X9."""
    p = domain(spark, sf_dir, "pixels")
    other = X.vendor_celsius(F.lit("FLIR"), F.lit("Duo"), c("raw"), F.lit(0), X.THERMAL)
    return p.select("id", F.round(other, 6).alias("celsius"), F.round(X.vendor_celsius(F.lit("MicaSense"), F.lit("Altum"), c("raw"), F.lit(0), X.THERMAL), 6).alias("altum"))


@query("""
    SELECT id, round(asin(sin(a) / 1.000277), 9) AS refracted,
           CASE WHEN red = high THEN 0 WHEN green = high THEN 1 ELSE 2 END AS lead, high AS v, CASE WHEN high = 0 THEN 0 ELSE (high - low) / high END AS s
    FROM (SELECT *, greatest(red, green, blue) AS high, least(red, green, blue) AS low, (id % 90) * pi() / 180 AS a FROM pixels) AS t
""")
def colour_and_refraction(spark, sf_dir):
    """X5, X18."""
    p = domain(spark, sf_dir, "pixels")
    hsv = X.rgb_to_hsv(c("red"), c("green"), c("blue"))
    angle = F.radians((c("id") % 90).cast("double"))
    lead = F.when(c("red") == hsv["v"], 0).when(c("green") == hsv["v"], 1).otherwise(2)
    return p.select("id", F.round(F.asin(F.sin(angle) / 1.000277), 9).alias("refracted"), lead.alias("lead"), hsv["v"].alias("v"), hsv["s"].alias("s"))


@query("""
    WITH p AS (SELECT ord, radians(yaw) AS yaw, radians(pitch) AS pitch, radians(roll) AS roll, longitude AS lon, latitude AS lat, epoch_ms(taken) // 1000 / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE AS d FROM photos),
    q AS (SELECT *, radians(((357.529::DOUBLE + 0.98560028::DOUBLE * d) % 360 + 360) % 360) AS g, ((280.459::DOUBLE + 0.98564736::DOUBLE * d) % 360 + 360) % 360 AS q FROM p),
    r AS (SELECT *, radians(q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS l, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS tilt, radians(((280.46061837::DOUBLE + 360.98564736629::DOUBLE * d + lon) % 360 + 360) % 360) AS sid FROM q),
    s AS (SELECT *, asin(sin(tilt) * sin(l)) AS dec, sid - atan2(cos(tilt) * sin(l), cos(l)) AS h, radians(lat) AS phi FROM r),
    u AS (SELECT *, asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h)) AS alt, (atan2(-sin(h), tan(dec) * cos(phi) - sin(phi) * cos(h)) + 2 * pi()) % (2 * pi()) AS az FROM s),
    n AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -(cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)) * cos(az) * cos(alt) - (sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)) * sin(az) * cos(alt) + cos(pitch) * cos(roll) * sin(alt)))) AS angle FROM u),
    a AS (SELECT *, asin(sin(angle) / 1.000277::DOUBLE) AS a1, asin(sin(asin(sin(angle) / 1.000277::DOUBLE)) / 1.6::DOUBLE) AS a2 FROM n),
    w AS (SELECT *, sqrt(1 - pow(1.000277::DOUBLE / 1.6 * sin(a1), 2)) AS r1, sqrt(1 - pow(1.6::DOUBLE / 1.38 * sin(a2), 2)) AS r2 FROM a),
    f AS (SELECT *, 1 - (pow((1.000277::DOUBLE * cos(a1) - 1.6 * r1) / (1.000277::DOUBLE * cos(a1) + 1.6 * r1), 2) + pow((1.000277::DOUBLE * r1 - 1.6 * cos(a1)) / (1.000277::DOUBLE * r1 + 1.6 * cos(a1)), 2)) / 2 AS t1,
          1 - (pow((1.6::DOUBLE * cos(a2) - 1.38 * r2) / (1.6::DOUBLE * cos(a2) + 1.38 * r2), 2) + pow((1.6::DOUBLE * r2 - 1.38 * cos(a2)) / (1.6::DOUBLE * r2 + 1.38 * cos(a2)), 2)) / 2 AS t2 FROM w),
    e AS (SELECT *, 0.8::DOUBLE / (t1 * t2) / (1 / 6.0::DOUBLE + cos(angle)) AS direct FROM f)
    SELECT ord, round(degrees(alt), 6) AS altitude, round(degrees(az), 6) AS azimuth, round(angle, 6) AS angle, round(direct * sin(alt) + direct / 6, 6) AS irradiance FROM e
""")
def sun_and_shade(spark, sf_dir):
    """The sun's place, the light sensor's angle and the irradiance."""
    p = domain(spark, sf_dir, "photos")
    sun = X.solar_position(F.unix_seconds(c("taken").cast("timestamp")).cast("double"), c("longitude"), c("latitude"))
    p = p.withColumn("sun", sun).withColumn("normal", X.sensor_normal(F.radians("yaw"), F.radians("pitch"), F.radians("roll")))
    p = p.withColumn("angle", X.sun_sensor_angle(c("normal"), X.ned(c("sun.azimuth"), c("sun.altitude"))))
    estimate = X.irradiance(F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.8), c("angle"), c("sun.altitude"))
    return p.select("ord", F.round(F.degrees("sun.altitude"), 6).alias("altitude"), F.round(F.degrees("sun.azimuth"), 6).alias("azimuth"), F.round("angle", 6).alias("angle"), F.round(estimate, 6).alias("irradiance"))


@query("""
    SELECT brand, round(min(red), 6) AS low, round(max(red), 6) AS high, count(*) AS n, round(avg(red), 6) AS mean, round(stddev_pop(red), 6) AS std FROM pixels GROUP BY brand
""")
def raster_statistics(spark, sf_dir):
    """Band statistics by raster."""
    return domain(spark, sf_dir, "pixels").groupBy("brand").agg(F.round(F.min("red"), 6).alias("low"), F.round(F.max("red"), 6).alias("high"), F.count("*").alias("n"), F.round(F.avg("red"), 6).alias("mean"), F.round(F.stddev_pop("red"), 6).alias("std"))


@query("""
    WITH b AS (SELECT *, min(raw) OVER (PARTITION BY brand) AS low, max(raw) OVER (PARTITION BY brand) AS high FROM pixels)
    SELECT id, CAST(greatest(0, least(255, round_even(CASE WHEN high > low THEN (raw - low) / (high - low) ELSE 0 END * 255, 0))) AS INT) AS byte, CAST(floor(red % 256 / 255 * 65535) AS INT) AS wide FROM b
""")
def byte_scaling(spark, sf_dir):
    """Minimum and maximum by raster from one aggregation joined back."""
    p = domain(spark, sf_dir, "pixels")
    ends = p.groupBy("brand").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return p.join(ends, "brand").select("id", X.to_8bit(c("raw"), c("low"), c("high")).alias("byte"), X.to_16bit(c("red") % 256).alias("wide"))


@query("""
    SELECT ord, CASE WHEN altitude <> 0 THEN (altitude - 20) * 100 / width / 0.85 END AS gsd,
           CAST(least(95, (ord // 1000 + 1) * 40) AS INT) AS step, CASE WHEN greatest(width, height) > 8000 THEN 24576 ELSE 8192 END AS texture,
           CAST(greatest(320, floor(greatest(width, height) * (CASE WHEN width * height / 1e6 < 6 THEN 2.0 WHEN width * height / 1e6 > 42 THEN 0.5 ELSE 1.0 END * 0.25))) AS INT) AS depthmap,
           CASE WHEN ord >= 3600 THEN concat(CAST(ord // 3600 AS STRING), 'h:', CAST(ord % 3600 // 60 AS STRING), 'm:', CAST(ord % 60 AS STRING), 's')
                WHEN ord >= 60 THEN concat(CAST(ord // 60 AS STRING), 'm:', CAST(ord % 60 AS STRING), 's') ELSE concat(CAST(ord AS STRING), 's') END AS took,
           CASE WHEN ord % 40 < 1 THEN 0 ELSE CAST(greatest(0, ceil(ln((ord % 40) * 10000 / 10000.0) / ln(4) - 0.0)) AS INT) END AS divisions
    FROM photos
""")
def planning_numbers(spark, sf_dir):
    """X21, X23, X25, X26, X28, K12."""
    p = domain(spark, sf_dir, "photos")
    return p.select(
        "ord",
        F.when(c("altitude").isNotNull(), X.gsd(c("altitude"), F.lit(20.0), c("width"), F.lit(0.85))).alias("gsd"),
        X.decimation_step(c("ord")).alias("step"),
        X.texture_size(F.greatest("width", "height")).alias("texture"),
        X.depthmap_resolution(c("width"), c("height"), "high").alias("depthmap"),
        X.hms(c("ord")).alias("took"),
        X.ogc_divisions((c("ord") % 40 * 10000).cast("double")).alias("divisions"),
    )


@query("""
    SELECT k, pow(2.0, ceil(log2(least(1.0, abs(k / 10.0 * 1.5) / 5)))) AS factor, greatest(5.0, k / 10.0 * 0.9) AS capped, k / 100.0 * pow(sqrt(2.0), 2) AS third_radius,
           least(0.001, pow(10.0, round_even(log10(k / 100.0), 0)) / 10) AS las_scale
    FROM (SELECT DISTINCT ord % 97 + 1 AS k FROM photos) AS t
""")
def resolution_numbers(spark, sf_dir):
    """X22, X24, G15."""
    k = domain(spark, sf_dir, "photos").select((c("ord") % 97 + 1).alias("k")).distinct()
    g = c("k") / 10.0
    return k.select("k", X.image_scale_factor(g, F.lit(5.0)).alias("factor"), X.capped_resolution(F.lit(5.0), g).alias("capped"), F.element_at(X.radius_steps(c("k") / 100.0, 3), 3).alias("third_radius"), G.las_scale(c("k") / 100.0).alias("las_scale"))
