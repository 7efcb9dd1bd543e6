"""Photo metadata as column expressions: tags, focal lengths, capture times, poses and camera ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Millimetres of an EXIF resolution unit.
UNIT_MM = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}
#: Values used where a photo has none.
DEFAULT_FOCAL_RATIO = 0.85
DEFAULT_DOP = 10.0
DEFAULT_READOUT_MS = 30.0

# Read-out milliseconds of rolling shutters, by make and model; a range of
# megapixels where it depends on the photo's size.
READOUT_MS = [
    ("autel robotics xt701", None, None, 25.0),
    ("dji phantom vision fc200", None, None, 74.0),
    ("dji fc300s", None, None, 33.0),
    ("dji fc300c", None, None, 33.0),
    ("dji fc300x", None, None, 33.0),
    ("dji fc330", None, None, 33.0),
    ("dji fc6310", None, None, 33.0),
    ("dji fc7203", None, 10.0, 19.0),
    ("dji fc7203", 10.0, None, 25.0),
    ("dji fc2103", None, None, 32.0),
    ("dji fc3170", None, None, 27.0),
    ("dji fc3411", None, None, 32.0),
    ("dji fc220", None, None, 64.0),
    ("hasselblad l1d-20c", None, 17.0, 47.0),
    ("hasselblad l1d-20c", 17.0, None, 56.0),
    ("hasselblad l2d-20c", None, None, 16.6),
    ("dji fc3682", None, None, 23.0),
    ("dji fc3582", None, 48.0, 26.0),
    ("dji fc3582", 48.0, None, 60.0),
    ("dji fc8482", None, 12.0, 16.0),
    ("dji fc8482", 12.0, 20.0, 21.0),
    ("dji fc8482", 20.0, 45.0, 43.0),
    ("dji fc8482", 45.0, None, 58.0),
    ("dji fc350", None, None, 30.0),
    ("dji mavic2-enterprise-advanced", None, None, 31.0),
    ("dji zenmuse z30", None, None, 8.0),
    ("yuneec e90", None, None, 44.0),
    ("gopro hero4 black", None, None, 30.0),
    ("gopro hero8 black", None, None, 17.0),
    ("teracube teracube one", None, None, 32.0),
    ("fujifilm x-a5", None, None, 186.0),
    ("fujifilm x-t2", None, None, 35.0),
    ("autel robotics xl724", None, None, 29.0),
    ("parrot anafi", None, None, 39.0),
    ("autel robotics xt705", None, None, 30.0),
]


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed degrees; a missing reference is north or east; null if a part is null."""
    sign = F.when(F.upper(F.substring(F.coalesce(ref, F.lit("N")), 1, 1)).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (degrees + minutes / 60.0 + seconds / 3600.0)


def decimal_to_dms(value: Column, positive: str, negative: str) -> Column:
    """(degrees, minutes, seconds rounded to 5 digits, reference)."""
    size = F.abs(value)
    degrees = F.floor(size)
    minutes = F.floor((size - degrees) * 60)
    seconds = F.round((size - degrees - minutes / 60.0) * 3600, 5)
    return F.struct(degrees.alias("degrees"), minutes.alias("minutes"), seconds.alias("seconds"), F.when(value < 0, negative).otherwise(positive).alias("ref"))


def signed_altitude(altitude: Column, ref: Column) -> Column:
    """Below sea level if the reference is positive."""
    return F.when(ref > 0, -altitude).otherwise(altitude)


def rational(text: Column) -> Column:
    """P4: 'n/d' or 'n' as a double, null where the denominator is 0."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))


def rationals(text: Column) -> Column:
    """A comma-separated list of rationals as doubles."""
    return F.transform(F.split(text, r"\s*,\s*"), rational)


def parsed_fraction(text: Column) -> Column:
    """P5: the quotient as a string, or the text unchanged where it is not a fraction of non-zero denominator."""
    return F.coalesce(F.when(text.contains("/"), rational(text)).cast("string"), text)


def first_tag(tags: Column, names: list[str]) -> Column:
    """The value of the first tag present."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])


def capture_millis(stamp: Column, subsec: Column) -> Column:
    """Epoch milliseconds of 'Y:m:d H:M:S' in UTC plus a fraction given as digits (a minus sign is kept)."""
    seconds = F.unix_timestamp(F.to_timestamp(stamp, "yyyy:MM:dd HH:mm:ss")).cast("double")
    digits = F.regexp_replace(F.trim(subsec), "-", "")
    fraction = F.when(F.coalesce(F.length(digits), F.lit(0)) > 0, F.concat(F.lit("0."), digits).try_cast("double")).otherwise(0.0)
    return seconds * 1000 + F.when(F.trim(subsec).startswith("-"), -fraction).otherwise(fraction) * 1000


def band_name(name: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.regexp_replace(name, " ", ""), "[^a-zA-Z0-9]", "")


def filename_band(name: Column, aliases: dict[str, str]) -> Column:
    """(capture, band) from names like 'IMG_0001_nir.jpg'."""
    pattern = r"^(.*)_([a-zA-Z0-9]+)\.[A-Za-z]{3,4}$"
    band = F.lower(F.regexp_extract(name, pattern, 2))
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.struct(F.regexp_extract(name, pattern, 1).alias("capture"), F.coalesce(F.try_element_at(table, band), band).alias("band"))


def rtk_stddev(std_lon: Column, std_lat: Column, accuracy: Column) -> Column:
    """P10: twice the larger RTK deviation, or twice the accuracy tag."""
    return F.coalesce(F.when(std_lon.isNotNull() & std_lat.isNotNull(), F.greatest(std_lon, std_lat)), accuracy) * 2


def gps_dop(xy: Column, z: Column) -> Column:
    """The larger deviation if positive."""
    value = F.greatest(xy, z)
    return F.when(value > 0, value)


def normalized_ypr(make: Column, pitch: Column, roll: Column) -> Column:
    """vendors' pitch from the nadir, and roll of the opposite sign."""
    m = F.lower(F.trim(make))
    return F.struct(F.when(m.isin("dji", "hasselblad"), pitch + 90).otherwise(pitch).alias("pitch"), F.when(m == "sensefly", -roll).otherwise(roll).alias("roll"))


def lens_focal(lens: Column) -> Column:
    """Millimetres in a lens name."""
    return F.nullif(F.regexp_extract(lens, r"([\d.]+)mm", 1), F.lit("")).try_cast("double")


def unit_mm(unit: Column) -> Column:
    """Millimetres of a resolution unit."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in UNIT_MM.items() for x in kv)), unit.cast("int"))


def focal_ratio(focal_35mm: Column, focal: Column, sensor_width: Column, plane_resolution: Column, unit: Column, width: Column) -> Column:
    """Focal length over sensor width, by the best source present."""
    from_plane = F.try_divide(width * unit_mm(unit), plane_resolution)
    sensor = F.coalesce(F.when(from_plane > 0, from_plane), F.when(sensor_width > 0, sensor_width))
    return F.coalesce(F.when(focal_35mm > 0, focal_35mm / 36.0), F.when((focal > 0) & sensor.isNotNull(), focal / sensor), F.lit(DEFAULT_FOCAL_RATIO))


def has_geo(latitude: Column, longitude: Column) -> Column:
    """Both coordinates present (0 is a value)."""
    return latitude.isNotNull() & longitude.isNotNull()


def has_all(*columns: Column) -> Column:
    """Every one of the columns present (poses, speeds, angles)."""
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def is_thermal(band: Column, make: Column, model: Column) -> Column:
    """P19."""
    return F.upper(band).isin("LWIR") | (F.lower(F.trim(make)) == "dji") & F.lower(F.trim(model)).contains("mavic2-enterprise-advanced")


def is_rgb(band: Column) -> Column:
    """P19."""
    return F.lower(band).isin("rgb", "redgreenblue")


def camera_id(make: Column, model: Column, width: Column, height: Column, projection: Column, focal: Column) -> Column:
    """P20: the key under which photos share a camera model."""
    return F.lower(F.concat_ws(" ", F.lit("v2"), F.trim(make), F.trim(model), width.cast("string"), height.cast("string"), projection, F.substring(focal.cast("string"), 1, 6)))


def number_list(text: Column) -> Column:
    """A blank-separated list of numbers."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))


def calibration_triple(text: Column) -> Column:
    """Exactly three (or another number of) parts, else null."""
    return exactly(text, 3)


def exactly(text: Column, n: int) -> Column:
    parts = number_list(text)
    return F.when(F.size(parts) == n, parts)


def dark_level(text: Column) -> Column:
    """The mean of the black levels."""
    parts = number_list(text)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def photo_gain(gain: Column, iso: Column) -> Column:
    """P23."""
    return F.coalesce(gain, iso / 100.0)


def vignetting_polynomial(text: Column, make: Column) -> Column:
    """Highest power first; one vendor already writes it so."""
    parts = number_list(text)
    return F.when(F.lower(make) == "sentera", parts).otherwise(F.reverse(parts))


def photometric_exposure(time: Column, f_number: Column) -> Column:
    """P25."""
    return F.when((time > 0) & (f_number > 0), time / (f_number * f_number))


def sun_sensor(value: Column) -> Column:
    """P26."""
    return value / 65535.0


def dls_pose(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Zeros where missing."""
    return F.array(*(F.coalesce(c, F.lit(0.0)) for c in (yaw, pitch, roll)))


def bit_depth_max(bits: Column, name: Column) -> Column:
    """P27."""
    return F.when(bits > 0, F.pow(F.lit(2.0), bits)).when(F.lower(name).rlike(r"\.jpe?g$"), 256.0)


def capture_id(uuid: Column, utc: Column) -> Column:
    """P28."""
    return F.coalesce(uuid, utc.cast("string"))


def megapixels(exif_width: Column, exif_height: Column, width: Column, height: Column) -> Column:
    """P29."""
    return F.coalesce(exif_width * exif_height / 1e6, width * height / 1e6, F.lit(0.0))


def sfm_export(lat: Column, lon: Column, alt: Column, dop: Column, speed_x: Column, speed_y: Column, speed_z: Column, camera: Column) -> Column:
    """The structure handed to reconstruction; speed is in the order y, x, z and needs a position."""
    geo = has_geo(lat, lon)
    gps = F.when(geo, F.struct(lat.alias("latitude"), lon.alias("longitude"), F.coalesce(alt, F.lit(0.0)).alias("altitude"), F.coalesce(dop, F.lit(DEFAULT_DOP)).alias("dop")))
    speed = F.when(geo & has_all(speed_x, speed_y, speed_z), F.array(speed_y, speed_x, speed_z))
    return F.struct(camera.alias("camera"), gps.alias("gps"), speed.alias("speed"))


def with_readout(photos: DataFrame, key: str, mp: str, override: float = 0.0, rows: list[tuple] | None = None) -> DataFrame:
    """Photos with ``readout_ms``: the override, the table's entry for the photo's size, or the default."""
    if override > 0:
        return photos.withColumn("readout_ms", F.lit(float(override)))
    table = photos.sparkSession.createDataFrame(rows or READOUT_MS, "_model string, _low double, _high double, _ms double")
    fits = (
        (F.lower(F.trim(F.col(key))) == F.col("_model"))
        & (F.col("_low").isNull() | (F.col(mp) >= F.col("_low")))
        & (F.col("_high").isNull() | (F.col(mp) < F.col("_high")))
    )
    # The table is a constant of a few rows.
    return photos.join(F.broadcast(table), fits, "left").withColumn("readout_ms", F.coalesce("_ms", F.lit(DEFAULT_READOUT_MS))).drop("_model", "_low", "_high", "_ms")


def needs_sky_mask(mask: Column, projection: Column, pitch: Column, name: Column) -> Column:
    """P32."""
    return mask.isNull() & (projection.isin("fisheye", "fisheye_opencv", "spherical", "equirectangular") | pitch.isNull() | (F.abs(pitch) > 20)) & ~name.contains(" ")


def needs_background_mask(mask: Column, name: Column) -> Column:
    """P33."""
    return mask.isNull() & ~name.contains(" ")


def mask_key(name: Column) -> Column:
    """The base name under which a mask and its photo meet; null for names with blanks."""
    base = F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "")
    return F.when(~name.contains(" "), F.regexp_replace(base, "_mask$", ""))


def is_mask(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "").endswith("_mask")
