"""Sensor physics and pixel arithmetic as column expressions; null stands for no data."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skysurvey.functions.checks import checked

#: Ratio of direct to diffuse light that the irradiance estimate assumes.
DIRECT_RATIO = 6.0
FRESNEL_LAYERS = (1.000277, 1.6, 1.38)


def polyval(coefficients: Column, x: Column) -> Column:
    """Horner's rule, highest power first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda a, c: a * x + c)


def vignette(x: Column, y: Column, center: Column, polynomial: Column, make: Column) -> Column:
    """The factor of a pixel, 1 where center or polynomial are missing; one vendor gives it inverted.

    The polynomial is given highest power first, without its constant term, which is 1.
    """
    r = F.hypot(x - F.get(center, F.lit(0)), y - F.get(center, F.lit(1)))
    value = polyval(F.concat(polynomial, F.array(F.lit(1.0))), r)
    applies = center.isNotNull() & (F.get(center, F.lit(0)) != 0) & polynomial.isNotNull()
    return F.when(applies, F.when(F.lower(make) == "dji", value).otherwise(1.0 / value)).otherwise(1.0)


def radiance(dn: Column, dark: Column, bit_max: Column, vignetting: Column, triple: Column, row: Column, exposure: Column, gain: Column, gain_adjustment: Column, thermal: Column) -> Column:
    """Dark level, scale, vignette, row gradient, floor at 0 if the dark level is known, gain and time, calibration.

    A missing input skips its own step. Thermal values pass unchanged.
    """
    a1, a2, a3 = (F.get(triple, F.lit(i)) for i in range(3))
    v = dn.cast("double")
    v = F.when(dark.isNotNull(), v - dark).otherwise(v)
    v = F.when(bit_max.isNotNull(), v / bit_max).otherwise(v)
    v = v * F.coalesce(vignetting, F.lit(1.0))
    gradient = 1.0 / (1.0 + a2 * row / exposure - a3 * row)
    v = F.when(a2.isNotNull() & a3.isNotNull() & exposure.isNotNull(), v * gradient).otherwise(v)
    v = F.when(dark.isNotNull(), F.greatest(v, F.lit(0.0))).otherwise(v)
    v = F.when(gain.isNotNull() & exposure.isNotNull(), v / (gain * exposure)).otherwise(v)
    v = v * F.coalesce(a1, F.lit(1.0)) * F.coalesce(gain_adjustment, F.lit(1.0))
    return F.when(thermal, dn.cast("double")).otherwise(v)


def reflectance(radiance_: Column, irradiance: Column) -> Column:
    """X3."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), radiance_ * math.pi / irradiance))


def irradiance(thermal: Column, stored: Column, scale: Column, spectral: Column, sun_angle: Column, sun_altitude: Column) -> Column:
    """1 for thermal bands; the stored value; the light sensor's estimate; else 1."""
    direct = spectral / fresnel(sun_angle) / (1 / DIRECT_RATIO + F.cos(sun_angle))
    estimate = F.when(spectral != 0, direct * F.sin(sun_altitude) + direct / DIRECT_RATIO)
    return F.when(thermal, 1.0).otherwise(F.coalesce(stored * F.coalesce(scale, F.lit(1.0)), estimate, F.lit(1.0)))


def _interface(phi: Column, n1: float, n2: float) -> Column:
    """Transmission of unpolarised light from one medium into the next, 0 outside [0, 1]."""
    root = F.sqrt(1 - (n1 / n2 * F.sin(phi)) * (n1 / n2 * F.sin(phi)))
    s = (n1 * F.cos(phi) - n2 * root) / (n1 * F.cos(phi) + n2 * root)
    p = (n1 * root - n2 * F.cos(phi)) / (n1 * root + n2 * F.cos(phi))
    value = 1 - (s * s + p * p) / 2
    return F.when((value >= 0) & (value <= 1), value).otherwise(0.0)


def fresnel(phi: Column) -> Column:
    """Transmission through the layers; each refraction divides by the first index only."""
    total, angle = F.lit(1.0), phi
    for n1, n2 in zip(FRESNEL_LAYERS, FRESNEL_LAYERS[1:]):
        angle = F.asin(F.sin(angle) / n1)
        total = total * _interface(angle, n1, n2)
    return total


def ned(azimuth: Column, altitude: Column) -> Column:
    """North, east, down of a direction in radians."""
    return F.array(F.cos(azimuth) * F.cos(altitude), F.sin(azimuth) * F.cos(altitude), -F.sin(altitude))


def sensor_normal(yaw: Column, pitch: Column, roll: Column) -> Column:
    """The upward direction of a sensor of that pose, in radians."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return F.array(-(cy * sp * cr + sy * sr), -(sy * sp * cr - cy * sr), -(cp * cr))


def sun_sensor_angle(normal: Column, sun: Column) -> Column:
    """X6."""
    dot = sum((F.get(normal, F.lit(i)) * F.get(sun, F.lit(i)) for i in range(1, 3)), F.get(normal, F.lit(0)) * F.get(sun, F.lit(0)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def solar_position(epoch_s: Column, lon: Column, lat: Column) -> Column:
    """(altitude, azimuth from north) of the sun in radians, to about a hundredth of a degree."""
    d = epoch_s / 86400.0 + 2440587.5 - 2451545.0
    g, q = F.radians(F.pmod(357.529 + 0.98560028 * d, F.lit(360.0))), F.pmod(280.459 + 0.98564736 * d, F.lit(360.0))
    longitude = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * d)
    ascension = F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))
    declination = F.asin(F.sin(tilt) * F.sin(longitude))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * d + lon, F.lit(360.0)))
    hour, phi = sidereal - ascension, F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour), F.tan(declination) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    return F.struct(altitude.alias("altitude"), F.pmod(azimuth, F.lit(2 * math.pi)).alias("azimuth"))


# Parameters and coefficients of the thermal model.
#: Defaults of the thermal model.
THERMAL = {"emissivity": 1.0, "distance": 1.0, "reflected": 20.0, "air": 20.0, "window": 20.0, "transmission": 1.0, "humidity": 50.0, "r1": 21106.77, "b": 1501.0, "f": 1.0, "o": -7340.0, "r2": 0.012545258}
#: The fixed set of one vendor's payload.
M2EA = {**THERMAL, "emissivity": 0.95, "distance": 50.0, "reflected": 30.0, "humidity": 40.0}


def planck_celsius(raw: Column, p: dict[str, float]) -> Column:
    """Degrees Celsius of raw radiometric values; an error if a logarithm's argument is negative."""
    ata = (0.006569, 0.01262, -0.002276, -0.00667, 1.9)
    wet = p["humidity"] / 100 * math.exp(1.5587 + 0.06939 * p["air"] - 0.00027816 * p["air"] ** 2 + 0.00000068455 * p["air"] ** 3)
    half = math.sqrt(p["distance"] / 2)
    tau = ata[4] * math.exp(-half * (ata[0] + ata[2] * math.sqrt(wet))) + (1 - ata[4]) * math.exp(-half * (ata[1] + ata[3] * math.sqrt(wet)))

    def raw_of(celsius: float) -> float:
        return p["r1"] / (p["r2"] * (math.exp(p["b"] / (celsius + 273.15)) - p["f"])) - p["o"]

    e, t = p["emissivity"], p["transmission"]
    parts = [
        (1 - e) / e * raw_of(p["reflected"]),
        (1 - tau) / e / tau * raw_of(p["air"]),
        (1 - t) / e / tau / t * raw_of(p["window"]),
        (1 - tau) / e / tau / t / tau * raw_of(p["air"]),
    ]
    object_ = raw / e / tau / t / tau - sum(parts)
    inner = p["r1"] / (p["r2"] * (object_ + p["o"])) + p["f"]
    return checked(inner.isNull() | (inner >= 0), p["b"] / F.log(inner) - 273.15, "thermal model: the logarithm's argument is negative")


def vendor_celsius(make: Column, model: Column, raw: Column, lowest: Column, params: dict[str, float]) -> Column:
    """Degrees Celsius by vendor; lowest is the image's minimum."""
    m, k = F.lower(F.trim(make)), F.lower(F.trim(model))
    return (
        F.when((m == "micasense") & (k == "altum"), (raw - 27315.0) * 0.01)
        .when((m == "dji") & k.contains("zh20t") & (lowest >= 23315), (raw - 27315.0) * 0.01)
        .when((m == "dji") & (k == "mavic2-enterprise-advanced"), planck_celsius(raw, M2EA))
        .when(m == "sentera", raw * 0.01 - 273.15)
        .otherwise(planck_celsius(raw, params))
    )


def temperature(text: Column) -> Column:
    """The number of a value with a unit, as in '25.0 C' or '1.5 m'."""
    return F.nullif(F.regexp_extract(text, r"(-?[\d.]+)", 1), F.lit("")).try_cast("double")


def normalized(value: Column, low: Column, high: Column) -> Column:
    """X11: min-max scale; 0 where the range is empty."""
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))


def to_8bit(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..255, half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(normalized(value, low, high) * 255))).cast("int")


def to_16bit(value: Column) -> Column:
    """X13, K11."""
    return (value / 255.0 * 65535.0).cast("int")


def ndvi(nir: Column, red: Column) -> Column:
    """-1 where the sum is 0."""
    total = nir + red
    return F.when(total == 0, -1.0).otherwise((nir - red) / F.nullif(total, F.lit(0.0)))


def ratio_index(a: Column, b: Column) -> Column:
    """NDVI, NDRE and GNDVI; null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def ngrdi(r: Column, g: Column) -> Column:
    """X16."""
    return F.try_divide(g - r, g + r)


def vari(r: Column, g: Column, b: Column) -> Column:
    """X16."""
    return F.try_divide(g - r, g + r - b)


def tgi(r: Column, g: Column, b: Column) -> Column:
    """Triangular greenness; null where r, g and b cancel out."""
    return F.when(r - g + b - 255 != 0, g - 0.39 * r - 0.61 * b)


def tgi_legacy(r: Column, g: Column, b: Column) -> Column:
    """Without its blue term, as older results have it."""
    return F.when(r - g + b - 255 != 0, g - 0.39 * r)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in 0..1, saturation in 0..1, value in 0..255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = (
        F.when(span == 0, 0.0)
        .when(high == r, F.pmod(F.try_divide(g - b, span) / 6, F.lit(1.0)))
        .when(high == g, F.try_divide(b - r, span) / 6 + 1 / 3)
        .otherwise(F.try_divide(r - g, span) / 6 + 2 / 3)
    )
    return F.struct(hue.alias("h"), F.when(high == 0, 0.0).otherwise(F.try_divide(span, high)).alias("s"), high.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """X18."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))

    def pick(*values: Column) -> Column:
        out = F.when(k == 0, values[0])
        for n, x in enumerate(values[1:], 1):
            out = out.when(k == n, x)
        return out

    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def shaded(r: Column, g: Column, b: Column, hillshade: Column) -> Column:
    """The colour with its value replaced by the hillshade, kept where there is none."""
    hsv = rgb_to_hsv(r, g, b)
    return hsv_to_rgb(hsv["h"], hsv["s"], F.coalesce(hillshade, hsv["v"]))


def gsd(height: Column, ground: Column, width: Column, focal: Column) -> Column:
    """Centimetres of a pixel; null where the focal length is 0."""
    return F.try_divide((height - ground) * 100.0 / width, focal)


def rounded_gsd(value: Column, default: float, digits: int = 0, ignore: bool = False) -> Column:
    """X22."""
    return F.lit(default) if ignore else F.coalesce(F.round(value, digits), F.lit(default))


def image_scale_factor(gsd_: Column, target: Column) -> Column:
    """The smallest power of two that is at least min(1, |1.5 gsd| / target)."""
    want = F.least(F.lit(1.0), F.abs(gsd_ * 1.5) / target)
    return F.when((gsd_ > 0) & (target > 0), F.pow(F.lit(2.0), F.ceil(F.log2(want)))).otherwise(1.0)


def image_max_size(width: Column, height: Column, factor: Column) -> Column:
    """Pixels of the longest side at a scale factor."""
    return F.ceil(F.greatest(width, height) * factor).cast("int")


def capped_resolution(wanted: Column, gsd_: Column, error: float = 0.1, scale: float = 1.0, ignore_gsd: bool = False, ignore_wanted: bool = False) -> Column:
    """Not finer than the ground resolution allows."""
    if ignore_gsd:
        return wanted
    limit = gsd_ * (1 - error) * scale
    return F.coalesce(limit if ignore_wanted else F.greatest(limit, wanted), wanted)


#: Share of the largest side by quality, for depth maps and for features.
DEPTHMAP_SCALE = {"ultra": 0.5, "high": 0.25, "medium": 0.125, "low": 0.0675, "lowest": 0.03375}
FEATURE_SCALE = {"ultra": 1.0, "high": 0.5, "medium": 0.25, "low": 0.125, "lowest": 0.0675}


def depthmap_resolution(width: Column, height: Column, quality: str) -> Column:
    """Pixels of the depth maps' longest side; 640 without a size."""
    megapixels = width * height / 1e6
    factor = F.when(megapixels < 6, 2.0).when(megapixels > 42, 0.5).otherwise(1.0) * DEPTHMAP_SCALE[quality]
    return F.coalesce(F.greatest(F.lit(320), (F.greatest(width, height) * factor).cast("int")), F.lit(640))


def feature_size(width: Column, height: Column, quality: str) -> Column:
    """Pixels of the longest side for feature extraction, 320 to 4480."""
    megapixels = width * height / 1e6
    factor = F.least(F.lit(1.0), F.when(megapixels < 2, 2.0).when(megapixels > 42, 0.5).otherwise(1.0) * FEATURE_SCALE[quality])
    return F.least(F.lit(4480), F.greatest(F.lit(320), (F.greatest(width, height) * factor).cast("int")))


def radius_steps(spacing: Column, count: int, multiplier: float = 1.0) -> Column:
    """Point spacing times powers of the square root of 2."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: spacing * multiplier * F.pow(F.lit(math.sqrt(2)), k))


def decimation_step(photos: Column, fast: bool = False) -> Column:
    """Every so many points are kept; more for large sets, 95 at most."""
    return F.lit(4) if fast else F.least(F.lit(95), (F.floor(photos / 1000) + 1).cast("int") * 40)


def texture_size(side: Column) -> Column:
    """X26."""
    return F.when(side > 8000, 8192 * 3).otherwise(8192)


def overlap_diagram(width: Column, height: Column, pixels: int = 1400, dense: bool = True) -> Column:
    """Resolution and radius of the overlap diagram."""
    size = F.greatest(width, height) / float(pixels)
    return F.struct(size.alias("resolution"), (size * math.sqrt(2) * (1 if dense else 10)).alias("radius"))


def hms(seconds: Column) -> Column:
    """X28."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.format_string("%dh:%dm:%ds", h, m, s)).when(m > 0, F.format_string("%dm:%ds", m, s)).otherwise(F.format_string("%ds", s))


def scaled_homography(h: Column, factor: float) -> Column:
    """A 3 by 3 matrix, row by row, found on an image scaled by factor, for the whole image."""
    gain = [1, 1, 1 / factor, 1, 1, 1 / factor, factor, factor, 1]
    return F.zip_with(h, F.array(*(F.lit(float(g)) for g in gain)), lambda a, b: a * b)


def warp(h: Column, x: Column, y: Column) -> Column:
    """A place under a homography."""
    at = [F.get(h, F.lit(i)) for i in range(9)]
    w = at[6] * x + at[7] * y + at[8]
    return F.struct(((at[0] * x + at[1] * y + at[2]) / w).alias("x"), ((at[3] * x + at[4] * y + at[5]) / w).alias("y"))


def ogc_divisions(area: Column) -> Column:
    """K12."""
    return F.when(area < 10000, 0).otherwise(F.ceil(F.log(area / 10000.0) / math.log(4)).cast("int"))
