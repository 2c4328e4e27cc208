"""Scalar expressions: validity masks, rescaling, dates and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def is_finite(v: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def is_infinite(v: Column) -> Column:
    return F.coalesce(F.abs(v) == F.lit(float("inf")), F.lit(False))


def finite_or_null(v: Column) -> Column:
    return F.when(is_finite(v), v)


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def rescale(v: Column, in_min, in_max, out_min=0.1, out_max=1.0) -> Column:
    """Linear map with clipping; an empty input range maps everything to ``out_min``."""
    in_min = in_min if isinstance(in_min, Column) else F.lit(float(in_min))
    in_max = in_max if isinstance(in_max, Column) else F.lit(float(in_max))
    slope = F.when(in_max == in_min, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(float(out_max - out_min)), in_max - in_min)
    )
    return clip(F.lit(float(out_min)) + (v - in_min) * slope, float(out_min), float(out_max))


def parse_date(text: Column) -> Column:
    """ISO text, then date with time, then plain date; NULL when none fits."""
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    )


def relative_days(dt: Column, reference: Column) -> Column:
    """Whole days after the reference date, time of day dropped."""
    return F.date_diff(F.to_date(dt), F.to_date(reference)).cast("float")


def cyclic(v: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle."""
    angle = v.cast("double") * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def week_hour_encoding(dt: Column) -> dict[str, Column]:
    week_sin, week_cos = cyclic(F.weekofyear(dt), 52.0)
    hour_sin, hour_cos = cyclic(F.hour(dt), 24.0)
    return {"week_sin": week_sin, "week_cos": week_cos, "hour_sin": hour_sin, "hour_cos": hour_cos}


def lat_lon_encoding(lat: Column, lon: Column) -> dict[str, Column]:
    lat_sin, lat_cos = cyclic(lat, 360.0)
    lon_sin, lon_cos = cyclic(lon, 360.0)
    return {"lat_sin": lat_sin, "lat_cos": lat_cos, "lon_sin": lon_sin, "lon_cos": lon_cos}


def z_score(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / std


def masked_z_score(v: Column, mean: Column, std: Column) -> Column:
    """An invalid value counts as the mean; a non-finite result becomes 0."""
    filled = F.when(is_finite(v), v).otherwise(mean)
    scored = F.try_divide(filled - mean, std)
    return F.when(is_finite(scored), scored).otherwise(F.lit(0.0))


def earth_sun_distance(dt: Column) -> Column:
    """Astronomical units by day of year."""
    return F.lit(1.0) - F.lit(0.01672) * F.cos(
        F.radians(F.lit(0.9856) * (F.dayofyear(dt) - F.lit(4)))
    )


def reflectance(dn, abs_cal, bandwidth, irradiance, sun_elevation, distance) -> Column:
    """Top-of-atmosphere reflectance of a digital number, before clipping."""
    radiance = dn * abs_cal / bandwidth
    zenith = F.radians(F.lit(90.0) - sun_elevation)
    return F.lit(math.pi) * radiance * distance * distance / (irradiance * F.cos(zenith))


# Solar irradiance per band of the eight-band optical sensor.
SOLAR_IRRADIANCE = {
    "coastal": 1758.222,
    "blue": 1974.241,
    "green": 1856.410,
    "yellow": 1738.479,
    "red": 1559.455,
    "rededge": 1342.069,
    "nir1": 1069.730,
    "nir2": 861.286,
}
