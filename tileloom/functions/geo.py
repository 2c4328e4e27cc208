"""Box arithmetic, box text and WGS84/UTM coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")

# WGS84 ellipsoid and the UTM grid.
_A = 6378137.0
_FLAT = 1.0 / 298.257223563
_SCALE = 0.9996
_EAST = 500000.0


def snap_out(box: dict[str, Column], res: float) -> dict[str, Column]:
    """Bounds moved outward to multiples of the resolution."""
    r = F.lit(float(res))
    return {
        "xmin": F.floor(box["xmin"] / r) * r,
        "ymin": F.floor(box["ymin"] / r) * r,
        "xmax": F.ceil(box["xmax"] / r) * r,
        "ymax": F.ceil(box["ymax"] / r) * r,
    }


def expand(box: dict[str, Column], factor: float = 2.0) -> dict[str, Column]:
    """The box blown up about its centre."""
    cx, cy = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    hx = (box["xmax"] - box["xmin"]) / 2 * F.lit(float(factor))
    hy = (box["ymax"] - box["ymin"]) / 2 * F.lit(float(factor))
    return {"xmin": cx - hx, "ymin": cy - hy, "xmax": cx + hx, "ymax": cy + hy}


def box_columns(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in BOX}


def _corners(box):
    x0, y0, x1, y1 = (box[n] for n in BOX)
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def box_wkt(box: dict[str, Column]) -> Column:
    """Closed ring, counter-clockwise from the lower left corner."""
    args = [v for corner in _corners(box) for v in corner]
    return F.format_string("POLYGON((%s))" % ", ".join(["%.6f %.6f"] * 5), *args)


def box_geojson(box: dict[str, Column]) -> Column:
    ring = F.array(*[F.array(x, y) for x, y in _corners(box)])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def utm_zone(lon: Column) -> Column:
    """Truncating zone number."""
    return ((lon + F.lit(180.0)) / F.lit(6.0)).cast("int") + F.lit(1)


def utm_epsg(lon: Column, lat: Column) -> Column:
    prefix = F.when(lat >= 0, F.lit("EPSG:326")).otherwise(F.lit("EPSG:327"))
    return F.concat(prefix, F.lpad(utm_zone(lon).cast("string"), 2, "0"))


def pixel_to_map(row: Column, col: Column, xmin: Column, ymax: Column, res) -> tuple[Column, Column]:
    """The top left corner of a pixel."""
    return xmin + col * res, ymax - row * res


def map_to_pixel(x: Column, y: Column, xmin: Column, ymax: Column, res) -> tuple[Column, Column]:
    return (
        F.floor((ymax - y) / res).cast("int"),
        F.floor((x - xmin) / res).cast("int"),
    )


def _series():
    n = _FLAT / (2.0 - _FLAT)
    rect = _A / (1.0 + n) * (1.0 + n**2 / 4.0 + n**4 / 64.0)
    fwd = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    inv = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    lat = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    return n, rect, fwd, inv, lat


def to_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Krueger series to third order, millimetres inside the zone."""
    n, rect, fwd, _, _ = _series()
    e2 = 2.0 * math.sqrt(n) / (1.0 + n)
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(zone * 6.0 - 183.0))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(e2) * F.atanh(F.lit(e2) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, northing = eta, xi
    for j, a in enumerate(fwd, start=1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        northing = northing + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    false_north = 0.0 if north else 10000000.0
    return (
        F.lit(_EAST) + F.lit(_SCALE * rect) * east,
        F.lit(false_north) + F.lit(_SCALE * rect) * northing,
    )


def to_lonlat(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """X19 back: UTM metres to degrees."""
    _, rect, _, inv, lat_terms = _series()
    false_north = 0.0 if north else 10000000.0
    xi0 = (y - F.lit(false_north)) / F.lit(_SCALE * rect)
    eta0 = (x - F.lit(_EAST)) / F.lit(_SCALE * rect)
    xi, eta = xi0, eta0
    for j, b in enumerate(inv, start=1):
        xi = xi - F.lit(b) * F.sin(F.lit(2.0 * j) * xi0) * F.cosh(F.lit(2.0 * j) * eta0)
        eta = eta - F.lit(b) * F.cos(F.lit(2.0 * j) * xi0) * F.sinh(F.lit(2.0 * j) * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(lat_terms, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(zone * 6.0 - 183.0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return lon, F.degrees(phi)


def transform_box(df, transform, box: dict[str, Column], steps: int = 21):
    """Box in another system: the extent of its densified edges, one row in, one row out.

    ``transform`` maps (x, y) columns to (x, y) columns. The edge points live in an
    array of fixed length, so no shuffle is needed.
    """
    ts = F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])
    x0, y0, x1, y1 = (box[n] for n in BOX)

    def edge(px, py):
        def point(t):
            x, y = transform(px(t), py(t))
            return F.struct(x.alias("px"), y.alias("py"))

        return F.transform(ts, point)

    along_x, along_y = (lambda t: x0 + (x1 - x0) * t), (lambda t: y0 + (y1 - y0) * t)
    edges = [
        edge(along_x, lambda t: y0), edge(along_x, lambda t: y1),
        edge(lambda t: x0, along_y), edge(lambda t: x1, along_y),
    ]
    ring = F.concat(*edges)
    return df.withColumn("_ring", ring).select(
        *df.columns,
        F.array_min(F.transform("_ring", lambda p: p["px"])).alias("t_xmin"),
        F.array_min(F.transform("_ring", lambda p: p["py"])).alias("t_ymin"),
        F.array_max(F.transform("_ring", lambda p: p["px"])).alias("t_xmax"),
        F.array_max(F.transform("_ring", lambda p: p["py"])).alias("t_ymax"),
    )
