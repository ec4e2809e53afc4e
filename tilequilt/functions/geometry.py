"""Geometry as column expressions: pixel, map and geographic coordinates, boxes, rings and their texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, and the scale and false origin of UTM.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_NORTH = 0.9996, 500000.0, 10000000.0


def affine(gt: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel under a six-number transform."""
    return gt[0] + px * gt[1] + py * gt[2], gt[3] + px * gt[4] + py * gt[5]


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> list[tuple[Column, Column]]:
    """Top left, top right, bottom right, bottom left."""
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def ring(points: list[tuple[Column, Column]], x: str = "x", y: str = "y") -> Column:
    return F.array(*(F.struct(a.alias(x), b.alias(y)) for a, b in points))


def footprint(gt: Column, width: Column, height: Column) -> Column:
    """The image's outline in map coordinates, an open ring of four points."""
    zero = F.lit(0)
    return ring([affine(gt, x, y) for x, y in corners(zero, zero, width, height)], "lon", "lat")


#: Third flattening, and series from conformal and from authalic to geodetic latitude, by sines of 2, 4 and 6 times.
_N, _E2 = WGS84_F / (2 - WGS84_F), WGS84_F * (2 - WGS84_F)
_CONFORMAL = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_AUTHALIC = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)

# Projected codes beside UTM, as (method, parameters). Angles in degrees, lengths in metres.
# transverse: central meridian, scale, false easting and northing. mercator: central meridian.
# conic and albers: two parallels, latitude and longitude of origin, false easting and northing.
# polar: parallel of true scale, longitude of origin, false easting and northing.
# azimuthal: latitude and longitude of origin, false easting and northing.
PROJECTIONS = {
    2154: ("conic", (44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0)),
    2193: ("transverse", (173.0, 0.9996, 1600000.0, 10000000.0)),
    3006: ("transverse", (15.0, 0.9996, 500000.0, 0.0)),
    3031: ("polar", (-71.0, 0.0, 0.0, 0.0)),
    3032: ("polar", (-71.0, 70.0, 6000000.0, 6000000.0)),
    3034: ("conic", (35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0)),
    3035: ("azimuthal", (52.0, 10.0, 4321000.0, 3210000.0)),
    3067: ("transverse", (27.0, 0.9996, 500000.0, 0.0)),
    3395: ("mercator", (0.0,)),
    3413: ("polar", (70.0, -45.0, 0.0, 0.0)),
    3995: ("polar", (71.0, 0.0, 0.0, 0.0)),
    5070: ("albers", (29.5, 45.5, 23.0, -96.0, 0.0, 0.0)),
}
# Geographic codes, and ranges of codes of UTM grids: first, last, zone of the first, whether southern.
GEOGRAPHIC = (4258, 4269, 4283, 4326, 7844)
UTM_GRIDS = ((25828, 25838, 28, False), (26901, 26923, 1, False), (28348, 28358, 48, True), (32601, 32660, 1, False), (32701, 32760, 1, True), (7846, 7859, 46, True))


def projection(epsg: int) -> tuple[str, tuple[float, ...]] | None:
    """Method and parameters of a projected code (datums are not shifted), or None."""
    for first, last, zone, south in UTM_GRIDS:
        if first <= epsg <= last:
            return "transverse", ((epsg - first + zone) * 6 - 183.0, UTM_SCALE, UTM_EAST, UTM_NORTH if south else 0.0)
    return PROJECTIONS.get(epsg)


def _geodetic(lat: Column, series: tuple[float, ...]) -> Column:
    return (lat + sum((d * F.sin(2 * (i + 1) * lat) for i, d in enumerate(series)), F.lit(0.0))) * (180 / math.pi)


def _transverse(x: Column, y: Column, lon0: Column | float, scale: float) -> tuple[Column, Column]:
    """Longitude and latitude of a transverse Mercator position, false origin taken off."""
    beta = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
    xi, eta = y / (scale * _RECTIFYING), x / (scale * _RECTIFYING)
    xi1 = xi - sum((b * F.sin(2 * (i + 1) * xi) * F.cosh(2 * (i + 1) * eta) for i, b in enumerate(beta)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * (i + 1) * xi) * F.sinh(2 * (i + 1) * eta) for i, b in enumerate(beta)), F.lit(0.0))
    return lon0 + F.atan2(F.sinh(eta1), F.cos(xi1)) * (180 / math.pi), _geodetic(F.asin(F.sin(xi1) / F.cosh(eta1)), _CONFORMAL)


def _t(lat: float) -> float:
    """Tangent of half the conformal colatitude of a latitude in radians."""
    e = math.sqrt(_E2)
    return math.tan(math.pi / 4 - lat / 2) * ((1 + e * math.sin(lat)) / (1 - e * math.sin(lat))) ** (e / 2)


def _m(lat: float) -> float:
    """Radius of a parallel, by the semi-major axis."""
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _q(lat: float) -> float:
    e, s = math.sqrt(_E2), math.sin(lat)
    return (1 - _E2) * (s / (1 - _E2 * s * s) + math.atanh(e * s) / e)


def _unprojected(method: str, p: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a projected position."""
    deg = 180 / math.pi
    if method == "transverse":
        return _transverse(x - p[2], y - p[3], p[0], p[1])
    if method == "mercator":
        return p[0] + x / WGS84_A * deg, _geodetic(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2, _CONFORMAL)
    if method == "polar":
        south = -1 if p[0] < 0 else 1
        true = abs(p[0]) / deg
        dx, dy = (x - p[2]) * south, (y - p[3]) * south
        t = F.sqrt(dx * dx + dy * dy) * (_t(true) / (WGS84_A * _m(true)))
        lon = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(dx, -dy)) * south * deg + p[1]
        return F.pmod(lon + 180, F.lit(360.0)) - 180, _geodetic(math.pi / 2 - 2 * F.atan(t), _CONFORMAL) * south
    if method == "azimuthal":
        q0, qp = _q(p[0] / deg), _q(math.pi / 2)
        b0, rq = math.asin(q0 / qp), WGS84_A * math.sqrt(qp / 2)
        d = WGS84_A * _m(p[0] / deg) / (rq * math.cos(b0))
        dx, dy = (x - p[2]) / d, (y - p[3]) * d
        rho = F.sqrt(dx * dx + dy * dy)
        c = 2 * F.asin(rho / (2 * rq))
        beta = F.when(rho == 0, b0).otherwise(F.asin(F.cos(c) * math.sin(b0) + dy * F.sin(c) * math.cos(b0) / rho))
        lon = F.atan2(dx * F.sin(c), rho * math.cos(b0) * F.cos(c) - dy * math.sin(b0) * F.sin(c))
        return F.when(rho == 0, 0.0).otherwise(lon) * deg + p[1], _geodetic(beta, _AUTHALIC)
    lat1, lat2, lat0 = (v / deg for v in p[:3])
    if method == "conic":
        n = (math.log(_m(lat1)) - math.log(_m(lat2))) / (math.log(_t(lat1)) - math.log(_t(lat2)))
        f = WGS84_A * _m(lat1) / (n * _t(lat1) ** n)
        dx, dy = x - p[4], f * _t(lat0) ** n - (y - p[5])
        t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(f), F.lit(1 / n))
        return F.atan2(dx, dy) / n * deg + p[3], _geodetic(math.pi / 2 - 2 * F.atan(t), _CONFORMAL)
    n = (_m(lat1) ** 2 - _m(lat2) ** 2) / (_q(lat2) - _q(lat1))
    c = _m(lat1) ** 2 + n * _q(lat1)
    dx, dy = x - p[4], WGS84_A * math.sqrt(c - n * _q(lat0)) / n - (y - p[5])
    q = (c - (dx * dx + dy * dy) * (n * n / WGS84_A**2)) / n
    beta = F.asin(F.least(F.greatest(q / _q(math.pi / 2), F.lit(-1.0)), F.lit(1.0)))
    return F.atan2(dx, dy) / n * deg + p[3], _geodetic(beta, _AUTHALIC)


def to_wgs84(epsg: Column | int | None, x: Column, y: Column) -> Column:
    """struct<lon, lat, crs_status>: geographic codes pass, projected ones are unprojected, others pass untouched.

    A code known beforehand (an int, or None) may be any of projection's and makes a small expression; a column of
    codes may hold those of UTM_GRIDS, Web Mercator and GEOGRAPHIC.
    """
    mercator_lon = x / WGS84_A * (180 / math.pi)
    mercator_lat = (2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2) * (180 / math.pi)
    if not isinstance(epsg, Column):
        known = projection(epsg or 0)
        lon, lat = _unprojected(*known, x, y) if known else (mercator_lon, mercator_lat) if epsg == 3857 else (x, y)
        status = "none" if epsg is None else "projected" if known or epsg == 3857 else "geographic" if epsg in GEOGRAPHIC else "passed through"
        return F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(status).alias("crs_status"))
    zone, south = F.lit(None), F.lit(False)
    for first, last, least, below in UTM_GRIDS:
        zone = F.when(epsg.between(first, last), epsg - (first - least)).otherwise(zone)
        south = (south | epsg.between(first, last)) if below else south
    utm = zone.isNotNull()
    utm_lon, utm_lat = _transverse(x - UTM_EAST, F.when(south, y - UTM_NORTH).otherwise(y), zone * 6 - 183, UTM_SCALE)
    lon = F.when(utm, utm_lon).when(epsg == 3857, mercator_lon).otherwise(x)
    lat = F.when(utm, utm_lat).when(epsg == 3857, mercator_lat).otherwise(y)
    status = F.when(epsg.isNull(), "none").when(utm | (epsg == 3857), "projected").when(epsg.isin(*GEOGRAPHIC), "geographic").otherwise("passed through")
    return F.struct(lon.alias("lon"), lat.alias("lat"), status.alias("crs_status"))


def from_wgs84_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """struct<x, y> in the northern UTM grid of a zone."""
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    e, dl = math.sqrt(_E2), F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * (i + 1) * xi) * F.sinh(2 * (i + 1) * eta) for i, a in enumerate(alpha)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * (i + 1) * xi) * F.cosh(2 * (i + 1) * eta) for i, a in enumerate(alpha)), F.lit(0.0))
    return F.struct((UTM_EAST + UTM_SCALE * _RECTIFYING * x).alias("x"), (UTM_SCALE * _RECTIFYING * y).alias("y"))


def box_ring(x_offset: Column, y_offset: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Image-pixel ring of a tile box: the offset plus truncated corner, and truncated sides from there."""
    x0, y0 = x_offset + x.cast("int"), y_offset + y.cast("int")
    return ring(corners(x0, y0, x0 + w.cast("int"), y0 + h.cast("int")))


def polygon_ring(x_offset: Column, y_offset: Column, polygon: Column) -> Column:
    """Image-pixel ring of a tile polygon: rounded half away from zero."""
    return F.transform(polygon, lambda p: F.struct((x_offset + F.round(p["x"])).cast("int").alias("x"), (y_offset + F.round(p["y"])).cast("int").alias("y")))


def detection_ring(x_offset: Column, y_offset: Column, polygon: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The polygon where it has four points or more, else the box."""
    return F.when(F.size(polygon) >= 4, polygon_ring(x_offset, y_offset, polygon)).otherwise(box_ring(x_offset, y_offset, x, y, w, h))


def bounds(points: Column, x: str = "x", y: str = "y") -> Column:
    """struct<x0, y0, x1, y1> of a ring."""
    xs, ys = F.transform(points, lambda p: p[x]), F.transform(points, lambda p: p[y])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def ring_boxes(points: Column) -> Column:
    """Boxes that tile the inside of a rectilinear ring, holes and touching corners by the even-odd rule.

    The ring's y values cut it into strips; the sides that run through a strip bound its inside in pairs.
    """
    after = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, F.lit(1), F.lit(1)))
    side = F.zip_with(points, after, lambda a, b: F.struct(a["x"].alias("x"), F.least(a["y"], b["y"]).alias("low"), F.greatest(a["y"], b["y"]).alias("high")))
    sides = F.filter(side, lambda s: s["low"] < s["high"])
    ys = F.array_sort(F.array_distinct(F.transform(points, lambda p: p["y"])))
    strips = F.zip_with(F.slice(ys, F.lit(1), F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, F.lit(2), F.greatest(F.size(ys) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))

    def cut(strip: Column) -> Column:
        xs = F.array_sort(F.transform(F.filter(sides, lambda s: (s["low"] <= strip["low"]) & (s["high"] >= strip["high"])), lambda s: s["x"]))
        starts, ends = F.filter(xs, lambda _, i: i % 2 == 0), F.filter(xs, lambda _, i: i % 2 == 1)
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), strip["low"].alias("y0"), b.alias("x1"), strip["high"].alias("y1")))

    return F.flatten(F.transform(strips, cut))


def meets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share a point, their edges included."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def shoelace(points: Column, x: str = "x", y: str = "y") -> Column:
    """Area of a ring."""
    after = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, F.lit(1), F.lit(1)))
    terms = F.zip_with(points, after, lambda a, b: (a[x] * b[y] - b[x] * a[y]).cast("double"))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share; 0 where they only touch."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def box_area(a: dict[str, Column]) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union, made in double and narrowed to float; 0 where the union is empty."""
    inter = intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0)).cast("float")


def letterbox(w: Column, h: Column, dw: int, dh: int) -> Column:
    """struct<scale, new_w, new_h, pad_x, pad_y> that fits w x h into dw x dh."""
    scale = F.least(F.lit(float(dw)) / w, F.lit(float(dh)) / h)
    new_w, new_h = F.round(w * scale).cast("int"), F.round(h * scale).cast("int")
    pad_x, pad_y = ((F.lit(dw) - new_w) / 2).cast("int"), ((F.lit(dh) - new_h) / 2).cast("int")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), pad_x.alias("pad_x"), pad_y.alias("pad_y"))


def unletterbox(value: Column, pad: Column, scale: Column, most: Column) -> Column:
    """A model coordinate back in the tile, clamped to it."""
    return F.least(F.greatest((value - pad) / scale, F.lit(0.0)), most.cast("double"))


def center_box(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def rotated_bounds(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """struct<x0, y0, x1, y1> around a rotated box, by its four turned corners."""
    c, s = F.cos(angle), F.sin(angle)
    xs = [cx + i * w / 2 * c - j * h / 2 * s for i in (-1, 1) for j in (-1, 1)]
    ys = [cy + i * w / 2 * s + j * h / 2 * c for i in (-1, 1) for j in (-1, 1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def closed(points: Column) -> Column:
    return F.concat(points, F.slice(points, F.lit(1), F.lit(1)))


def wkt(points: Column, x: str = "lon", y: str = "lat") -> Column:
    """POLYGON text with 8 decimals, closed; empty for fewer than four points."""
    parts = F.transform(closed(points), lambda p: F.format_string("%.8f %.8f", p[x].cast("double"), p[y].cast("double")))
    return F.when(F.size(points) >= 4, F.concat(F.lit("POLYGON(("), F.array_join(parts, ","), F.lit("))"))).otherwise(F.lit(""))


def geojson_polygon(points: Column, x: str = "lon", y: str = "lat") -> Column:
    """GeoJSON geometry text of an open ring."""
    coords = F.transform(closed(points), lambda p: F.array(p[x].cast("double"), p[y].cast("double")))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates")))


def flat_points(coordinates: Column) -> Column:
    """The points (x, y) of GeoJSON coordinates of any nesting, in order, of their text."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    pair = F.lit(rf"\[\s*{number}\s*,\s*{number}")
    x, y = (F.regexp_extract_all(coordinates, pair, F.lit(i)) for i in (1, 2))
    return F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))


def _authalic(lat: Column) -> Column:
    """q(latitude in degrees), to which the area between the equator and a latitude is proportional."""
    e = math.sqrt(_E2)
    s = F.sin(F.radians(lat))
    return (1 - _E2) * (s / (1 - _E2 * s * s) + F.atanh(e * s) / e)


def ellipsoidal_area(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Square metres of a cell between two meridians and two parallels of WGS84."""
    return F.abs(F.radians(lon1) - F.radians(lon0)) * WGS84_A**2 / 2 * F.abs(_authalic(lat1) - _authalic(lat0))


def geographic_area(points: list[tuple[Column, Column]]) -> Column:
    """Square metres of a small polygon of (longitude, latitude), its sides straight in the cylindrical equal-area plane.

    Exact for sides along meridians and parallels.
    """
    xs, ys = [F.radians(lon) for lon, _ in points], [_authalic(lat) for _, lat in points]
    n = len(points)
    # From the first point on, so that the products stay small.
    terms = [(xs[i] - xs[0]) * (ys[(i + 1) % n] - ys[0]) - (xs[(i + 1) % n] - xs[0]) * (ys[i] - ys[0]) for i in range(1, n - 1)]
    return F.abs(sum(terms[1:], terms[0])) * (WGS84_A**2 / 4)
