"""Date, label, tier and geometry functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they occur in file names ("sept" added).
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()


def month_number(name: Column) -> Column:
    names = {n: i + 1 for i, n in enumerate(MONTHS)} | {n: i + 1 for i, n in enumerate(LONG_MONTHS)} | {"sept": 9}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name)


def filename_date(name: Column) -> Column:
    """The first date pattern of a lower-cased file stem that gives a valid date in 2000 to 2100; else null."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    part = lambda pattern, g: F.regexp_extract(stem, pattern, g)
    num = lambda pattern, g: F.try_to_number(F.nullif(part(pattern, g), F.lit("")), F.lit("99999999")).cast("int")

    def date(y: Column, m: Column, d: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", y, m, d)
        return F.when(y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))

    dmy, my, iso, numeric, compact = r"(\d{1,2})([a-z]{3,9})(\d{4})", r"([a-z]{3,9})(\d{4})", r"(\d{4})[-_](\d{2})[-_](\d{2})", r"(\d{2})[/\-](\d{2})[/\-](\d{4})", r"(\d{8})"
    packed = part(compact, 1)
    piece = lambda a, n: F.try_to_number(F.nullif(F.substring(packed, a, n), F.lit("")), F.lit("9999")).cast("int")
    return F.coalesce(
        date(num(dmy, 3), month_number(F.nullif(part(dmy, 2), F.lit(""))), num(dmy, 1)),
        date(num(my, 2), month_number(F.nullif(part(my, 1), F.lit(""))), F.when(part(my, 1) != "", F.lit(1))),
        date(num(iso, 1), num(iso, 2), num(iso, 3)),
        date(num(numeric, 3), num(numeric, 2), num(numeric, 1)),
        date(piece(1, 4), piece(5, 2), piece(7, 2)),
    )


def anchor_window(anchor: Column, before: int = 5, after: int = 5) -> tuple[Column, Column]:
    """Start and end, calendar months before and after the anchor, clamped to the month's end."""
    return F.add_months(anchor, -before), F.add_months(anchor, after)


def synthetic_month(step: Column, steps: int, anchor: int = 9) -> Column:
    """The month a half-month step falls in when the middle step is the anchor month; halves round to even."""
    m = F.pmod(F.bround(F.lit(float(anchor)) + (step - steps // 2) * 0.5, 0).cast("int"), F.lit(12))
    return F.when(m == 0, 12).otherwise(m)


def verdict(proba: Column, share: Column) -> Column:
    return F.when(proba >= 0.685, "HIGH").when(proba >= 0.458, "MODERATE").when(share >= 20, "LOW").otherwise("NON-HIGH")


def data_quality(pct: Column) -> Column:
    return F.when(pct.isNull(), "UNKNOWN").when(pct >= 80, "EXCELLENT").when(pct >= 60, "GOOD").when(pct >= 40, "FAIR").otherwise("POOR")


#: Words in file names and the class they stand for, first match first.
CLASS_WORDS = (
    ("rice", "rice"), ("maize", "maize"), ("corn", "maize"), ("wheat", "wheat"), ("mustard", "mustard"), ("potato", "potato"),
    ("mango", "mango/orchard"), ("poplar", "poplar/forestry"), ("banana", "banana"), ("guava", "guava/orchard"),
    ("fallow", "fallow"), ("barren", "fallow"), ("urban", "urban"), ("city", "urban"), ("built", "urban"),
    ("water", "water"), ("river", "water"), ("pond", "water"), ("lake", "water"), ("sponge", "spongegourd/vegetable"),
    ("untitled map", "unlabeled (Untitled map)"),
)


def class_of_filename(name: Column) -> Column:
    out, low = None, F.lower(name)
    for word, kind in CLASS_WORDS:
        out = (F if out is None else out).when(F.contains(low, F.lit(word)), kind)
    return out.otherwise("unlabeled (numeric)")


def utm_zone(lon: Column) -> Column:
    return F.when(lon < 78, 32643).when(lon < 84, 32644).otherwise(32645)


def utm(lon: Column, lat: Column, zone: int = 44) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS 84, by the Krueger series to the third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def _crosses(ring: Column) -> Column:
    """Of each side: its cross product and the sums of its ends, from the first point (else small rings far
    from the origin lose their digits)."""
    first = F.element_at(ring, 1)
    near = lambda p: (p["x"] - first["x"], p["y"] - first["y"])

    def side(p: Column, i: Column) -> Column:
        (ax, ay), (bx, by) = near(p), near(F.get(ring, i + 1))
        return F.struct((ax * by - bx * ay).alias("c"), (ax + bx).alias("sx"), (ay + by).alias("sy"))

    return F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), side)


def ring_area(ring: Column) -> Column:
    """Planar area of a closed ring of (x, y), by the shoelace formula."""
    return F.abs(F.aggregate(_crosses(ring), F.lit(0.0), lambda s, p: s + p["c"])) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    c, first = _crosses(ring), F.element_at(ring, 1)
    area = F.aggregate(c, F.lit(0.0), lambda s, p: s + p["c"]) / 2
    return tuple(first[axis] + F.try_divide(F.aggregate(c, F.lit(0.0), _moment(f"s{axis}")), 6 * area) for axis in "xy")


def _moment(key: str):
    return lambda s, p: s + p[key] * p["c"]


def ring_bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Least x, least y, largest x and largest y of a ring of (x, y)."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def tag_in_months(tag: Column, months: tuple[int, ...]) -> Column:
    """Whether an absolute tag (YYYY_MM_DD) lies in one of the calendar months; false for all other tags."""
    return F.coalesce(F.month(tag_date(tag)).isin(*months), F.lit(False))


def tag_in_steps(tag: Column, first: int, last: int) -> Column:
    """Whether a relative tag (tNN) has one of the steps, ends included; false for all other tags."""
    return F.coalesce(tag_step(tag).between(first, last), F.lit(False))


def tag_phase(step: Column, steps: int) -> Column:
    """early, peak or late: the third of the steps that a step is in; null outside of them."""
    third = F.floor(step * 3 / steps)
    return F.when(third == 0, "early").when(third == 1, "peak").when(third == 2, "late")


def is_closed(ring: Column, tolerance: float = 1e-4) -> Column:
    """At least four points, the first and last within the tolerance on each axis."""
    a, b = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return (F.size(ring) >= 4) & (F.abs(a["x"] - b["x"]) <= tolerance) & (F.abs(a["y"] - b["y"]) <= tolerance)


def area_ha(ring: Column, zone: int = 43) -> Column:
    """Hectares of a closed ring of (longitude, latitude), to four digits: on the plane of the zone, else (where a
    point has no place there) from square degrees of 111,320 metres."""
    flat = F.transform(ring, lambda p: F.struct(*[v.alias(n) for v, n in zip(utm(p["x"], p["y"], zone), "xy", strict=True)]))
    metres = ring_area(flat)
    rough = ring_area(ring) * 111_320**2
    return F.round(F.when(metres.isNull() | F.isnan(metres) | (metres == float("inf")), rough).otherwise(metres) / 10_000, 4)


def ring_crosses_itself(ring: Column) -> Column:
    """Whether two sides of a closed ring of (x, y) cross at a point within both. Each side meets each other one, so
    the work grows with the square of a ring's own points."""
    side = lambda i: (F.get(ring, i), F.get(ring, i + 1))

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(i: Column, j: Column) -> Column:
        (a, b), (c, d) = side(i), side(j)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    places = F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0)))
    return F.exists(places, lambda i: F.exists(places, lambda j: (i < j) & F.coalesce(cross(i, j), F.lit(False))))


def tag_year_month(name: Column) -> tuple[Column, Column]:
    """Year and month of the older tags (2024_03); 2025 and 1 for any other."""
    found = lambda g: F.nullif(F.regexp_extract(name, r"^([0-9]{4})_(0[1-9]|1[0-2])$", g), F.lit("")).cast("int")
    return F.coalesce(found(1), F.lit(2025)), F.coalesce(found(2), F.lit(1))


def parse_ring(text: Column) -> Column:
    """Array of (x, y) from white-space separated lon,lat[,alt]; points that don't parse are left out."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.split(p, ","))
    point = lambda q: F.struct(F.get(q, 0).try_cast("double").alias("x"), F.get(q, 1).try_cast("double").alias("y"))
    return F.filter(F.transform(parts, point), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def synthetic_year(step: Column, steps: int, anchor: int = 9, first: int = 2025) -> Column:
    """The year of synthetic_month(): steps from the middle on whose month is before the anchor are in the next."""
    early = (step < steps // 2) | (synthetic_month(step, steps, anchor) >= anchor)
    return F.when(early, first).otherwise(first + 1)


def tag_date(name: Column) -> Column:
    """The date that a column name ends with (_2024_03_15), or null."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"_([0-9]{4}_[0-9]{2}_[0-9]{2})$", 1), F.lit("")), "yyyy_MM_dd")


def tag_step(name: Column) -> Column:
    """The step that a column name ends with (_t07), or null."""
    return F.nullif(F.regexp_extract(name, r"_t([0-9]+)$", 1), F.lit("")).cast("int")


def tag_band(name: Column) -> Column:
    """The name without its date or step; null for a name without either."""
    bare = F.regexp_replace(name, r"_(?:[0-9]{4}_[0-9]{2}_[0-9]{2}|t[0-9]+)$", "")
    return F.when(bare != name, bare)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float] = (77.1, 84.6, 23.9, 30.4)) -> Column:
    """Whether the point lies within (west, east, south, north), edges included."""
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def approx_pixels(area_ha: Column, per_ha: int = 100) -> Column:
    return F.bround(area_ha * per_ha, 0).cast("bigint")
