"""Band-ratio indices as Column functions. Null bands give null; a zero denominator gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS, SMALL = 1e-8, 1e-10


def _ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.try_divide(a - b, a + b + eps)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1 + EPS)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return F.try_divide(nir - red, nir + red + soil + EPS) * (1 + soil)


def msavi(nir: Column, red: Column) -> Column:
    root = F.pow(2 * nir + 1, F.lit(2)) - 8 * (nir - red)
    return (2 * nir + 1 - F.sqrt(F.when(root < 0, 0.0).otherwise(root))) / 2


def ireci(b7: Column, b6: Column, b5: Column, b4: Column) -> Column:
    return F.try_divide(b7 - b4, F.try_divide(b5, b6 + SMALL) + SMALL)


#: Name to (bands it needs, function of them).
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "NDVI": (("B8", "B4"), _ratio),
    "EVI": (("B8", "B4", "B2"), evi),
    "NDWI": (("B3", "B8"), _ratio),
    "LSWI": (("B8", "B11"), _ratio),
    "SAVI": (("B8", "B4"), savi),
    "MSAVI": (("B8", "B4"), msavi),
    "NBR": (("B8", "B12"), _ratio),
    "NDRE": (("B8A", "B5"), _ratio),
    "NDMI": (("B8A", "B11"), _ratio),
    "GNDVI": (("B8", "B3"), _ratio),
    "CIre": (("B7", "B5"), lambda b7, b5: F.try_divide(b7, b5 + SMALL) - 1),
    "IRECI": (("B7", "B6", "B5", "B4"), ireci),
    "CCCI": (("B8A", "B5", "B8", "B4"), lambda n2, re, n, r: F.try_divide(_ratio(n2, re), _ratio(n, r) + SMALL)),
    "GRVI": (("B3", "B4"), lambda g, r: _ratio(g, r, SMALL)),
    "PSRI": (("B4", "B2", "B7"), lambda r, b, b7: F.try_divide(r - b, b7 + SMALL)),
    "NRPB": (("VH", "VV"), lambda vh, vv: _ratio(vh, vv, SMALL)),
    "RVI": (("VV", "VH"), lambda vv, vh: F.try_divide(4 * vh, vv + vh + EPS)),
    "RFDI": (("VV", "VH"), _ratio),
    "CR": (("VV", "VH"), lambda vv, vh: F.try_divide(vh, vv + EPS)),
}


def index(name: str, **bands: str | Column) -> Column:
    """The index over the named columns; bands maps its band names to other columns."""
    needed, function = REGISTRY[name]
    return function(*[F.col(b) if isinstance(b := bands.get(x, x), str) else b for x in needed])


def available(columns: list[str]) -> list[str]:
    """Indices whose bands are all among the columns, so that a missing band leaves out its indices."""
    return [name for name, (needed, _) in REGISTRY.items() if set(needed) <= set(columns)]


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def clipped_ratio(a: Column, b: Column, limit: float = 50.0) -> Column:
    """a / b within -limit to limit; null where either is null."""
    x = F.try_divide(a, b + EPS)
    return F.when(x > limit, limit).when(x < -limit, -limit).otherwise(x)


def plain_ratio(a: Column, b: Column) -> Column:
    """The normalised difference without a term that keeps the divisor from zero: null where that is zero."""
    return F.try_divide(a - b, a + b)


def add_all(df: DataFrame) -> DataFrame:
    """df with every index whose bands it has, in one projection; a column that is there already stays as it is."""
    return df.select("*", *[index(name).alias(name) for name in available(df.columns) if name not in df.columns])


def plain_all(df: DataFrame) -> DataFrame:
    """df with the older five: normalised differences and EVI without added terms, RVI of radar in decibels."""
    nir, red, green, blue, swir = (F.col(b) for b in ("B8", "B4", "B3", "B2", "B11"))
    vv, vh = to_linear(F.col("VV")), to_linear(F.col("VH"))
    return df.withColumns({
        "NDVI": plain_ratio(nir, red),
        "EVI": 2.5 * F.try_divide(nir - red, nir + 6 * red - 7.5 * blue + 1),
        "NDWI": plain_ratio(green, nir),
        "LSWI": plain_ratio(nir, swir),
        "RVI": F.try_divide(4 * vh, vv + vh),
    })
