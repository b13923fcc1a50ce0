"""Composites of satellite scenes: which scenes count, which of their pixels, and the median of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import indices
from chronopanel.operators import composite, splits


def optical(pixels: DataFrame, scenes: DataFrame, clouds: DataFrame, bands: list[str], keys: list[str], scene_cloud: float = 30, cloud: float = 30, scale: float = 10_000) -> DataFrame:
    """Of each key and band the median (v) and number (n) of clear pixels.

    pixels: keys, scene, pixel, scl, qa and the bands as columns; scenes: scene and cloudy (percentage), of which
    those below scene_cloud count; clouds: scene, pixel and cloud (probability), the least of repeated rows. Pixels
    without a scene or a probability do not count."""
    clear = scenes.where(F.col("cloudy") < scene_cloud).select("scene").distinct()
    known = composite.first_match(pixels.join(clear, "scene", "left_semi"), clouds.select("scene", "pixel", "cloud"), ["scene", "pixel"], "cloud")
    seen = known.where(composite.pixel_mask(F.col("scl"), F.col("cloud"), F.col("qa"), cloud))
    return composite.composite(_long(seen, bands, keys, scale), [*keys, "band"])


def radar(pixels: DataFrame, scenes: DataFrame, keys: list[str], orbit: str = "DESCENDING", mode: str = "IW", bands: tuple[str, ...] = ("VV", "VH")) -> DataFrame:
    """Of each key and band the median (v, linear) and number (n) of pixels, which are in decibels.

    pixels: keys, scene and the bands; scenes: scene, mode, orbit and polarisations (an array), of which those of this
    mode and orbit with all bands count."""
    whole = F.array_contains("polarisations", bands[0])
    for b in bands[1:]:
        whole = whole & F.array_contains("polarisations", b)
    fit = scenes.where((F.col("mode") == mode) & (F.col("orbit") == orbit) & whole).select("scene").distinct()
    linear = pixels.join(fit, "scene", "left_semi").withColumns({b: indices.to_linear(F.col(b)) for b in bands})
    return composite.composite(_long(linear, list(bands), keys, 1.0), [*keys, "band"])


def _long(df: DataFrame, bands: list[str], keys: list[str], scale: float) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), (F.col(b) / scale).alias("value")) for b in bands])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.band", "p.value")


def sample(pixels: DataFrame, by: list[str], key: str, bands: list[str], n: int = 500, seed: int = 42, missing: float = -999.0, distinct: bool = False) -> DataFrame:
    """At most n pixels of each plot, in the order of a seeded hash of the key, and a mark for missing values. With
    `distinct` equal rows are one pixel. The limit is part of the feature; a task has a bounded number of rows."""
    return splits.first_rows(pixels, by, [splits.drawn(key, seed), key], n, distinct).fillna(missing, bands)
