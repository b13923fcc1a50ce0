"""Distance and range joins by grid cells, blocks and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import ranks
from chronopanel.operators.nearest import BLOCK_ROWS, near_places, nearest_distance  # noqa: F401


def buffered_antijoin(left: DataFrame, right: DataFrame, distance: float, x: str = "x", y: str = "y", unlike: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of left with no row of right nearer than distance. With `unlike` only rows of right that differ in that
    column count; nulls are equal there. Rows whose coordinates are missing or not finite stay. Distinct places of left
    search blocks of right by trees (`nearest.near_places`), so no pairs are made, wherever rows are dense."""
    near = near_places(left, right, distance, x, y, unlike, block_rows).select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("u").alias("__u"))
    same = (left[x].cast("double") == near["__x"]) & (left[y].cast("double") == near["__y"])
    if unlike:
        same = same & left[unlike].eqNullSafe(near["__u"])
    return left.join(near, same, "left_anti").select(*left.columns)


def block_id(lon: Column, lat: Column, size: float = 0.05) -> Column:
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def range_lookup(boxes: list[tuple], x: str, y: str, default: str) -> Column:
    """The name of the first box (name, x0, x1, y0, y1) that holds the point: a fixed, short list, as one expression."""
    out = None
    for name, x0, x1, y0, y1 in boxes:
        inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
        out = (F if out is None else out).when(inside, name)
    return out.otherwise(default)


def range_join(df: DataFrame, boxes: DataFrame, key: str, cell: float, x: str = "x", y: str = "y", default: str = "Unknown") -> DataFrame:
    """df with `box`: the name of the first box by `ord` that holds the row's point, edges included, else the
    default. boxes has ord, name, x0, x1, y0, y1 and may be any size: both sides meet by grid cell, a box being
    put into all cells that it touches. key is unique in df."""
    across = F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))
    up = F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))
    spread = boxes.where("x0 <= x1 and y0 <= y1").withColumn("__cx", F.explode(across)).withColumn("__cy", F.explode(up))
    points = df.select(F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    points = points.withColumns({"__cx": F.floor(F.col("__x") / cell), "__cy": F.floor(F.col("__y") / cell)})
    inside = F.col("__x").between(F.col("x0"), F.col("x1")) & F.col("__y").between(F.col("y0"), F.col("y1"))
    first = points.join(spread, ["__cx", "__cy"]).where(inside).groupBy("__k").agg(F.min_by("name", "ord").alias("__box"))
    found = df.drop("box").join(first, df[key] == first["__k"], "left")
    return found.withColumn("box", F.coalesce("__box", F.lit(default))).drop("__k", "__box")


def distance_shares(nearest: DataFrame, limits: tuple[int, ...] = (500, 2000, 10000), nn: str = "nn", by: str | None = None) -> DataFrame:
    """Of each class (or of all, in one row): rows with a neighbour, their least, median, mean and largest distance, and
    for each limit the share of rows nearer than that. Without any row there is one row of nulls, by class none."""
    shares = [F.avg((F.col(nn) < x).cast("double")).alias(f"below_{x}") for x in limits]
    figures = [F.count(nn).alias("n"), F.min(nn).alias("min"), F.avg(nn).alias("mean"), F.max(nn).alias("max"), *shares]
    middle = ranks.quantiles(nearest, [by] if by else [], nn, {"median": 0.5})
    if by is None:
        return nearest.agg(*figures).join(middle, F.lit(True), "left")
    middle = middle.withColumnRenamed(by, "__by")
    found = nearest.groupBy(by).agg(*figures)
    return found.join(middle, found[by].eqNullSafe(middle["__by"]), "left").drop("__by")


def extent(df: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """The box of all places of a table, or of each group: x0, y0, x1, y1 and n, its places. Missing ones take no part."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    a = [f(F.when(known, F.col(c))).alias(n) for n, f, c in (("x0", F.min, x), ("y0", F.min, y), ("x1", F.max, x), ("y1", F.max, y))]
    return df.groupBy(*(by or [])).agg(*a, F.count_if(known).alias("n"))
