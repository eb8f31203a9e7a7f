"""Grid geometry: region building, cell-to-region range join, neighbourhoods, box sums, conservative box mean.

Range and neighbourhood conditions are turned into equi-joins on integer buckets or positions, so no nested-loop
join is ever planned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.functions import scalar as S


def _axis(cells: DataFrame, coord: str, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """(positions of the coordinate inside [lo, hi], one-row median spacing of the whole axis).

    An axis has as many rows as the grid has distinct latitudes or longitudes (hundreds), so the ordered
    windows here are over a table of fixed size."""
    values = cells.select(F.col(coord).cast("double").alias(coord)).where(F.col(coord).isNotNull()).distinct()
    w = W.partitionBy(F.lit(0)).orderBy(coord)
    spacing = (values.select((F.lead(coord).over(w) - F.col(coord)).alias("d"))
               .agg(F.percentile("d", 0.5).alias("spacing")))
    inside = values.where(F.col(coord).between(lo, hi)).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    return inside, spacing


def build_regions(cells: DataFrame, domain: Mapping[str, float]) -> DataFrame:
    """One region per grid box whose centre lies inside the domain: row/col ranks, id, bounds, area tag."""
    lats, dlat = _axis(cells, "lat", domain["lat_min"], domain["lat_max"])
    lons, dlon = _axis(cells, "lon", domain["lon_min"], domain["lon_max"])
    pairs = (cells.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
             .join(lats.withColumnRenamed("pos", "row_n"), "lat").join(lons.withColumnRenamed("pos", "col_n"), "lon")
             .withColumn("_dlat", dlat.scalar()).withColumn("_dlon", dlon.scalar()))
    return pairs.select(
        F.format_string("R%02d%02d", "row_n", "col_n").alias("region_id"), "row_n", "col_n",
        F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
        F.round(F.col("lat") - F.col("_dlat") / 2, 4).alias("lat_lo"), F.round(F.col("lat") + F.col("_dlat") / 2, 4).alias("lat_hi"),
        F.round(F.col("lon") - F.col("_dlon") / 2, 4).alias("lon_lo"), F.round(F.col("lon") + F.col("_dlon") / 2, 4).alias("lon_hi"),
        S.area_tag("lat", "lon").alias("name"))


def region_cells(regions: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon", width: float = 5.0) -> DataFrame:
    """Bridge (region, cell) with lat in [lat_lo, lat_hi) and lon in [lon_lo, lon_hi).

    Regions announce the integer buckets (of ``width`` degrees) they touch; cells carry their own bucket; the
    range predicate only refines the equi-join."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("int")                         # noqa: E731
    r = (regions.select("region_id", "lat_lo", "lat_hi", "lon_lo", "lon_hi")
         .withColumn("_bl", F.explode(F.sequence(bucket(F.col("lat_lo")), bucket(F.col("lat_hi")))))
         .withColumn("_bo", F.explode(F.sequence(bucket(F.col("lon_lo")), bucket(F.col("lon_hi"))))))
    points = cells.select(lat, lon).distinct().withColumn("_bl", bucket(F.col(lat))).withColumn("_bo", bucket(F.col(lon)))
    inside = ((F.col(lat) >= F.col("lat_lo")) & (F.col(lat) < F.col("lat_hi"))
              & (F.col(lon) >= F.col("lon_lo")) & (F.col(lon) < F.col("lon_hi")))
    return points.join(r, ["_bl", "_bo"]).where(inside).select("region_id", lat, lon)


def neighbours(positions: DataFrame, half: int, key: str | None = None) -> DataFrame:
    """Pairs of positions with |row - row'| <= half and |col - col'| <= half (self included), clipped at the edge.

    Every position announces its (2 half + 1)^2 neighbour slots and meets the existing positions by equality."""
    extra = [key] if key else []
    span = F.sequence(F.lit(-half), F.lit(half))
    slots = (positions.select(*extra, "row_n", "col_n").withColumn("_dr", F.explode(span)).withColumn("_dc", F.explode(span))
             .select(*extra, "row_n", "col_n", (F.col("row_n") + F.col("_dr")).alias("nb_row"),
                     (F.col("col_n") + F.col("_dc")).alias("nb_col")))
    other = positions.select(F.col("row_n").alias("nb_row"), F.col("col_n").alias("nb_col"),
                             *([F.col(key).alias(f"nb_{key}")] if key else []))
    return slots.join(other, ["nb_row", "nb_col"])


def box_sums(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column], half: int, n_row: int, n_col: int) -> DataFrame:
    """Sums of ``measures`` over the (2 half + 1)^2 box around every grid position, clipped at the edge.

    Separable: first along columns, then along rows, so a cell is replicated 2 x (2 half + 1) times instead of
    (2 half + 1)^2; both steps combine on the map side.  Absent cells simply add nothing."""
    span = F.sequence(F.lit(-half), F.lit(half))
    names = list(measures)
    sums = [F.sum(n).alias(n) for n in names]
    cols = (df.select(*by, "row_n", "col_n", *[c.alias(n) for n, c in measures.items()])
            .withColumn("_d", F.explode(span)).withColumn("col_n", F.col("col_n") + F.col("_d"))
            .where(F.col("col_n").between(0, n_col - 1)).groupBy(*by, "row_n", "col_n").agg(*sums))
    return (cols.withColumn("_d", F.explode(span)).withColumn("row_n", F.col("row_n") + F.col("_d"))
            .where(F.col("row_n").between(0, n_row - 1)).groupBy(*by, "row_n", "col_n").agg(*sums))


def conservative_box_mean(df: DataFrame, by: Sequence[str], value: str, lat: str, lon: str, lat0: float, dlat: float,
                          lon0: float, dlon: float, n_row: int, n_col: int) -> DataFrame:
    """Fine points -> coarse boxes [centre - d/2, centre + d/2): cos(lat)-weighted mean, missing values excluded.

    The box index is arithmetic, so the range condition becomes a grouping key."""
    w = F.cos(F.radians(F.col(lat)))
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value))
    boxed = (df.withColumn("row_n", F.floor((F.col(lat) - F.lit(lat0) + dlat / 2) / dlat).cast("int"))
             .withColumn("col_n", F.floor((F.col(lon) - F.lit(lon0) + dlon / 2) / dlon).cast("int"))
             .where(F.col("row_n").between(0, n_row - 1) & F.col("col_n").between(0, n_col - 1)))
    return boxed.groupBy(*by, "row_n", "col_n").agg(
        (F.sum(F.when(ok, w * F.col(value))) / F.sum(F.when(ok, w))).alias("box_mean"),
        F.count(F.when(ok, 1)).alias("n_points"))


def coordinate_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates present in only one of two gridded sets (empty = coincident grids)."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left_only").otherwise("right_only")
    return (left.join(right, list(keys), "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
            .select(*keys, side.alias("side")))
