"""Nearest places over a stored grid: rings of cells around a point are read until none outside can be nearer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.arrays import distance_label, haversine_km
from rostrum.plans.skew import top_k

# degrees of a cell in both directions; the rows of a grid are partitioned by band and slice
CELL = 5
BANDS, SLICES = 180 // CELL, 360 // CELL
# kilometres of a degree of latitude on the sphere of the distance formula, a little less for rounding
DEGREE = 111.19


def write_place_index(places: DataFrame, path: str) -> None:
    """Store places by cell. Rows without coordinates, and latitudes beyond the poles, have no place and are left out."""
    lat, lng = F.col("lat"), F.col("lng")
    band = F.least(F.floor((lat + 90) / CELL), F.lit(BANDS - 1)).cast("int")
    slice_ = (F.floor(F.pmod(lng + 180, F.lit(360.0)) / CELL) % SLICES).cast("int")
    located = places.filter(lat.between(-90, 90) & lng.isNotNull() & ~F.isnan(lng))
    located.withColumns({"band": band, "slice": slice_}).repartitionByRange("band", "slice", "lat", "lng").write.partitionBy("band", "slice").parquet(path)


def ring_bound(lat: float, lng: float, ring: int) -> float:
    """Kilometres that any place outside the square of ``ring`` cells around the point's own is away at least."""
    band, slice_ = min(math.floor((lat + 90) / CELL), BANDS - 1), math.floor((lng + 180) % 360 / CELL) % SLICES
    bounds = []
    if band - ring > 0:
        bounds.append((lat + 90 - (band - ring) * CELL) * DEGREE)
    if band + ring < BANDS - 1:
        bounds.append(((band + ring + 1) * CELL - lat - 90) * DEGREE)
    if 2 * ring + 1 < SLICES:
        x = (lng + 180) % 360
        gap = min(x - (slice_ - ring) * CELL, (slice_ + ring + 1) * CELL - x)
        # the nearest point of a meridian; beyond a right angle it is the pole
        away = math.degrees(math.asin(math.cos(math.radians(lat)) * math.sin(math.radians(gap)))) if gap < 90 else 90 - abs(lat)
        bounds.append(away * DEGREE)
    return min(bounds, default=math.inf)


def cells_around(rows: DataFrame, lat: float, lng: float, ring: int) -> DataFrame:
    """Places in the square of ``ring`` cells around the point's own, over the antimeridian too; a partition filter."""
    band, slice_ = min(math.floor((lat + 90) / CELL), BANDS - 1), math.floor((lng + 180) % 360 / CELL) % SLICES
    near = F.col("band").between(band - ring, band + ring)
    if 2 * ring + 1 < SLICES:
        near = near & F.col("slice").isin([(slice_ + i) % SLICES for i in range(-ring, ring + 1)])
    return rows.filter(near)


def nearest(spark: SparkSession, path: str, lat: float, lng: float, k: int = 6, key: str = "object_id") -> DataFrame:
    """The ``k`` nearest places of a stored grid with ``km`` and a label, ties to the smaller key.

    Rings double until ``k`` places are found and the last of them is nearer than anything outside can be.
    """
    rows, ring = spark.read.parquet(path), 0
    here = (F.lit(float(lat)), F.lit(float(lng)))
    while True:
        around = cells_around(rows, lat, lng, ring).withColumn("km", haversine_km(*here, F.col("lat"), F.col("lng")))
        near = top_k(around, [F.col("km"), F.col(key)], k)
        bound = ring_bound(lat, lng, ring)
        if bound == math.inf:
            break
        found = near.agg(F.count(F.lit(1)).alias("n"), F.max("km").alias("km")).first()
        if found["n"] == k and found["km"] < bound:
            break
        ring = 2 * ring or 1
    return near.drop("band", "slice").withColumn("distance", distance_label(F.col("km")))
