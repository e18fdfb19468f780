"""Radius and nearest-neighbour joins of many points with many places, by cells of a grid.

The sphere is cut into bands of latitude, and each band into as many cells as keep them
about as wide as they are high, so cells don't shrink towards the poles, and the last cell
of a band lies beside the first. A point asks the cells that a circle around it touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepool.functions import geo
from tidepool.operators import products

#: Grids of ``nearest``: cells of 180 degrees, halved up to some 20 metres.
LEVELS = 20
#: Miles that no rounding of a distance reaches.
SLACK = 1e-5


def smallest(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "nth") -> DataFrame:
    """The first ``k`` rows of each key in an order, with their place ``rank`` from 1 on.

    Every task keeps k rows of a key at most, before and after the shuffle (below the
    session's spark.sql.optimizer.windowGroupLimitThreshold), so a hot key costs no more than others.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def _girth(band: Column, size: Column) -> Column:
    """Degrees of a great circle around a band where it is widest."""
    low, high = band * size - 90, (band + 1) * size - 90
    flattest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return 360 * F.cos(F.radians(F.least(flattest, F.lit(90.0))))


def _around(band: Column, size: Column) -> Column:
    """Cells of a band: as many as are at least ``size`` degrees wide where the band is widest."""
    return F.greatest(F.lit(1).cast("long"), F.floor(_girth(band, size) / size))


def _band(lat: Column, size: Column) -> Column:
    last = F.greatest(F.ceil(180 / size) - 1, F.lit(0).cast("long"))
    return F.least(F.greatest(F.floor((lat + 90) / size), F.lit(0).cast("long")), last)


def placed(df: DataFrame, lat: str, lng: str, size: Column) -> DataFrame:
    """Rows with their ``_band`` and ``_cell`` in the grid of ``size`` degrees."""
    banded = df.withColumn("_band", _band(F.col(lat), size)).withColumn("_n", _around(F.col("_band"), size))
    return banded.withColumn("_cell", F.pmod(F.floor((F.col(lng) + 180) * F.col("_n") / 360), F.col("_n"))).drop("_n")


def reached(df: DataFrame, lat: str, lng: str, miles: Column, size: Column) -> DataFrame:
    """Rows with each ``_band`` and ``_cell`` that a circle of ``miles`` around them touches."""
    angle = F.least(F.degrees((miles + SLACK) / geo.RADIUS), F.lit(180.0))
    y, x = F.col(lat), F.col(lng)
    bands = df.withColumn("_angle", angle).withColumn("_band", F.explode(F.sequence(_band(y - F.col("_angle"), size), _band(y + F.col("_angle"), size))))
    # how far to the side the circle reaches, everywhere if it holds a pole
    polar = F.abs(y) + F.col("_angle") >= 90
    side = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_angle")) / F.cos(F.radians(y))))) + 1e-9)
    wide = bands.withColumn("_n", _around(F.col("_band"), size)).withColumn("_side", side)
    first, last = (F.floor((x + sign * F.col("_side") + 180) * F.col("_n") / 360) for sign in (-1, 1))
    last = F.least(last, first + F.col("_n") - 1)
    return wide.withColumn("_cell", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_n"))))).drop("_angle", "_n", "_side")


def _valid(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return df.where(geo.valid_point(F.col(lat), F.col(lng)))


def within(points: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """``points`` (lat, lng and others) with each of ``places`` (venue_id, lat, lng) at most so far from them, and ``distance``; invalid points have none."""
    if miles < 0:
        return points.join(places.select("venue_id").limit(0), F.lit(False)).withColumn("distance", F.lit(0.0))
    size = F.lit(min(90.0, max(math.degrees(miles / geo.RADIUS), 1e-4)))
    # equal coordinates are compared once, however many points and places have them
    spots = placed(_valid(places, "lat", "lng").select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).distinct(), "_lat", "_lng", size)
    asked = _valid(points, "lat", "lng")
    met = reached(asked.select("lat", "lng").distinct(), "lat", "lng", F.lit(miles), size).join(spots, ["_band", "_cell"])
    near = met.withColumn("distance", geo.haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).where(F.col("distance") <= miles)
    held = near.join(places.select("venue_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), ["_lat", "_lng"]).select(F.struct("lat", "lng").alias("_spot"), "venue_id", "distance")
    return products.paired(asked.withColumn("_spot", F.struct("lat", "lng")), held, "_spot")


def nearest(points: DataFrame, places: DataFrame, key: str, k: int) -> DataFrame:
    """(key, venue_id, distance, nth): the ``k`` nearest of ``places`` to each valid point, by distance in millionths of a mile, then venue_id; fewer where there are fewer.

    The smallest of LEVELS grids is taken in which a point's own cell holds k places: they
    are no further away than two ends of the cell, so the circle of that radius holds the k
    nearest. Where places are dense circles are small, and a point meets few more than k.
    Of places with equal coordinates the k smallest ids are enough, and points with equal
    coordinates are asked for once. Joins go by shuffles, as neither side need fit the driver.
    """
    rest = smallest(_valid(places, "lat", "lng"), ["lat", "lng"], [F.col("venue_id")], k, "_nth")
    held = rest.select("venue_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    keyed = _valid(points, "lat", "lng").select(F.struct("lat", "lng").alias("_spot"), key)
    found = _nearest(points.select(F.struct("lat", "lng").alias("_spot"), "lat", "lng").distinct(), held, "_spot", k)
    return keyed.join(found.hint("merge"), "_spot").select(key, "venue_id", "distance", "nth")


def _nearest(points: DataFrame, held: DataFrame, key: str, k: int) -> DataFrame:
    level = F.col("_level")
    size = F.lit(180.0) / F.pow(F.lit(2.0), level)
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    index = placed(held.select("*", levels), "_lat", "_lng", size)
    full = index.groupBy("_level", "_band", "_cell").agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") >= k).drop("_held")
    asked = _valid(points, "lat", "lng").select(key, "lat", "lng")
    own = placed(asked.select("*", levels), "lat", "lng", size).join(full.hint("merge"), ["_level", "_band", "_cell"])
    deepest = own.groupBy(key).agg(F.max("_level").alias("_level"))
    # two points of a cell: along its side, then across it where it is widest
    band = _band(F.col("lat"), size)
    across = size + _girth(band, size) / _around(band, size)
    radius = F.when(F.col("_found"), F.radians(F.least(across, F.lit(180.0))) * geo.RADIUS).otherwise(math.pi * geo.RADIUS)
    chosen = asked.join(deepest.withColumn("_found", F.lit(True)).hint("merge"), key, "left").withColumns({"_level": F.coalesce("_level", F.lit(0)), "_found": F.coalesce("_found", F.lit(False))})
    circles = reached(chosen.withColumn("_miles", radius), "lat", "lng", F.col("_miles"), size)
    used = index.join(F.broadcast(deepest.select("_level").unionByName(deepest.sparkSession.sql("SELECT 0 AS _level")).distinct()), "_level", "left_semi")  # LEVELS rows at most
    met = circles.join(used.hint("merge"), ["_level", "_band", "_cell"]).select(key, "venue_id", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")), 6).alias("distance"))
    return smallest(met, [key], [F.col("distance"), F.col("venue_id")], k)
