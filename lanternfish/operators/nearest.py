"""Exact nearest places, blocked by a quadtree so that neither pairs nor places explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_MILES, distance_label, haversine_miles
from ..session import cut_lineage
from .grouping import top_per_group

# Cells of level j are 360 / 2**j degrees wide and high. Places in one cell of the finest level are less than a twentieth of
# a mile apart: they are all at rounded distance 0.
MAX_LEVEL = 20

# Distances are ranked in tenths of a mile: a place at less than a listed distance plus this much can rank with it.
HALF_TENTH = 0.05

# Degrees added to every arc, far more than rounding errors.
SLACK = 1e-6

# Cells of a probe, at most, are this part of its reach in longitude.
WIDEST_REACH = 8


def _cell_size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cells_around(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def _in_cells(points: DataFrame) -> DataFrame:
    """Points with a level, and their cell of that level."""
    size = _cell_size(F.col("level"))
    cx = F.pmod(F.floor((F.col("lon") + 180) / size), _cells_around(F.col("level")))
    return points.withColumn("cx", cx).withColumn("cy", F.floor((F.col("lat") + 90) / size))


def _at_levels(points: DataFrame) -> DataFrame:
    """One row per point and level with its cell."""
    return _in_cells(points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL)))))


def _bounds(candidates: DataFrame, k: int) -> DataFrame:
    """(lat, lon, bound): a rounded distance within which k + 1 candidates are, from those in the smallest cell around the
    point that holds so many; null where the whole table has fewer."""
    points = candidates.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    leveled = _at_levels(points)
    filled = leveled.groupBy("level", "cx", "cy").agg(F.sum("n").alias("cell_n")).where(F.col("cell_n") >= k + 1)
    finest = leveled.join(filled, ["level", "cx", "cy"]).groupBy("lat", "lon").agg(F.max("level").alias("level"))
    finest = cut_lineage(points.select("lat", "lon").join(finest, ["lat", "lon"], "left"))
    # a point has at most k others in its quarter of the cell, so a cell meets few points, however full another quarter is
    probes = _in_cells(finest.where(F.col("level") < MAX_LEVEL)).withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    used = F.broadcast(probes.select("level").distinct())
    inside = probes.join(_at_levels(candidates.select("lat", "lon")).join(used, "level"), ["level", "cx", "cy"])
    miles = haversine_miles(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    ranked = top_per_group(inside.select("p_lat", "p_lon", F.round(miles, 1).alias("bound")), ["p_lat", "p_lon"], [F.col("bound").asc()], k + 1)
    measured = ranked.where(F.col("rank") == k + 1).select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "bound")
    dense = finest.where(F.col("level") == MAX_LEVEL).select("lat", "lon", F.lit(0.0).alias("bound"))
    alone = finest.where("level is null").select("lat", "lon", F.lit(None).cast("double").alias("bound"))
    return measured.unionByName(dense).unionByName(alone)


def _probes(bounds: DataFrame) -> DataFrame:
    """(p_lat, p_lon, bound, level, cx, cy): the cells that the arc of the bound touches, of a level about as wide as the arc."""
    lat, lon, size, around = F.col("lat"), F.col("lon"), _cell_size(F.col("level")), _cells_around(F.col("level"))
    arc = F.least(F.degrees((F.col("bound") + HALF_TENTH) / EARTH_RADIUS_MILES) + SLACK, F.lit(180.0))
    arcs = bounds.withColumn("arc", F.coalesce(arc, F.lit(180.0)))
    # nearer to a pole than the arc, all longitudes are in reach
    wide = F.degrees(F.asin(F.least(F.sin(F.radians("arc")) / F.cos(F.radians(lat)), F.lit(1.0)))) + SLACK
    wides = arcs.withColumn("wide", F.when(F.abs(lat) + F.col("arc") < 90, wide).otherwise(F.lit(180.0)))
    level = F.floor(F.log2(360 / F.greatest(F.col("arc"), F.col("wide") / WIDEST_REACH))).cast("int") + 1
    leveled = wides.withColumn("level", F.least(F.greatest(level, F.lit(0)), F.lit(MAX_LEVEL)))
    first, last = (F.floor((lon + sign * F.col("wide") + 180) / size) for sign in (-1, 1))
    # longitudes wrap around
    xs = F.transform(F.sequence(first, F.least(last, first + around - 1)), lambda x: F.pmod(x, around))
    ys = F.sequence(F.floor((lat - F.col("arc") + 90) / size), F.floor((lat + F.col("arc") + 90) / size))
    rows = leveled.select(lat.alias("p_lat"), lon.alias("p_lon"), "bound", "level", xs.alias("xs"), F.explode(ys).alias("cy"))
    return rows.select("p_lat", "p_lon", "bound", "level", F.explode("xs").alias("cx"), "cy")


def nearest_k(places: DataFrame, k: int) -> DataFrame:
    """For every place the k nearest others by (distance in tenths of a mile, -reports, name).

    ``places``: name, reports, lat, lon. Places on the same spot are interchangeable except for
    their order, so only the first k + 1 of each coordinate can ever be listed, and lists are
    worked out once per coordinate. The smallest cell around a coordinate that holds k + 1
    candidates gives a distance within which so many are; everything that can rank with those
    lies within a known arc, and only the cells that touch the arc are joined.
    """
    order = [F.col("reports").desc(), F.col("name").asc()]
    located = places.select("name", "reports", "lat", "lon").where("lat is not null and lon is not null")
    candidates = cut_lineage(top_per_group(located, ["lat", "lon"], order, k + 1).drop("rank"))
    bounds = cut_lineage(_bounds(candidates, k))
    probes = _probes(bounds)
    used = F.broadcast(probes.select("level").distinct())
    targets = _at_levels(candidates).join(used, "level")
    miles = haversine_miles(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    near = (
        probes.join(targets, ["level", "cx", "cy"])
        .select("p_lat", "p_lon", "bound", "name", "reports", miles.alias("exact"))
        .withColumn("miles", F.round("exact", 1))
        .where("bound is null or miles <= bound")
    )
    ranking = [F.col("miles").asc(), F.col("reports").desc(), F.col("name").asc()]
    per_point = top_per_group(near, ["p_lat", "p_lon"], ranking, k + 1, "_r").drop("_r")
    listed = per_point.select(
        F.col("p_lat").alias("lat"),
        F.col("p_lon").alias("lon"),
        F.col("name").alias("neighbor"),
        F.col("reports").alias("neighbor_reports"),
        "miles",
        distance_label(F.col("exact")).alias("distance_label"),
    )
    pairs = places.select("name", "lat", "lon").join(listed, ["lat", "lon"]).where("name <> neighbor")
    return top_per_group(
        pairs.drop("lat", "lon"),
        ["name"],
        [F.col("miles").asc(), F.col("neighbor_reports").desc(), F.col("neighbor").asc()],
        k,
    )


def nearest_from_point(clusters: DataFrame, lat: float, lon: float, k: int = 5) -> DataFrame:
    """The k clusters nearest to one point; a plain top-k, kept partial on every task."""
    miles = haversine_miles(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return clusters.withColumn("miles", miles).orderBy(F.col("miles").asc(), F.col("label").asc()).limit(k)
