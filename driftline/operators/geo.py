"""Spatial joins on a grid, clusters, distances and shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import KM_PER_LAT, haversine_km, tile_of, within_km
from .graph import connected_components


def _cells(points: DataFrame, lat: str, lon: str, degrees: float, spread: bool, max_km: float) -> DataFrame:
    """Grid keys (gy, gx); with ``spread`` all cells that ``max_km`` around the point can reach, over the antimeridian too."""
    wide = round(360 / degrees)
    gy = F.floor((F.col(lat) + 90) / degrees)
    if not spread:
        return points.withColumns({"gy": gy, "gx": F.pmod(F.floor((F.col(lon) + 180) / degrees), F.lit(wide))})
    rows = points.withColumn("gy", F.explode(F.sequence(gy - 1, gy + 1)))
    far = F.least(F.abs(F.col(lat)) + max_km / KM_PER_LAT, F.lit(89.9))
    half = F.least(F.lit(180.0), max_km / (KM_PER_LAT * F.cos(F.radians(far))) * 1.05)
    first, last = F.floor((F.col(lon) - half + 180) / degrees), F.floor((F.col(lon) + half + 180) / degrees)
    last = F.least(last, first + wide - 1)
    return rows.withColumn("gx", F.explode(F.sequence(first, last))).withColumn("gx", F.pmod("gx", F.lit(wide)))


def near_pairs(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``left`` (llat, llon) and ``right`` (rlat, rlon) within ``km``, and of equal ``on``; an equi-join on grid cells.

    Null coordinates match nothing.
    """
    # Whole numbers of cells fit the circle, so that the antimeridian has no seam.
    degrees = 360 / max(1, int(360 / max(km / KM_PER_LAT * 1.05, 0.05)))
    a = _cells(left.where("llat IS NOT NULL AND llon IS NOT NULL"), "llat", "llon", degrees, False, km)
    b = _cells(right.where("rlat IS NOT NULL AND rlon IS NOT NULL"), "rlat", "rlon", degrees, True, km)
    both = a.join(b, [*on, "gy", "gx"]).drop("gy", "gx")
    return both.withColumn("km", haversine_km("llat", "llon", "rlat", "rlon")).where(F.col("km") <= km)


def nearest(origins: DataFrame, points: DataFrame, k: int, km: float) -> DataFrame:
    """The ``k`` nearest points within ``km`` of each origin (zone_id, latitude, longitude), itself left out; ties by id.

    Pairs are made between places, not between rows: all points of a place are equally far from an origin, so only the first
    ``k`` + 1 ids of each place, one of which may be the origin's own, can be among the nearest; and all origins of a place share one list.
    """
    a = origins.select(F.col("zone_id").alias("origin"), F.col("latitude").alias("llat"), F.col("longitude").alias("llon"))
    b = points.where("zone_id IS NOT NULL").select("zone_id", F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"))
    first = Window.partitionBy("rlat", "rlon").orderBy("zone_id")
    few = b.withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= k + 1).drop("place")
    near = near_pairs(a.select("llat", "llon").distinct(), few, km).withColumn("km", F.round("km", 6))
    # An id that is there more than once counts k times at most, so 2 * k rows hold k of other ids.
    own, around = Window.partitionBy("llat", "llon", "zone_id").orderBy("km"), Window.partitionBy("llat", "llon").orderBy("km", "zone_id")
    for w, most in ((own, k), (around, 2 * k)):
        near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    lists = near.groupBy("llat", "llon").agg(F.sort_array(F.collect_list(F.struct("km", "zone_id"))).alias("near"))
    others = F.filter("near", lambda x: x["zone_id"] != F.col("origin"))
    rows = a.join(lists, ["llat", "llon"]).select("origin", F.explode(F.slice(others, 1, k)).alias("x")).select("origin", "x.zone_id", "x.km")
    w = Window.partitionBy("origin").orderBy("km", "zone_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("origin", "zone_id", "km", "place")


def day_pairs(located: DataFrame) -> DataFrame:
    """Pairs of one day's reports with their distance; days hold at most a leaderboard's rows."""
    a = located.select("report_date", F.col("zone_id").alias("a"), F.col("latitude").alias("alat"), F.col("longitude").alias("alon"))
    b = located.select("report_date", F.col("zone_id").alias("b"), F.col("latitude").alias("blat"), F.col("longitude").alias("blon"))
    return a.join(b, "report_date").where("a < b").select("report_date", "a", "b", haversine_km("alat", "alon", "blat", "blon").alias("km"))


def spread(pairs: DataFrame, by: str = "report_date") -> DataFrame:
    return pairs.groupBy(by).agg(F.round(F.max("km"), 6).alias("diameter"), F.round(F.avg("km"), 6).alias("mean_km"), F.round(F.min("km"), 6).alias("closest"))


def clusters(located: DataFrame, km: float = 48.28032) -> DataFrame:
    """(report_date, zone_id, cluster): single linkage within ``km`` inside a day; the cluster is its smallest zone.

    Singletons are clusters of their own.
    """
    points = located.select("report_date", "zone_id", "latitude", "longitude").where("latitude IS NOT NULL").distinct()
    node = F.struct("report_date", F.col("zone_id"))
    ends = [points.select("report_date", F.col("zone_id").alias(n), F.col("latitude").alias(f"{side}lat"), F.col("longitude").alias(f"{side}lon")) for n, side in (("a", "l"), ("b", "r"))]
    edges = near_pairs(*ends, km, ("report_date",)).where("a < b").select(F.struct("report_date", F.col("a").alias("zone_id")).alias("a"), F.struct("report_date", F.col("b").alias("zone_id")).alias("b"))
    found = connected_components(edges)
    out = points.withColumn("node", node).join(found, "node", "left")
    return out.select("report_date", "zone_id", F.coalesce("component.zone_id", "zone_id").alias("cluster"))


def cluster_sizes(members: DataFrame, located: DataFrame) -> DataFrame:
    """(report_date, cluster, n_zones, diameter); a single zone has diameter 0. Pairs are made inside clusters only."""
    places = located.select("report_date", "zone_id", "latitude", "longitude").distinct()
    own = members.join(places, ["report_date", "zone_id"])
    one, two = (own.select("report_date", "cluster", F.col("zone_id").alias(n), F.col("latitude").alias(f"{n}lat"), F.col("longitude").alias(f"{n}lon")) for n in "ab")
    inside = one.join(two, ["report_date", "cluster"]).where("a < b").groupBy("report_date", "cluster").agg(F.max(haversine_km("alat", "alon", "blat", "blon")).alias("d"))
    sizes = members.groupBy("report_date", "cluster").agg(F.count("*").alias("n_zones"))
    return sizes.join(inside, ["report_date", "cluster"], "left").select("report_date", "cluster", "n_zones", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("diameter"))


def largest_by_day(sizes: DataFrame) -> DataFrame:
    w = Window.partitionBy("report_date").orderBy(F.desc("n_zones"), "diameter", "cluster")
    return sizes.withColumn("p", F.row_number().over(w)).where("p = 1").drop("p")


def top_clusters(sizes: DataFrame, least: int = 2, n: int = 14) -> DataFrame:
    return sizes.where(F.col("n_zones") >= least).orderBy(F.desc("n_zones"), "diameter", "report_date", "cluster").limit(n)


def cells_in_circle(df: DataFrame, lat: str, lon: str, km: str) -> DataFrame:
    """One row per 1-degree cell whose centre lies within ``km`` of the row's point, across the antimeridian too."""
    reach = F.ceil(F.col(km) / KM_PER_LAT).cast("int")
    row = F.floor(F.col(lat) + 90).cast("int")
    rows = df.withColumn("cy", F.explode(F.sequence(F.greatest(row - reach, F.lit(0)), F.least(row + reach, F.lit(179)))))
    half = F.least(F.lit(180), F.ceil(F.col(km) / (KM_PER_LAT * F.greatest(F.cos(F.radians(F.least(F.abs(F.col(lat)) + reach, F.lit(89.9)))), F.lit(1e-3)))).cast("int"))
    col = F.floor(F.col(lon) + 180).cast("int")
    rows = rows.withColumn("cx", F.explode(F.sequence(col - half, F.least(col + half, col - half + 359)))).withColumn("cx", F.pmod("cx", F.lit(360)))
    rows = rows.where(haversine_km(lat, lon, F.col("cy") - 89.5, F.col("cx") - 179.5) <= F.col(km))
    return rows.withColumn("cell", (F.col("cy") * 360 + F.col("cx")).cast("int")).drop("cy", "cx")


def explode_rings(features: DataFrame) -> DataFrame:
    """(name, ring_no, ring): one row per ring or line of GeoJSON features (name, type, coordinates as JSON).

    Points and other types are dropped, and so are rings of fewer than two points.
    """
    line, rings, many = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parsed = lambda kind: F.from_json("coordinates", kind)
    each = F.when(F.col("type") == "LineString", F.array(parsed(line))).when(F.col("type").isin("Polygon", "MultiLineString"), parsed(rings)).when(F.col("type") == "MultiPolygon", F.flatten(parsed(many)))
    return features.select("name", F.posexplode(each).alias("ring_no", "ring")).where(F.size("ring") >= 2)


def _corners(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The places of the points that Douglas and Peucker's rule keeps.

    All stretches between neighbouring corners are looked at together: each point is measured against the stretch that it lies
    in, and the farthest of every stretch becomes a corner if it is off by more than ``tolerance``. That is repeated until no
    stretch has such a point. A stretch that ends where it starts is a point.
    """
    corners = np.array([0, len(ring) - 1])
    while True:
        inner = np.delete(np.arange(len(ring)), corners)
        stretch = np.searchsorted(corners, inner)
        here, to = ring[corners[stretch - 1]], ring[corners[stretch]]
        chord, away = to - here, ring[inner] - here
        squared = np.einsum("pc,pc->p", chord, chord)
        foot = np.einsum("pc,pc->p", away, chord) / np.where(squared > 0, squared, 1.0)
        gap = np.linalg.norm(away - np.minimum(np.maximum(foot, 0.0), 1.0)[:, None] * chord, axis=1)
        best = pd.DataFrame({"stretch": stretch, "gap": gap, "at": inner}).sort_values(["stretch", "gap", "at"], ascending=[True, False, True]).drop_duplicates("stretch")
        more = best.loc[best["gap"] > tolerance, "at"].to_numpy()
        if not len(more):
            return corners
        corners = np.union1d(corners, more)


def simplify_paths(rings: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``ring`` with the points that matter at ``tolerance`` degrees, and where each path starts in the whole."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def simplified(column: pd.Series) -> pd.Series:
        def one(ring):
            points = np.array([list(p)[:2] for p in ring], float)
            return points[_corners(points, tolerance)].tolist()

        return column.map(one)

    out = rings.withColumn("ring", simplified("ring"))
    before = Window.partitionBy("name").orderBy("ring_no").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum(F.size("ring")).over(before), F.lit(0)))


def cluster_record(battles: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each day's clusters of two zones or more: members, regions and countries (sorted), launches, diameter.

    A day holds a leaderboard's rows at most, so the lists are short.
    """
    ids = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")
    rows = members.join(battles.select("report_date", "zone_id", "launches", "region_id", "country_id"), ["report_date", "zone_id"])
    found = rows.groupBy("report_date", "cluster").agg(ids("zone_id").alias("members"), ids("region_id").alias("regions"), ids("country_id").alias("countries"), F.sum("launches").alias("launches"))
    return found.join(sizes.where("n_zones > 1"), ["report_date", "cluster"])


def unplaced_reports(reports: DataFrame, dim: DataFrame) -> DataFrame:
    """Per day, the reports of zones without a known place, which no cluster can hold."""
    placed = dim.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("zone_id")
    rows = reports.where("NOT is_tournament AND report_date IS NOT NULL").join(placed, "zone_id", "left_anti")
    return rows.groupBy("report_date").agg(F.count("*").alias("n_missing"))


def tile_manifest(zones: DataFrame, events: DataFrame) -> DataFrame:
    """Per tile its zones, those with any event, and its south-west corner (16-degree tiles, 23 around)."""
    active = events.select("zone_id").distinct().withColumn("played", F.lit(True))
    rows = zones.select("zone_id", tile_of("latitude", "longitude").alias("tile")).where("tile IS NOT NULL").join(active, "zone_id", "left")
    south, west = F.floor(F.col("tile") / 23) * 16 - 90, F.col("tile") % 23 * 16 - 180
    sums = rows.groupBy("tile").agg(F.count("*").alias("n_zones"), F.count("played").alias("n_played"))
    return sums.select("tile", "n_zones", "n_played", south.cast("int").alias("south"), west.cast("int").alias("west"))


def area_extent(zones: DataFrame, area: str) -> DataFrame:
    """The bounding box of each area's located zones; an area over the antimeridian gets the whole width."""
    sides = (F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north"))
    return zones.where("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy(area).agg(*sides)


def bounding_boxes(circles: DataFrame, lat: str = "latitude", lon: str = "longitude", km: str = "radius_km") -> DataFrame:
    """``circles`` plus south, north, west and east of a box that holds each circle, with 5 % to spare.

    A box over the antimeridian has west > east; one over a pole, or as wide as the globe, runs from -180 to 180.
    """
    up = F.col(km) * 1.05 / 111.32
    far = F.least(F.abs(F.col(lat)) + up, F.lit(89.9))
    side = F.least(up / F.cos(F.radians(far)), F.lit(180.0))
    wrap = lambda x: F.when(x < -180, x + 360).when(x > 180, x - 360).otherwise(x)
    whole = side >= 180
    return circles.withColumns({
        "south": F.greatest(F.col(lat) - up, F.lit(-90.0)), "north": F.least(F.col(lat) + up, F.lit(90.0)),
        "west": F.when(whole, -180.0).otherwise(wrap(F.col(lon) - side)), "east": F.when(whole, 180.0).otherwise(wrap(F.col(lon) + side)),
    })


def scope(dim: DataFrame, kind: str = "all", circle: tuple[float, float, float] | None = None, events: DataFrame | None = None) -> DataFrame:
    """The located zones of a scope: ``all``, those of a ``circle`` (latitude, longitude, km), or the ``active`` ones with an event."""
    placed = dim.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    if kind == "all":
        return placed
    if kind == "circle":
        return placed.where(within_km("latitude", "longitude", *circle))
    if kind == "active":
        return placed.join(events.select("zone_id").distinct(), "zone_id", "left_semi")
    raise ValueError(f"unknown scope: {kind}")


def cluster_order(members: DataFrame, sizes: DataFrame, battles: DataFrame) -> DataFrame:
    """``members`` with ``place``, ``n_zones`` and ``diameter`` of their cluster: a day's clusters from 1 on, larger ones first, then as
    their first report came. Numbers are given within the day, so nothing is sorted as a whole."""
    first = members.join(battles.select("report_date", "zone_id", "report_id"), ["report_date", "zone_id"]).groupBy("report_date", "cluster").agg(F.min("report_id").alias("first"))
    day = Window.partitionBy("report_date").orderBy(F.desc("n_zones"), "first", "cluster")
    placed = sizes.join(first, ["report_date", "cluster"]).withColumn("place", F.row_number().over(day)).drop("first")
    return members.join(placed, ["report_date", "cluster"])
