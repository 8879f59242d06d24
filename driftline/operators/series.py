"""Daily series: dense spines, running sums, areas and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_of, within_km
from .spine import COUNTS

DELTAS = tuple(f"{c}_delta" for c in COUNTS)


def calendar(df: DataFrame, day: str = "activity_date") -> DataFrame:
    """Every day from the first to the last of ``df``."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias(day))


def daily_activity(spine: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return spine.groupBy(*by, "activity_date").agg(*(F.sum(c).alias(c) for c in DELTAS), F.count("*").alias("n_events"), F.count_if("is_capture").alias("n_captures"))


def _dense(spine: DataFrame, daily: DataFrame, by: tuple[str, ...], running: Window) -> DataFrame:
    full = spine.join(daily, [*by, "activity_date"], "left").na.fill(0, [*DELTAS, "n_events", "n_captures"])
    return full.select(*by, "activity_date", "n_events", "n_captures", *(F.sum(f"{c}_delta").over(running).alias(c) for c in COUNTS))


def global_daily(spine: DataFrame) -> DataFrame:
    """Running totals for every day; the window is over one row a day."""
    daily = daily_activity(spine)
    return _dense(calendar(daily), daily, (), Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0))


def country_daily(events: DataFrame, countries: DataFrame) -> DataFrame:
    """Running totals of every country over the whole span, leading zeros kept."""
    daily = daily_activity(events.where("country_id IS NOT NULL"), ("country_id",))
    days = calendar(events)
    spine = countries.select("country_id").join(F.broadcast(days))
    running = Window.partitionBy("country_id").orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    return _dense(spine, daily, ("country_id",), running)


def area_series(events: DataFrame, area: str) -> DataFrame:
    """(area, day, three deltas) where anything moved; ``area`` is country_id, region_id or cell."""
    if area == "cell":
        events = events.withColumn("cell", cell_of("latitude", "longitude"))
    daily = events.where(F.col(area).isNotNull()).groupBy(area, "activity_date").agg(*(F.sum(c).alias(c) for c in DELTAS))
    return daily.where(" OR ".join(f"{c} <> 0" for c in DELTAS))


def scope_daily(events: DataFrame) -> DataFrame:
    """Running totals of located zones on days with events, from 0 at the start of ``events``."""
    daily = events.where("latitude IS NOT NULL").groupBy("activity_date").agg(*(F.sum(c).alias(c) for c in DELTAS))
    w = Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("activity_date", *(F.sum(f"{c}_delta").over(w).alias(c) for c in COUNTS))


def densify(sparse: DataFrame, area: str) -> DataFrame:
    """Sparse deltas of areas as levels for every day of the common span."""
    spine = sparse.select(area).distinct().join(F.broadcast(calendar(sparse)))
    w = Window.partitionBy(area).orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(sparse, [area, "activity_date"], "left").na.fill(0, list(DELTAS))
    return full.select(area, "activity_date", *(F.sum(f"{c}_delta").over(w).alias(c) for c in COUNTS))


def zone_series(events: DataFrame, zone_id: int) -> DataFrame:
    """One zone's total for every day from its first to the record's last, carried forward."""
    own = events.where(F.col("zone_id") == zone_id).groupBy("activity_date").agg(F.max_by("total", "observed_at").alias("total"))
    ends = own.agg(F.min("activity_date").alias("a")).join(F.broadcast(events.agg(F.max("activity_date").alias("b")))).where("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("activity_date"))
    w = Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(own, "activity_date", "left").select("activity_date", F.coalesce(F.last("total", ignorenulls=True).over(w), F.lit(0)).cast("long").alias("total"))


def change_window(dense: DataFrame, days: int = 365) -> DataFrame:
    """Each day's totals against those ``days`` before; null where the record does not reach."""
    then = dense.select(F.date_add("activity_date", days).alias("activity_date"), *(F.col(c).alias(f"{c}_then") for c in COUNTS))
    out = dense.join(then, "activity_date", "left")
    return out.select("activity_date", *COUNTS, *((F.col(c) - F.col(f"{c}_then")).alias(f"{c}_change") for c in COUNTS))


def net_over(daily: DataFrame, start: str, end: str) -> DataFrame:
    return daily.where(F.col("activity_date").between(start, end)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DELTAS))


def sparse_series(dense: DataFrame, daily: DataFrame, start: str) -> DataFrame:
    """Running totals of the days from ``start`` on which a total moved; what came before stays in the levels."""
    moved = daily.where(" OR ".join(f"{c} <> 0" for c in DELTAS)).select("activity_date")
    return dense.join(moved, "activity_date", "left_semi").where(F.col("activity_date") >= F.lit(start).cast("date")).select("activity_date", *COUNTS)


def net_since(dense: DataFrame, start: str, day: str) -> DataFrame:
    """The change of the whole total from ``start`` (the record's first day at least) to ``day``; no row where nothing lies between."""
    until = dense.where(F.col("activity_date") <= F.lit(day).cast("date")).select("activity_date", sum(F.col(c) for c in COUNTS).alias("total"))
    since = until.where(F.col("activity_date") >= F.lit(start).cast("date"))
    ends = since.agg(F.min("activity_date").alias("first_day"), F.max("activity_date").alias("last_day"), (F.max_by("total", "activity_date") - F.min_by("total", "activity_date")).alias("net"))
    return ends.where("last_day > first_day")


def cell_in_bounds(west: float, south: float, east: float, north: float, cell: str = "cell"):
    """Whether a 1-degree cell touches a box; the box may cross the antimeridian and spans 360 degrees at most."""
    span = math.ceil(min(east - west, 360))
    along = F.pmod(F.pmod(F.col(cell), F.lit(360)) - F.lit(math.floor(west) + 180), F.lit(360))
    up = F.floor(F.col(cell) / 360) - 90
    return (along <= span) & up.between(math.floor(south), math.ceil(north))


def series_for_cells(cells: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Levels of all cells in ``box`` together, for every day of the record of all cells."""
    daily = cells.where(cell_in_bounds(*box)).groupBy("activity_date").agg(*(F.sum(c).alias(c) for c in DELTAS))
    running = Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    full = calendar(cells).join(daily, "activity_date", "left").na.fill(0, list(DELTAS))
    return full.select("activity_date", *(F.sum(f"{c}_delta").over(running).alias(c) for c in COUNTS))


def densify_levels(levels: DataFrame, area: str, cols: tuple[str, ...] = COUNTS) -> DataFrame:
    """Sparse levels of areas for every day of the common span: a level holds until the next one, 0 before the first."""
    spine = levels.select(area).distinct().join(F.broadcast(calendar(levels)))
    w = Window.partitionBy(area).orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(levels, [area, "activity_date"], "left")
    return full.select(area, "activity_date", *(F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)).alias(c) for c in cols))


def history(selection: dict, events: DataFrame, grains: dict[str, DataFrame] | None = None) -> DataFrame:
    """Running totals of a selection for every day of the record. The most specific part of ``selection`` wins: zone_id,
    circle (latitude, longitude, km), box (west, south, east, north), region_id, country_id; without any, it is the world.

    ``grains`` may hold written area series by area (cell, region_id, country_id); those are read in place of the events.
    """
    rules = {
        "zone_id": (None, lambda v: F.col("zone_id") == v),
        "circle": (None, lambda v: within_km("latitude", "longitude", *v)),
        "box": ("cell", lambda v: cell_in_bounds(*v)),
        "region_id": ("region_id", lambda v: F.col("region_id") == v),
        "country_id": ("country_id", lambda v: F.col("country_id") == v),
    }
    part = next((p for p in rules if selection.get(p) is not None), None)
    grain, rule = rules.get(part, (None, None))
    rows = (grains or {}).get(grain)
    if rows is None:
        rows = events.withColumn("cell", cell_of("latitude", "longitude")) if grain == "cell" else events
    picked = rows.where(rule(selection[part])) if part else rows
    daily = picked.groupBy("activity_date").agg(*(F.sum(c).alias(c) for c in DELTAS))
    running = Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)
    full = calendar(events).join(daily, "activity_date", "left").na.fill(0, list(DELTAS))
    return full.select("activity_date", *(F.sum(f"{c}_delta").over(running).alias(c) for c in COUNTS))
