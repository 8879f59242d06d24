"""Curated incidents: who was on the board, who was near, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from .geo import near_pairs


def resolve(flashpoints: DataFrame, dim: DataFrame) -> DataFrame:
    """Incidents whose anchor is a known zone, with its place; a mistyped anchor drops out (see checks)."""
    return flashpoints.join(dim.select(F.col("zone_id").alias("anchor_zone_id"), "latitude", "longitude"), "anchor_zone_id")


def flashpoint_zone(resolved: DataFrame, battles: DataFrame, dim: DataFrame) -> DataFrame:
    """(flashpoint, zone, km, on_the_board): the zones of each circle, of any radius, marked if they reported in the board window."""
    a = dim.select("zone_id", F.col("latitude").alias("llat"), F.col("longitude").alias("llon"))
    b = resolved.select("flashpoint_id", "radius_km", F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"))
    widest = resolved.agg(F.max("radius_km")).first()[0] or 0.0
    circle = near_pairs(a, b, widest).where("km <= radius_km").select("flashpoint_id", "zone_id", "km")
    window = resolved.select("flashpoint_id", "board_start", "board_end")
    board = circle.select("flashpoint_id", "zone_id").join(window, "flashpoint_id").join(battles.select("zone_id", "report_date"), "zone_id")
    board = board.where(F.col("report_date").between(F.col("board_start"), F.col("board_end"))).select("flashpoint_id", "zone_id").distinct().withColumn("b", F.lit(True))
    out = circle.join(board, ["flashpoint_id", "zone_id"], "left")
    return out.select("flashpoint_id", "zone_id", F.round("km", 6).alias("km"), F.coalesce("b", F.lit(False)).alias("on_the_board"))


def impact(resolved: DataFrame, members: DataFrame, spine: DataFrame) -> DataFrame:
    """Net change, zones moving and events per incident, day and group, inside the run window."""
    runs = members.select("flashpoint_id", "zone_id", "on_the_board").join(resolved.select("flashpoint_id", "run_start", "run_end"), "flashpoint_id")
    rows = spine.join(runs, "zone_id").where(F.col("activity_date").between(F.col("run_start"), F.col("run_end")))
    return rows.groupBy("flashpoint_id", "activity_date", "on_the_board").agg(F.sum("total_delta").alias("net_delta"), F.count_distinct("zone_id").alias("zones_moving"), F.count("*").alias("n_events"))


def manifest(resolved: DataFrame, members: DataFrame, effects: DataFrame) -> DataFrame:
    """Circle sizes and whether the record has anything on the board at all."""
    sizes = members.groupBy("flashpoint_id").agg(F.count("*").alias("n_circle"), F.count_if("on_the_board").alias("n_board"))
    seen = effects.groupBy("flashpoint_id").agg(F.sum(F.when(F.col("on_the_board"), F.col("n_events"))).alias("evidence"))
    out = resolved.select("flashpoint_id", "label", "run_start", "run_end").join(sizes, "flashpoint_id", "left").join(seen, "flashpoint_id", "left")
    return out.na.fill(0, ["n_circle", "n_board", "evidence"]).withColumn("changelog_covered", F.col("evidence") > 0)


def impact_summary(resolved: DataFrame, effects: DataFrame) -> DataFrame:
    """Net change before, during and after the board window for both groups, and rates per day."""
    rows = effects.join(resolved.select("flashpoint_id", "board_start", "board_end"), "flashpoint_id")
    day = F.col("activity_date")
    part = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("net_delta"))), F.lit(0)).alias(name)
    out = rows.groupBy("flashpoint_id", "on_the_board").agg(part(day < F.col("board_start"), "before"), part(day.between(F.col("board_start"), F.col("board_end")), "during"), part(day > F.col("board_end"), "after"))
    days = resolved.select("flashpoint_id", (F.datediff("board_start", "run_start")).alias("d0"), (F.datediff("board_end", "board_start") + 1).alias("d1"))
    rate = lambda c, d: F.when(F.col(d) > 0, F.round(F.col(c) / F.col(d), 6))
    both = out.join(days, "flashpoint_id").withColumns({"before_rate": rate("before", "d0"), "during_rate": rate("during", "d1")}).drop("d0", "d1")
    same = F.signum("before") == F.signum("during")
    multiple = F.when((F.abs("before") > 1000) & same, F.round(F.col("during_rate") / F.col("before_rate"), 6))
    return both.withColumns({"multiple": multiple, "flipped": (F.signum("before") * F.signum("during")) < 0})


def circle(dim: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    from ..functions.scalars import within_km

    return dim.where(within_km("latitude", "longitude", lat, lon, km)).select("zone_id", F.round(haversine_km("latitude", "longitude", F.lit(lat), F.lit(lon)), 6).alias("km"))


def impact_series(resolved: DataFrame, effects: DataFrame) -> DataFrame:
    """Every day of each run window: net change on the board, next to it, and zones moving; 0 where nothing happened."""
    days = resolved.select("flashpoint_id", F.explode(F.sequence("run_start", "run_end")).alias("activity_date"))
    board = F.sum(F.when(F.col("on_the_board"), F.col("net_delta")))
    beside = F.sum(F.when(~F.col("on_the_board"), F.col("net_delta")))
    sums = effects.groupBy("flashpoint_id", "activity_date").agg(board.alias("board"), beside.alias("neighbors"), F.sum("zones_moving").alias("moving"))
    return days.join(sums, ["flashpoint_id", "activity_date"], "left").na.fill(0, ["board", "neighbors", "moving"])


def board_lists(resolved: DataFrame, members: DataFrame, index: DataFrame) -> DataFrame:
    """The stable indices of each incident's board zones, ascending; an empty list where there are none."""
    found = members.where("on_the_board").join(index, "zone_id").groupBy("flashpoint_id").agg(F.sort_array(F.collect_set("idx")).alias("board"))
    return resolved.select("flashpoint_id").join(found, "flashpoint_id", "left").withColumn("board", F.coalesce("board", F.array().cast("array<bigint>")))


def codes(resolved: DataFrame) -> DataFrame:
    """(flashpoint_id, code): places from 0 in the order (run_start, id) of the curated list, which is small."""
    return resolved.select("flashpoint_id", (F.row_number().over(Window.orderBy("run_start", "flashpoint_id")) - 1).alias("code"))
