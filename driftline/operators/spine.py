"""The event spine: absolute counts become deltas once; everything else is a sum of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_capture, pack_display

COUNTS = ("legion", "swarm", "faceless")


def deltas(df: DataFrame, key: str, ts: str, cols: tuple[str, ...] = COUNTS, state: str = "control_state") -> DataFrame:
    """Differences to the key's previous row (0 before the first), its previous state and a first flag: one shuffle."""
    w = Window.partitionBy(key).orderBy(ts)
    out = {f"{c}_delta": F.col(c) - F.lag(c, 1, 0).over(w) for c in cols}
    return df.withColumns(out | {"prev_state": F.lag(state).over(w), "is_first": F.row_number().over(w) == 1})


def event_spine(changelog: DataFrame) -> DataFrame:
    out = deltas(changelog, "zone_id", "observed_at")
    total = sum(F.col(c) for c in COUNTS)
    moved = sum(F.col(f"{c}_delta") for c in COUNTS)
    return out.withColumns({"total": total, "total_delta": moved, "is_capture": is_capture("control_state", "prev_state"), "activity_date": F.to_date("observed_at")})


def since(spine: DataFrame, day: str) -> DataFrame:
    """The record from ``day`` on; deltas still know what was before, as the cut comes after the window."""
    return spine.where(F.col("activity_date") >= F.lit(day).cast("date"))


def dim_zone(zones: DataFrame, regions: DataFrame, countries: DataFrame) -> DataFrame:
    """Zones with labels; the region's label follows region_id alone. Lookups are small fixed lists."""
    return zones.join(regions, "region_id", "left").join(countries, "country_id", "left").select("zone_id", "zone_name", "country_id", "country_name", "region_id", "region_name", "latitude", "longitude")


def zone_events(spine: DataFrame, dim: DataFrame) -> DataFrame:
    """The spine with geography; changes of unknown zones stay."""
    return spine.join(dim.select("zone_id", "country_id", "region_id", "latitude", "longitude"), "zone_id", "left")


def current_state(events: DataFrame, by: str = "zone_id") -> DataFrame:
    """Latest row per zone; one struct, so that columns cannot mix rows."""
    last = F.max_by(F.struct("control_state", *COUNTS, "observed_at"), "observed_at").alias("s")
    return events.groupBy(by).agg(last).select(by, "s.*")


def checkpoints(events: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The state of each zone before every January 1: each row is exploded over the boundaries that it covers."""
    w = Window.partitionBy("zone_id").orderBy("observed_at")
    span = events.agg(F.min(F.year("observed_at")).alias("lo"), F.max(F.year("observed_at")).alias("hi"))
    rows = events.withColumn("next_at", F.lead("observed_at").over(w)).join(F.broadcast(span))
    lo = F.greatest(F.year("observed_at") + 1, F.lit(first_year) if first_year is not None else F.col("lo") + 1)
    top = F.lit(last_year) if last_year is not None else F.col("hi")
    # The next row lies at or after a boundary of its own year, midnight included.
    hi = F.least(F.coalesce(F.year("next_at"), top), top)
    years = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return rows.select("zone_id", F.explode(years).alias("boundary_year"), "observed_at", "control_state", *COUNTS)


def _last_of_day(df: DataFrame, *more: str) -> DataFrame:
    last = F.max_by(F.struct("control_state", *COUNTS, *more), "observed_at").alias("s")
    return df.groupBy("zone_id", "activity_date").agg(last, F.count("*").alias("n_events"))


def display_day(spine: DataFrame) -> DataFrame:
    """(zone, day, packed state) after the day's last row."""
    return _last_of_day(spine).select("zone_id", "activity_date", pack_display("s.control_state", *(f"s.{c}" for c in COUNTS)).cast("int").alias("packed"))


def zone_day(spine: DataFrame) -> DataFrame:
    """Standing at the end of each active day, events of the day and the step from the last active day."""
    w = Window.partitionBy("zone_id").orderBy("activity_date")
    rows = _last_of_day(spine, "total").select("zone_id", "activity_date", "n_events", F.col("s.total").alias("total"))
    return rows.withColumn("step", F.col("total") - F.lag("total", 1, 0).over(w))
