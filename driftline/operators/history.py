"""State in time: anchors, replay, flips, movement and trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import faction_of, occupancy_class, quantize
from .spine import COUNTS


def anchors(display: DataFrame) -> DataFrame:
    """The last packed state before each January 1, empty ones left out; all years in one pass."""
    w = Window.partitionBy("zone_id").orderBy("activity_date")
    span = display.agg(F.max(F.year("activity_date")).alias("hi"))
    rows = display.withColumn("next", F.lead("activity_date").over(w)).join(F.broadcast(span))
    lo, hi = F.year("activity_date") + 1, F.coalesce(F.year("next"), F.col("hi"))
    years = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return rows.where("packed <> 0").select("zone_id", F.explode(years).alias("year"), "packed")


def state_at(display: DataFrame, day: str) -> DataFrame:
    """The packed state of each zone that had one by the end of ``day``."""
    return display.where(F.col("activity_date") <= F.lit(day).cast("date")).groupBy("zone_id").agg(F.max_by("packed", "activity_date").alias("packed"))


def replay(anchor: DataFrame, display: DataFrame, day: str) -> DataFrame:
    """``state_at`` from the year's anchor and that year's rows only."""
    start = F.trunc(F.lit(day).cast("date"), "year")
    rows = display.where((F.col("activity_date") >= start) & (F.col("activity_date") <= F.lit(day).cast("date")))
    base = anchor.where(F.col("year") == F.year(F.lit(day).cast("date"))).select("zone_id", F.date_sub(start, 1).alias("activity_date"), "packed")
    return base.unionByName(rows.select("zone_id", "activity_date", "packed")).groupBy("zone_id").agg(F.max_by("packed", "activity_date").alias("packed"))


def step(state: DataFrame, display: DataFrame, start: str, day: str) -> DataFrame:
    """The state of ``day`` from that of ``start`` and the rows between."""
    rows = display.where((F.col("activity_date") > F.lit(start).cast("date")) & (F.col("activity_date") <= F.lit(day).cast("date")))
    new = rows.groupBy("zone_id").agg(F.max_by("packed", "activity_date").alias("new"))
    return state.join(new, "zone_id", "full_outer").select("zone_id", F.coalesce("new", "packed").alias("packed"))


def flips(display: DataFrame) -> DataFrame:
    """Days on which a zone's leader changed; growth alone is none."""
    w = Window.partitionBy("zone_id").orderBy("activity_date")
    rows = display.select("zone_id", "activity_date", faction_of("packed").alias("to_faction")).withColumn("from_faction", F.lag("to_faction", 1, 0).over(w))
    return rows.where("to_faction <> from_faction").select("zone_id", "activity_date", "from_faction", "to_faction")


def moved_between(display: DataFrame, start: str, day: str) -> DataFrame:
    """Zones with any event in the half-open window (start, day]."""
    return display.where((F.col("activity_date") > F.lit(start).cast("date")) & (F.col("activity_date") <= F.lit(day).cast("date"))).select("zone_id").distinct()


def claimed_since(flipped: DataFrame, start: str) -> DataFrame:
    """Per day, the zones whose first flip since ``start`` it was, and how many have flipped by then."""
    first = flipped.where(F.col("activity_date") >= F.lit(start).cast("date")).groupBy("zone_id").agg(F.min("activity_date").alias("activity_date"))
    daily = first.groupBy("activity_date").agg(F.count("*").alias("n_new"))
    return daily.withColumn("n_claimed", F.sum("n_new").over(Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)))


def flip_trail(flipped: DataFrame, day: str, n: int = 5) -> DataFrame:
    """Flips of the last ``n`` days with a fading weight."""
    age = F.datediff(F.lit(day).cast("date"), "activity_date")
    return flipped.where((age >= 0) & (age < n)).withColumn("weight", F.round(1 - age / n, 6))


def state_totals(state: DataFrame) -> DataFrame:
    return state.groupBy(faction_of("packed").alias("faction")).agg(F.count("*").alias("n_zones"))


def occupancy(zones: DataFrame, state: DataFrame) -> DataFrame:
    """Held, emptied or never played, per located zone; a zone with a state row has been active."""
    both = zones.select("zone_id").join(state, "zone_id", "left")
    return both.groupBy(occupancy_class(F.coalesce("packed", F.lit(0)), F.col("packed").isNotNull()).alias("occupancy")).agg(F.count("*").alias("n_zones"))


def region_breakdown(zones: DataFrame, state: DataFrame, top: int = 10) -> DataFrame:
    """Per country its regions by zones held: counts per leader and the leading faction (ties: lowest)."""
    f = F.coalesce(faction_of("packed"), F.lit(0))
    rows = zones.join(state, "zone_id", "left").groupBy("country_id", "region_id").agg(F.count("*").alias("n_zones"), F.count_if(f > 0).alias("n_held"), *(F.count_if(f == k).alias(f"n_{k}") for k in (1, 2, 3)))
    most = F.greatest("n_1", "n_2", "n_3")
    rows = rows.withColumn("lead_faction", F.when(F.col("n_held") == 0, 0).when(F.col("n_1") == most, 1).when(F.col("n_2") == most, 2).otherwise(3))
    w = Window.partitionBy("country_id").orderBy(F.desc("n_held"), F.desc("n_zones"), "region_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def area_index(zones: DataFrame) -> DataFrame:
    """Zones per country and per region, each on its own id."""
    part = lambda kind: zones.where(F.col(f"{kind}_id").isNotNull()).groupBy(F.col(f"{kind}_id").alias("area_id")).agg(F.count("*").alias("n_zones")).withColumn("kind", F.lit(kind))
    return part("country").unionByName(part("region"))


def paint(zones: DataFrame, events: DataFrame) -> DataFrame:
    """Every located zone with its packed state from the stream and whether it was ever active."""
    from ..functions.scalars import pack_display
    from .spine import current_state

    both = zones.select("zone_id", "latitude", "longitude").join(current_state(events), "zone_id", "left")
    packed = pack_display(F.coalesce("control_state", F.lit(0)), *(F.coalesce(c, F.lit(0)) for c in COUNTS)).cast("int")
    return both.select("zone_id", F.col("observed_at").isNotNull().alias("ever_active"), packed.alias("packed"))


def map_rows(zones: DataFrame, events: DataFrame) -> DataFrame:
    """``paint`` with coordinates in fixed point: what a map draws; zones without a place are left out."""
    placed = zones.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    places = placed.select("zone_id", quantize("latitude").alias("lat_e4"), quantize("longitude").alias("lon_e4"))
    return places.join(paint(placed, events), "zone_id")


def states_at(display: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(day, zone_id, packed) for each of ``days``: the last packed state of every zone by its end; zones without one are left out.

    Each state holds from its day until the next one's eve, so a day's rows are found by one range join with the short list of days.
    """
    w = Window.partitionBy("zone_id").orderBy("activity_date")
    spans = display.select("zone_id", "packed", F.col("activity_date").alias("since"), F.lead("activity_date").over(w).alias("until"))
    wanted = F.broadcast(days.select(day).distinct())
    both = spans.join(wanted, (F.col(day) >= F.col("since")) & (F.col("until").isNull() | (F.col(day) < F.col("until"))))
    return both.select(day, "zone_id", "packed")


def breakdown_rest(zones: DataFrame, state: DataFrame, top: int = 10) -> DataFrame:
    """Per country, what ``region_breakdown`` leaves out: regions beyond ``top`` with their zones, and regions where nothing is held."""
    every = region_breakdown(zones, state, 1 << 30)
    rest = F.col("place") > top
    return every.groupBy("country_id").agg(F.count_if(rest).alias("n_rest"), F.coalesce(F.sum(F.when(rest, F.col("n_zones"))), F.lit(0)).alias("rest_zones"), F.count_if(F.col("n_held") == 0).alias("n_quiet"))
