"""The registered queries of the state-change model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cell_of
from ..operators import checks, flashpoints, geo, history, keys, lookups, reports, series, spine
from ..sources import adapters as A
from ..sources import pages as P
from . import model_queries, page_queries, stream_queries, views

DAY, START, PLACE = "1998-06-15", "1998-01-01", (51.0, 1.5, 25.0)
BAD = ("1997-07-01", "1997-09-11")
BOX = (0.4, 50.3, 1.6, 51.2)
#: Label, first and last day; None is the record's own end.
PERIODS = (("whole record", None, None), ("from 1997", "1997-01-01", None), ("two years", "1996-04-01", "1998-03-31"), ("until 1996", None, "1996-01-01"))


class Model:
    """The tables of the model over one folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    changelog = property(lambda m: A.changelog(m.spark, m.sf_dir))
    spine = property(lambda m: spine.event_spine(m.changelog))
    countries = property(lambda m: A.countries(m.spark, m.sf_dir))
    dim = property(lambda m: spine.dim_zone(A.zones(m.spark, m.sf_dir), A.regions(m.spark, m.sf_dir), m.countries))
    gapped = property(lambda m: A.with_gaps(m.dim))
    events = property(lambda m: spine.zone_events(m.spine, m.dim))
    display = property(lambda m: spine.display_day(m.spine))
    reports = property(lambda m: A.reports(m.spark, m.sf_dir))
    battles = property(lambda m: reports.zone_battles(m.reports, m.dim))
    stats = property(lambda m: reports.maz_stats(m.battles))
    daily = property(lambda m: reports.daily_totals(m.stats))
    activity = property(lambda m: A.activity(m.spark, m.sf_dir))
    flash = property(lambda m: A.flashpoints(m.spark))
    resolved = property(lambda m: flashpoints.resolve(m.flash, m.dim))
    members = property(lambda m: flashpoints.flashpoint_zone(m.resolved, m.battles, m.dim))
    impact = property(lambda m: flashpoints.impact(m.resolved, m.members, m.spine))
    located = property(lambda m: m.battles.select("report_date", "zone_id", "latitude", "longitude").distinct())
    clusters = property(lambda m: geo.clusters(m.located))
    cluster_sizes = property(lambda m: geo.cluster_sizes(m.clusters, m.located))
    pages = property(lambda m: A.table(m.spark, m.sf_dir, "pages"))
    codes = property(lambda m: m.impact.join(F.broadcast(flashpoints.codes(m.resolved)), "flashpoint_id", "left").select("code"))

    def boards(m, index: DataFrame) -> DataFrame:
        return flashpoints.board_lists(m.resolved, m.members, index)


def _occupancy(m: Model) -> DataFrame:
    return history.occupancy(m.dim, history.state_at(m.display, DAY))


def _stable_index(m: Model) -> DataFrame:
    ids = m.dim.select("zone_id")
    old = ids.where("zone_id % 3 = 0").unionByName(m.spark.range(900_000_001, 900_000_004).select(F.col("id").alias("zone_id")))
    empty = m.spark.createDataFrame([], "idx long, zone_id long")
    return keys.stable_index(keys.stable_index(empty, old), ids)


def _upsert(m: Model) -> DataFrame:
    rows = m.changelog.select("zone_id", "observed_at", "control_state", *spine.COUNTS)
    newest = lambda df: keys.upsert_latest(df.limit(0), df, "zone_id", "observed_at")
    return keys.upsert_latest(newest(rows.where("legion % 2 = 0")), newest(rows.where("legion % 2 = 1")), "zone_id", "observed_at")


def _merge(m: Model) -> DataFrame:
    from .scratch import new_path

    rows = m.changelog.withColumn("year", F.year("observed_at"))
    root = new_path(m.spark, "events")
    keys.merge_events(m.spark, rows.where("year < 1999"), root, ["zone_id", "observed_at"])
    keys.merge_events(m.spark, rows.where("year >= 1998"), root, ["zone_id", "observed_at"])
    keys.merge_events(m.spark, rows.where("year = 1997"), root, ["zone_id", "observed_at"])
    return m.spark.read.parquet(root).groupBy("year").agg(F.count("*").alias("n"), F.sum("legion").alias("legion"))


def _name_blocks(m: Model) -> DataFrame:
    named = m.dim.select(F.col("zone_id").alias("idx"), F.col("zone_name").alias("name"))
    return keys.name_blocks(named)


def _delta(m: Model) -> DataFrame:
    rows = m.changelog.select("zone_id", "observed_at", "legion")
    coded = keys.delta_encode(rows, "zone_id", "observed_at", "legion").drop("legion")
    return keys.delta_decode(coded, "zone_id", "observed_at").select("zone_id", "observed_at", "delta", "level")


def _targets(m: Model) -> DataFrame:
    numbers = lambda df: df.select(F.col("report_id").alias("n")).distinct()
    return keys.plan_targets(numbers(m.reports), numbers(m.battles), 100)


def _plan_days(m: Model) -> DataFrame:
    return keys.plan_days(m.spine, "2001-08-20")


def _cells(m: Model) -> DataFrame:
    return geo.cells_in_circle(m.resolved.select("flashpoint_id", "latitude", "longitude", (F.col("radius_km") * 4).alias("km")), "latitude", "longitude", "km").select("flashpoint_id", "cell")


def _nearest(m: Model) -> DataFrame:
    located = m.dim.select("zone_id", "latitude", "longitude")
    return geo.nearest(located, located, 3, 5.0)


def _manifest(m: Model) -> DataFrame:
    state = spine.current_state(m.spine)
    scope = m.dim.agg(F.count("*").alias("n_zones"))
    span = m.spine.agg(F.min("activity_date").alias("first_day"), F.max("activity_date").alias("last_day"), F.count("*").alias("n_events"), F.count_distinct("zone_id").alias("n_ever_active"))
    held = state.agg(*(F.sum(c).alias(c) for c in spine.COUNTS), F.count_if(sum(F.col(c) for c in spine.COUNTS) > 0).alias("n_held"))
    return scope.join(F.broadcast(span)).join(F.broadcast(held))


def _lookup(m: Model) -> DataFrame:
    from .scratch import new_path

    path = new_path(m.spark, "lookup")
    lookups.lookup_json(m.dim, "zone_id", ["zone_name", "region_id"]).write.text(path)
    return lookups.read_lookup_json(m.spark.read.text(path), "zone_id", {"zone_name": "string", "region_id": "int"})


def _search(m: Model) -> DataFrame:
    areas = m.dim.select("zone_id", F.col("zone_name").alias("label"), F.concat_ws(", ", "region_name", "country_name").alias("detail"))
    return lookups.search_areas(areas, " _3, E")


def _periods(m: Model) -> DataFrame:
    named = m.spark.createDataFrame(PERIODS, "label string, start string, end string").select("label", F.col("start").cast("date"), F.col("end").cast("date"))
    daily = series.daily_activity(m.spine)
    return lookups.period_activity(lookups.period_bounds(named, daily), daily)


def _boards(m: Model) -> DataFrame:
    index = keys.stable_index(m.spark.createDataFrame([], "idx long, zone_id long"), m.dim.select("zone_id"))
    found = flashpoints.board_lists(m.resolved, m.members, index)
    return found.select("flashpoint_id", F.array_join(F.transform("board", lambda x: x.cast("string")), ",").alias("board"))


def _merge_reports(m: Model) -> DataFrame:
    rows = m.reports.select("report_id", "launches", "players")
    merged = keys.merge_reports(rows.where("report_id % 3 < 2").drop("players"), rows.where("report_id % 3 >= 1").drop("launches"))
    return merged.select("report_id", "launches", "players")


def _levels(m: Model) -> DataFrame:
    days = series.country_daily(m.events, m.countries).where("n_events > 0")
    return series.densify_levels(days.select("country_id", "activity_date", *spine.COUNTS), "country_id")


def _warehouse(m: Model) -> dict[str, DataFrame]:
    from . import warehouse
    from .scratch import new_path

    root = new_path(m.spark, "warehouse")
    index = keys.stable_index(m.spark.createDataFrame([], "idx long, zone_id long"), m.changelog.select("zone_id"))
    warehouse.write_warehouse(root, m.dim, m.spine, index, spine.zone_day(m.spine), m.stats, m.countries, A.regions(m.spark, m.sf_dir))
    return warehouse.rebuild_warehouse(m.spark, root)


def _warehouse_rows(m: Model) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in _warehouse(m).items()]
    return reduce(DataFrame.unionByName, parts)


def _tiles(m: Model) -> DataFrame:
    return checks.tile_totals(m.dim.groupBy(cell_of("latitude", "longitude").alias("cell")).agg(F.count("*").alias("n_zones")), m.dim)


def _q(build: Callable[[Model], DataFrame]):
    return lambda spark, sf_dir: build(Model(spark, sf_dir))


_BUILD: dict[str, Callable[[Model], DataFrame]] = {
    "event_spine": lambda m: m.spine,
    "dim_zone": lambda m: m.dim,
    "zone_events": lambda m: m.events.select("zone_id", "observed_at", "country_id", "region_id", "total_delta", "is_capture"),
    "current_state": lambda m: spine.current_state(m.spine),
    "checkpoints": lambda m: spine.checkpoints(m.changelog),
    "zone_day": lambda m: spine.zone_day(m.spine),
    "display_day": lambda m: m.display,
    "global_daily": lambda m: series.global_daily(m.spine),
    "country_daily": lambda m: series.country_daily(m.events, m.countries),
    "area_series_country": lambda m: series.area_series(m.events, "country_id"),
    "area_series_region": lambda m: series.area_series(m.events, "region_id"),
    "area_series_cell": lambda m: series.area_series(m.events, "cell"),
    "scope_daily": lambda m: series.scope_daily(spine.since(m.events, "1995-07-01")),
    "densified_country": lambda m: series.densify(series.area_series(m.events, "country_id"), "country_id"),
    "zone_series": lambda m: series.zone_series(m.spine, 7),
    "change_window": lambda m: series.change_window(series.global_daily(m.spine)),
    "net_over": lambda m: series.net_over(series.daily_activity(m.spine), START, DAY),
    "anchors": lambda m: history.anchors(m.display),
    "state_at": lambda m: history.state_at(m.display, DAY),
    "replay": lambda m: history.replay(history.anchors(m.display), m.display, DAY).where("packed IS NOT NULL"),
    "state_step": lambda m: history.step(history.state_at(m.display, START), m.display, START, DAY),
    "flips": lambda m: history.flips(m.display),
    "moved_between": lambda m: history.moved_between(m.display, START, DAY),
    "claimed_since": lambda m: history.claimed_since(history.flips(m.display), START),
    "flip_trail": lambda m: history.flip_trail(history.flips(m.display), DAY),
    "state_totals": lambda m: history.state_totals(history.state_at(m.display, DAY)),
    "occupancy": _occupancy,
    "region_breakdown": lambda m: history.region_breakdown(m.dim, history.state_at(m.display, DAY)),
    "area_index": lambda m: history.area_index(m.dim),
    "paint": lambda m: history.paint(m.dim, m.spine),
    "zone_battles": lambda m: m.battles.select("report_id", "zone_id", "report_date", "launches", "country_id", "region_id"),
    "maz": lambda m: reports.maz(m.battles),
    "maz_stats": lambda m: m.stats,
    "marks": lambda m: reports.marks(m.activity, "2100-01-01", 10),
    "daily_totals": lambda m: m.daily,
    "summary": lambda m: reports.summarize(m.stats, "launches"),
    "log_bins": lambda m: reports.log_bins(m.stats, "launches"),
    "linear_bins": lambda m: reports.linear_bins(m.stats, "launches", 20, 250.0),
    "biggest_reports": lambda m: reports.biggest_reports(m.stats, 200),
    "biggest_days": lambda m: reports.biggest_days(m.stats, 400),
    "faction_daily": lambda m: reports.faction_daily(m.stats, *BAD),
    "fight_shape": lambda m: reports.fight_shape(m.stats, *BAD),
    "streaks": lambda m: reports.longest_streaks(m.activity),
    "appearances": lambda m: reports.appearances(reports.maz(m.battles)),
    "report_days": lambda m: reports.report_days(m.reports),
    "trailing_mean": lambda m: reports.trailing_mean(m.daily),
    "smoothed_shares": lambda m: reports.smoothed_shares(reports.faction_daily(m.stats, *BAD, digits=14)),
    "flashpoint_zone": lambda m: m.members,
    "flashpoint_impact": lambda m: m.impact,
    "flashpoint": lambda m: flashpoints.manifest(m.resolved, m.members, m.impact).select("flashpoint_id", "n_circle", "n_board", "evidence", "changelog_covered"),
    "impact_summary": lambda m: flashpoints.impact_summary(m.resolved, m.impact),
    "circle": lambda m: flashpoints.circle(m.dim, *PLACE),
    "nearest": _nearest,
    "day_pairs": lambda m: geo.day_pairs(m.located).select("report_date", "a", "b", F.round("km", 6).alias("km")),
    "spread": lambda m: geo.spread(geo.day_pairs(m.located)),
    "clusters": lambda m: m.clusters,
    "largest_by_day": lambda m: geo.largest_by_day(m.cluster_sizes),
    "top_clusters": lambda m: geo.top_clusters(m.cluster_sizes),
    "cells_in_circle": _cells,
    "stable_index": _stable_index,
    "merge_events": _merge,
    "upsert_latest": _upsert,
    "plan_days": _plan_days,
    "plan_targets": _targets,
    "links": lambda m: keys.extract_links(m.pages),
    "page_reports": lambda m: P.extract_pages(m.pages),
    "name_blocks": _name_blocks,
    "delta_roundtrip": _delta,
    "export_manifest": _manifest,
    "sparse_series": lambda m: series.sparse_series(series.global_daily(m.spine), series.daily_activity(m.spine), "1995-07-01"),
    "net_since": lambda m: series.net_since(series.global_daily(m.spine), START, DAY),
    "series_for_cells": lambda m: series.series_for_cells(series.area_series(m.events, "cell"), BOX),
    "cluster_record": lambda m: geo.cluster_record(m.battles, m.clusters, m.cluster_sizes),
    "unplaced_reports": lambda m: geo.unplaced_reports(m.reports, m.gapped),
    "impact_series": lambda m: flashpoints.impact_series(m.resolved, m.impact),
    "board_lists": _boards,
    "lookup_json": lambda m: lookups.lookup_json(m.dim, "zone_id", ["zone_name", "region_id"]),
    "lookup_roundtrip": _lookup,
    "search_areas": _search,
    "period_activity": _periods,
    "years_present": lambda m: checks.years_present(m.changelog, "observed_at"),
    "check_freshness": lambda m: checks.freshness(m.changelog, "observed_at", "2001-08-05"),
    "check_tile_totals": _tiles,
    "check_unique_events": lambda m: checks.unique(m.changelog, ["zone_id", "observed_at"]),
    "check_orphans": lambda m: checks.orphans(m.changelog, m.gapped),
    "check_negative_totals": lambda m: checks.no_negative_totals(series.global_daily(m.spine), series.country_daily(m.events, m.countries).drop("country_id")),
    "check_checkpoints": lambda m: checks.one_checkpoint_per_boundary(m.changelog, spine.checkpoints(m.changelog)),
    "check_anchors": lambda m: checks.unresolved_anchors(m.flash, m.dim, m.members),
    "check_tournaments": lambda m: checks.tournament_ids(m.reports).select("report_id"),
    "check_impact_run": lambda m: checks.impact_outside_run(m.resolved, m.impact),
    "check_split": lambda m: checks.split_shortfall(m.reports, *BAD).select("report_id"),
    "check_same_keys": lambda m: checks.same_keys(reports.maz(m.battles), m.stats, ["zone_id", "report_date"]),
    "check_relationship": lambda m: checks.relationship(m.changelog, "zone_id", m.gapped, "warn"),
    "check_not_null": lambda m: checks.not_null(spine.zone_events(m.spine, m.gapped), ["zone_id", "observed_at", "country_id"]),
    "map_rows": lambda m: history.map_rows(m.dim, m.spine),
    "tile_manifest": lambda m: geo.tile_manifest(m.dim, m.spine),
    "area_extent": lambda m: geo.area_extent(m.dim, "country_id"),
    "daily_top": lambda m: reports.daily_top(m.stats, "report_date", "launches", "zone_id", 2).select("report_date", "place", "zone_id", "launches"),
    "per_player": lambda m: reports.per_player(m.stats).select("zone_id", "report_date", "per_player"),
    "count_equal": lambda m: reports.count_equal(m.stats, "launch_1", 0),
    "merge_reports": _merge_reports,
    "densified_levels": _levels,
    "flashpoint_codes": lambda m: flashpoints.codes(m.resolved),
    "warehouse_events": lambda m: _warehouse(m)["zone_event"].select("zone_id", "idx", "seq", "observed_at", "total"),
    "warehouse_rows": _warehouse_rows,
    "check_widths": lambda m: checks.fits(m.stats, {"launches": "uint8", "players": "uint8", "launch_1": "int16"}),
}

QUERIES = {name: _q(build) for name, build in (_BUILD | views.BUILD | model_queries.BUILD | page_queries.BUILD | stream_queries.BUILD).items()}
