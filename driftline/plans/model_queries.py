"""Registered queries: sets of claimed zones, ordered clusters, JSON exports, files of the warehouse, checks of incidents; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tile_of
from ..operators import checks, export, flashpoints, geo, history, idsets, keys, reports, series, spine
from . import warehouse
from .oracles import ORACLE as _KNOWN
from .oracles import _with
from .scratch import new_path

START, DAYS = "1998-01-01", ("1998-01-31", "1999-06-15", "2001-12-31")
LEVELS = spine.COUNTS


def _claimed(m) -> DataFrame:
    """Counts by merging sets that were built for odd and even days apart."""
    flipped = history.flips(m.display).where(F.col("activity_date") >= F.lit(START).cast("date"))
    parts = [idsets.id_sets(flipped.where(F.dayofmonth("activity_date") % 2 == k), ["activity_date"]) for k in (0, 1)]
    merged = idsets.merge_sets(*parts, by=["activity_date"])
    return idsets.claimed_counts(idsets.running_sets(merged, "activity_date"))


def _claimed_on(m) -> DataFrame:
    claimed = idsets.claimed_sets(history.flips(m.display), START)
    found = [idsets.members(idsets.sets_on(claimed, "activity_date", d)).select(F.lit(d).cast("date").alias("day"), "zone_id") for d in DAYS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _manifest(m) -> DataFrame:
    path = new_path(m.spark, "manifest")
    export.write_manifest(export.manifest(m.dim, m.spine), path)
    flat = export.read_manifest(m.spark, path)
    return flat.select(F.col("scope.zones").alias("n_zones"), F.col("scope.ever_active").alias("n_ever_active"), F.col("days.first").alias("first_day"), F.col("days.last").alias("last_day"), F.col("events").alias("n_events"), *(F.col(f"current.{c}").alias(c) for c in LEVELS), F.col("current.held").alias("n_held"))


def _series(m) -> DataFrame:
    """The sparse global series, a JSON object a year, and back."""
    rows = series.sparse_series(series.global_daily(m.spine), series.daily_activity(m.spine), "1995-07-01")
    return export.read_series(export.series_json(rows, [F.year("activity_date").alias("year")])).select("year", "activity_date", *LEVELS)


def _areas(m) -> DataFrame:
    """The JSON lines of all countries themselves."""
    days = series.country_daily(m.events, m.countries).where("n_events > 0")
    lines = export.series_json(days, ["country_id"])
    return lines.select("country_id", F.length("series").cast("long").alias("n_chars"), F.sha2("series", 256).alias("digest"))


def _written(m) -> str:
    root = new_path(m.spark, "warehouse")
    index = keys.stable_index(m.spark.createDataFrame([], "idx long, zone_id long"), m.changelog.select("zone_id"))
    warehouse.write_warehouse(root, m.dim, m.spine, index, spine.zone_day(m.spine), m.stats, m.countries, m.dim.select("region_id", "region_name").distinct())
    return root


def _tiles(m) -> DataFrame:
    root = new_path(m.spark, "tiles")
    warehouse.write_sharded(m.dim.withColumn("tile", tile_of("latitude", "longitude")), root, *warehouse.LAYOUT["zone"])
    return export.file_places(m.spark, root, "tile").select("tile", "place", "zone_id", "zone_name", "country_id")


def _days(m) -> DataFrame:
    return warehouse.rebuild_warehouse(m.spark, _written(m))["zone_day"].select("zone_id", "activity_date", "n_events", "total", "step")


def _order(m) -> DataFrame:
    root = _written(m)
    found = [export.out_of_order(m.spark, f"{root}/{name}", shard, order).agg(F.count("*").alias("n_wrong")).select(F.lit(name).alias("name"), "n_wrong") for name, (shard, order) in warehouse.LAYOUT.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _board(m) -> DataFrame:
    index = keys.stable_index(m.spark.createDataFrame([], "idx long, zone_id long"), m.dim.select("zone_id"))
    return checks.board_faults(m.boards(index), index, m.members, m.resolved, m.battles)


BUILD = {
    "claimed_sets": _claimed,
    "claimed_on": _claimed_on,
    "cluster_order": lambda m: geo.cluster_order(m.clusters, m.cluster_sizes, m.battles).select("report_date", "zone_id", "cluster", "place", "n_zones", "diameter"),
    "clusters_of_four": lambda m: geo.top_clusters(m.cluster_sizes, 4),
    "maz_range": lambda m: reports.maz_range(m.battles),
    "maz_range_country": lambda m: reports.maz_range(m.battles, ["country_id"]),
    "manifest_json": _manifest,
    "series_json": _series,
    "area_series_json": _areas,
    "tile_places": _tiles,
    "warehouse_days": _days,
    "warehouse_order": _order,
    "check_spine_coverage": lambda m: checks.coverage_against_spine(flashpoints.manifest(m.resolved, m.members, m.impact), m.resolved, m.members, m.spine),
    "check_board": _board,
    "check_codes": lambda m: checks.code_faults(flashpoints.codes(m.resolved), m.codes),
    "check_launches": lambda m: checks.fits(m.stats, {c: "uint31" for c in ("launches", "players", *reports.LAUNCHES)}),
}

_FIRST = f"SELECT zone_id, min(activity_date) AS activity_date FROM fl WHERE activity_date >= DATE '{START}' GROUP BY 1"
_JSON = "'{\"day\":[' || string_agg('\"' || activity_date || '\"', ',' ORDER BY activity_date) || ']' || " + " || ".join(f"',\"{c}\":[' || string_agg({c}, ',' ORDER BY activity_date) || ']'" for c in LEVELS) + " || '}'"
ORACLE = {
    "claimed_sets": _KNOWN["claimed_since"],
    "claimed_on": _with("fl", f"SELECT day, zone_id FROM (SELECT CAST(unnest(['{DAYS[0]}', '{DAYS[1]}', '{DAYS[2]}']) AS DATE) AS day) JOIN ({_FIRST}) ON activity_date <= day"),
    "cluster_order": _with("cu cs ba", """SELECT report_date, zone_id, cluster, CAST(place AS INTEGER) AS place, n_zones, diameter FROM cu JOIN (
        SELECT report_date, cluster, n_zones, diameter, row_number() OVER (PARTITION BY report_date ORDER BY n_zones DESC, first) AS place
        FROM cs JOIN (SELECT report_date, cluster, min(report_id) AS first FROM cu JOIN ba USING (report_date, zone_id) GROUP BY 1, 2) USING (report_date, cluster)) USING (report_date, cluster)"""),
    "clusters_of_four": _with("cs", "SELECT * FROM cs WHERE n_zones >= 4 ORDER BY n_zones DESC, diameter, report_date, cluster LIMIT 14"),
    "maz_range": _with("ba", "SELECT count(*) AS n_entries, min(report_date) AS first_day, max(report_date) AS last_day FROM (SELECT DISTINCT zone_id, report_date FROM ba)"),
    "maz_range_country": _with("ba", "SELECT country_id, count(*) AS n_entries, min(report_date) AS first_day, max(report_date) AS last_day FROM (SELECT DISTINCT country_id, zone_id, report_date FROM ba) GROUP BY 1"),
    "manifest_json": _KNOWN["export_manifest"],
    "series_json": f"SELECT CAST(year(activity_date) AS INTEGER) AS year, * FROM ({_KNOWN['sparse_series']})",
    "area_series_json": f"SELECT country_id, length(s) AS n_chars, sha256(s) AS digest FROM (SELECT country_id, {_JSON} AS s FROM ({_KNOWN['country_daily']}) WHERE n_events > 0 GROUP BY 1)",
    "tile_places": _with("dim", """SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY latitude, longitude, zone_id) AS INTEGER) AS place, zone_id, zone_name, country_id
        FROM (SELECT *, CAST(floor((latitude + 90) / 16) * 23 + floor((longitude + 180) / 16) AS INTEGER) AS tile FROM dim)"""),
    "warehouse_days": _KNOWN["zone_day"],
    "warehouse_order": "SELECT unnest(['zone', 'zone_event', 'zone_day', 'maz']) AS name, CAST(0 AS BIGINT) AS n_wrong",
    "check_spine_coverage": _with("fz fr sp", f"""SELECT flashpoint_id, changelog_covered, seen FROM ({_KNOWN['flashpoint']}) JOIN (
        SELECT fr.flashpoint_id, EXISTS (SELECT 1 FROM sp JOIN fz USING (zone_id) WHERE fz.flashpoint_id = fr.flashpoint_id AND on_the_board AND activity_date BETWEEN run_start AND run_end) AS seen FROM fr) USING (flashpoint_id) WHERE changelog_covered <> seen"""),
    "check_board": _with("fr fz ba", """SELECT flashpoint_id, CAST(NULL AS BIGINT) AS idx, 'outside the run' AS problem FROM fr WHERE board_start < run_start OR board_end > run_end
        UNION ALL SELECT flashpoint_id, zone_id, 'not on the board' FROM fz JOIN fr USING (flashpoint_id) WHERE on_the_board AND NOT EXISTS (SELECT 1 FROM ba WHERE ba.zone_id = fz.zone_id AND report_date BETWEEN board_start AND board_end)"""),
    "check_codes": _with("fr", "SELECT CAST(0 AS INTEGER) AS code, 'gap' AS problem FROM fr GROUP BY flashpoint_id HAVING count(*) > 1"),
    "check_launches": _with("ms", 'SELECT \'launches\' AS "column", min(launches) AS lo, max(launches) AS hi, CAST(0 AS BIGINT) AS least, CAST(2147483647 AS BIGINT) AS most FROM ms HAVING min(least(launches, players, launch_1, launch_2, launch_3)) < 0 OR max(launches) > 2147483647'),
}
