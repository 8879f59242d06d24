"""Registered queries of selections, labels and streams, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import checks, flashpoints, geo, history, keys, reports, series
from ..sources import adapters as A
from ..sources import contracts, staging
from ..streaming import deltas, ingest
from . import warehouse
from .oracles import ORACLE as _KNOWN
from .oracles import _km, _with
from .scratch import materialize, new_path

DAYS = ("1996-02-29", "1997-07-15", "1998-06-15", "2000-12-31")
START, DAY, BAD = "1998-01-01", "1998-06-15", ("1997-07-01", "1997-09-11")
VIEW = (0.5, 50.2, 2.5, 51.5)
CIRCLE = (51.0, 1.5, 25.0)
#: The most specific part of each wins: of the first, the zone; of the second, the circle.
SELECTIONS = {
    "zone": {"zone_id": 7, "country_id": 1},
    "circle": {"circle": CIRCLE, "region_id": 7},
    "box": {"box": (0.4, 50.3, 1.6, 51.2)},
    "region": {"region_id": 7, "country_id": 1},
    "country": {"country_id": 1},
    "world": {},
}
SEEDS = "seed_id long, label string, day date, price double"


def _day_functions(m) -> DataFrame:
    days = m.spine.select("activity_date").distinct()
    first = days.agg(F.min("activity_date").alias("first"), F.max("activity_date").alias("newest"))
    rows = days.join(F.broadcast(first))
    return rows.select(
        "activity_date", S.day_no("activity_date").alias("day_no"), S.day_date(S.day_no("activity_date")).alias("back"),
        *(S.window_start(k, "activity_date", "first").alias(f"{k}_start") for k in ("week", "year", "all")),
        S.range_km("activity_date", cutover=START).alias("range_km"), S.in_gap("activity_date", 1997).alias("in_gap"),
        S.last_complete_day("newest", F.lit("2001-08-01").cast("date")).alias("complete"),
    )


def _categories(m) -> DataFrame:
    painted = history.paint(m.dim, m.spine)
    bits = painted.groupBy(S.category_bit("packed", "ever_active").alias("bit"))
    return bits.agg(F.count("*").alias("n_zones"), F.count_if(S.in_categories("packed", "ever_active", 0b01011)).alias("n_shown"))


def _view(m) -> DataFrame:
    inside = m.dim.where(S.in_bounds("latitude", "longitude", *VIEW))
    return inside.select("zone_id", S.region_in("country_id", "region_id", 1).alias("in_country"), S.region_in("country_id", "region_id", 1, 7).alias("in_region"))


def _scopes(m) -> DataFrame:
    picked = {"all": geo.scope(m.dim), "circle": geo.scope(m.dim, "circle", CIRCLE), "active": geo.scope(m.dim, "active", events=m.spine)}
    counted = [df.agg(F.count("*").alias("n_zones"), F.min("zone_id").alias("first"), F.max("zone_id").alias("last")).select(F.lit(kind).alias("kind"), "*") for kind, df in picked.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _growth(m) -> DataFrame:
    daily = series.global_daily(m.spine).select("activity_date", *(F.col(c).cast("double").alias(c) for c in ("legion", "swarm", "faceless")))
    long = daily.unpivot("activity_date", ["legion", "swarm", "faceless"], "faction", "level")
    w = Window.partitionBy("faction").orderBy("activity_date")
    then = F.lag("level", 30).over(w)
    return long.select("faction", "activity_date", F.round(S.growth("level", then), 6).alias("ratio"), S.growth_label("level", then).alias("label"))


def _identity(m) -> DataFrame:
    seen = m.changelog.select("zone_id").distinct()
    named = m.gapped.select("zone_id", "zone_name", F.when(F.col("zone_id") % 13 != 0, F.col("region_name")).alias("region_name"))
    both = seen.join(named, "zone_id", "left")
    return both.select("zone_id", "zone_name", S.identity_label("region_name", F.col("zone_name").isNotNull()).alias("region"))


def _stream_daily(m) -> DataFrame:
    """Events per day and user by a stream: a day counts once an event after its end exists."""
    rows = A.table(m.spark, m.sf_dir, "events")
    events = ingest.drops(m.spark, f"{m.sf_dir}/events.parque[t]", rows.schema, 1 << 20)
    out, checkpoint = new_path(m.spark, "stream_daily"), new_path(m.spark, "stream_checkpoint")
    counts = ingest.daily_counts(events, "user_id", "ts", "0 seconds")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.schema(counts.schema).parquet(out)


def _stream_state(m) -> DataFrame:
    """The newest event of each user, merged batch by batch."""
    rows = A.table(m.spark, m.sf_dir, "events").select("user_id", "ts", "event_id")
    events = ingest.drops(m.spark, f"{m.sf_dir}/events.parque[t]", rows.schema, 1)
    root, checkpoint = new_path(m.spark, "stream_state"), new_path(m.spark, "stream_checkpoint")
    ingest.state_stream(events, root, checkpoint, "ts", "user_id").awaitTermination()
    return ingest.read_state(m.spark, root, rows.schema).select("user_id", "event_id")


def _stream_deltas(m) -> DataFrame:
    """Deltas of each user's events by a stream that meets the odd events after the even ones, in a second run."""
    rows = A.table(m.spark, m.sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("total"))
    drop, out, checkpoint = (new_path(m.spark, f"stream_{kind}") for kind in ("drops", "deltas", "checkpoint"))
    for odd in (0, 1):
        rows.where(F.col("total") % 2 == odd).write.mode("append").parquet(drop)
        given = deltas.corrected_deltas(ingest.drops(m.spark, drop, rows.schema, 1 << 20), "user_id", "ts", keep_days=36_500)
        with deltas.map_state(m.spark):
            given.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return deltas.settled(m.spark.read.schema(given.schema).parquet(out), "user_id", "ts").select("user_id", F.col("total").alias("event_id"), "delta")


def _histories(m) -> DataFrame:
    events = m.events
    grains = {area: materialize(series.area_series(events, area), area) for area in ("cell", "region_id", "country_id")}
    found = [series.history(selection, events, grains).select(F.lit(name).alias("selection"), "*") for name, selection in SELECTIONS.items()]
    return reduce(DataFrame.unionByName, found)


def _display_shards(m) -> DataFrame:
    root = new_path(m.spark, "display")
    display = m.display
    index = keys.stable_index(m.spark.createDataFrame([], "idx long, zone_id long"), display.select("zone_id"))
    warehouse.write_display(root, display, index, "1970-01-01")
    return warehouse.read_display(m.spark, root, first=1997)


def _seeds(m) -> DataFrame:
    """Orders as curated rows, through a CSV file with labels that hold quotes and commas."""
    path = new_path(m.spark, "seeds")
    label = F.concat(F.lit('"'), "o_orderstatus", F.lit('", '), "o_orderpriority")
    rows = A.table(m.spark, m.sf_dir, "orders").select(F.col("o_orderkey").alias("seed_id"), label.alias("label"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    return contracts.read_seeds(m.spark, path, T.StructType.fromDDL(SEEDS))


def _staged(m) -> DataFrame:
    """Leaderboard reports under the source's names and back; columns that the given tables lack are null."""
    held = {"battle_report_number": F.col("report_id"), "zone_id": F.col("zone_id").cast("string"), "battle_date": F.col("report_date"), "total_launches": F.col("launches"), "total_active_players": F.col("players")}
    held |= {f"{f}_total_launches": F.col(f"launch_{k}") for k, f in enumerate(("legion", "swarm", "faceless"), 1)}
    raw = m.reports.select(*(held.get(name, F.lit(None).cast("long")).alias(c) for c, name in staging.REPORTS.items()))
    return staging.stage_reports(raw).select(*held, "is_tournament")


BUILD = {
    "stream_deltas": _stream_deltas,
    "histories": _histories,
    "display_shards": _display_shards,
    "seeds": _seeds,
    "staged_reports": _staged,
    "day_functions": _day_functions,
    "bucket_totals": lambda m: m.display.select(S.magnitude_of("packed").alias("bucket")).distinct().select("bucket", S.approx_total("bucket").alias("total")),
    "category_counts": _categories,
    "zones_in_view": _view,
    "scopes": _scopes,
    "growth": _growth,
    "zone_identity": _identity,
    "bounding_boxes": lambda m: geo.bounding_boxes(m.resolved).select("flashpoint_id", *(F.round(c, 6).alias(c) for c in ("south", "north", "west", "east"))),
    "states_at": lambda m: history.states_at(m.display, m.spark.createDataFrame([(d,) for d in DAYS], "day string").select(F.col("day").cast("date"))),
    "breakdown_rest": lambda m: history.breakdown_rest(m.dim, history.state_at(m.display, DAY), 3),
    "appearance_summary": lambda m: reports.appearance_summary(reports.maz(m.battles)),
    "dropped_days": lambda m: reports.dropped_days(m.stats, *BAD),
    "clusterless_share": lambda m: reports.clusterless_share(m.cluster_sizes),
    "check_coverage": lambda m: checks.coverage_against_evidence(flashpoints.manifest(m.resolved, m.members, m.impact), m.impact),
    "check_partition": lambda m: checks.groups_partition_circle(m.members),
    "check_region_labels": lambda m: checks.unlabelled_regions(m.dim),
    "check_reports_unique": lambda m: checks.unique(m.reports, ["report_date", "zone_id"]),
    "stream_daily_counts": _stream_daily,
    "stream_state": _stream_state,
}

_sub = lambda name: f"({_KNOWN[name]})"

_PICKED = {
    "zone": "zone_id = 7",
    "circle": f"{_km('51.0', '1.5', 'latitude', 'longitude')} <= 25.0",
    "box": "floor(latitude) BETWEEN 50 AND 52 AND floor(longitude) BETWEEN 0 AND 2",
    "region": "region_id = 7",
    "country": "country_id = 1",
    "world": "true",
}
_EACH = " UNION ALL ".join(f"SELECT '{name}' AS selection, * FROM ev WHERE {rule}" for name, rule in _PICKED.items())

ORACLE = {
    "stream_deltas": "SELECT user_id, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY ts) AS delta FROM events",
    "histories": _with("ev days", f"""SELECT selection, activity_date, CAST(sum(coalesce(l, 0)) OVER w AS BIGINT) AS legion, CAST(sum(coalesce(s, 0)) OVER w AS BIGINT) AS swarm, CAST(sum(coalesce(f, 0)) OVER w AS BIGINT) AS faceless
        FROM days CROSS JOIN (SELECT unnest({list(_PICKED)}) AS selection) LEFT JOIN (SELECT selection, activity_date, sum(legion_delta) AS l, sum(swarm_delta) AS s, sum(faceless_delta) AS f FROM ({_EACH}) GROUP BY 1, 2) x USING (selection, activity_date)
        WINDOW w AS (PARTITION BY selection ORDER BY activity_date)"""),
    "display_shards": _with("dd", "SELECT * FROM (SELECT dense_rank() OVER (ORDER BY zone_id) - 1 AS idx, activity_date, packed FROM dd) WHERE year(activity_date) >= 1997"),
    "seeds": "SELECT o_orderkey AS seed_id, '\"' || o_orderstatus || '\", ' || o_orderpriority AS label, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders",
    "staged_reports": _with("rep", """SELECT report_id AS battle_report_number, CAST(zone_id AS INTEGER) AS zone_id, report_date AS battle_date, launches AS total_launches, players AS total_active_players,
        launch_1 AS legion_total_launches, launch_2 AS swarm_total_launches, launch_3 AS faceless_total_launches, is_tournament FROM rep"""),
    "day_functions": _with("sp", f"""SELECT DISTINCT activity_date, CAST(activity_date - DATE '{S.EPOCH}' AS INTEGER) AS day_no, activity_date AS back, greatest(lo, activity_date - 7) AS week_start, greatest(lo, activity_date - 365) AS year_start, lo AS all_start,
        CASE WHEN activity_date >= DATE '{START}' THEN 1609.3 ELSE 643.7 END::DOUBLE AS range_km, year(activity_date) = 1997 AS in_gap, CASE WHEN hi = DATE '2001-08-01' THEN hi - 1 ELSE hi END AS complete
        FROM sp, (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM sp)"""),
    "bucket_totals": _with("dd", "SELECT DISTINCT packed & 63 AS bucket, CAST(CASE WHEN packed & 63 = 0 THEN 0 ELSE round(pow(10.0, ((packed & 63) - 1) / 8.0) - 1) END AS BIGINT) AS total FROM dd"),
    "category_counts": f"""SELECT CAST(CASE WHEN packed <> 0 THEN pow(2, packed >> 6) WHEN ever_active THEN 1 ELSE 16 END AS INTEGER) AS bit, count(*) AS n_zones,
        count(*) FILTER (WHERE (packed <> 0 AND packed >> 6 IN (1, 3)) OR (packed = 0 AND ever_active)) AS n_shown FROM {_sub('paint')} GROUP BY 1""",
    "zones_in_view": _with("dim", "SELECT zone_id, country_id = 1 AS in_country, region_id = 7 AS in_region FROM dim WHERE longitude BETWEEN 0.5 AND 2.5 AND latitude BETWEEN 50.2 AND 51.5"),
    "scopes": _with("dim sp", f"""SELECT 'all' AS kind, count(*) AS n_zones, min(zone_id) AS first, max(zone_id) AS last FROM dim
        UNION ALL SELECT 'circle', count(*), min(zone_id), max(zone_id) FROM dim WHERE {_km('51.0', '1.5', 'latitude', 'longitude')} <= 25.0
        UNION ALL SELECT 'active', count(*), min(zone_id), max(zone_id) FROM dim WHERE zone_id IN (SELECT zone_id FROM sp)"""),
    "growth": f"""WITH g AS (SELECT faction, activity_date, CAST(level AS DOUBLE) AS now, lag(CAST(level AS DOUBLE), 30) OVER (PARTITION BY faction ORDER BY activity_date) AS was FROM (UNPIVOT (SELECT activity_date, legion, swarm, faceless FROM {_sub('global_daily')}) ON legion, swarm, faceless INTO NAME faction VALUE level)),
        r AS (SELECT *, CASE WHEN was <> 0 THEN now / was END AS x FROM g)
        SELECT faction, activity_date, round(x, 6) AS ratio, CASE WHEN abs(x - 1) < 0.0005 THEN 'same' WHEN x >= 10 THEN 'times' WHEN x > 1 THEN 'up' WHEN x IS NOT NULL THEN 'down' END AS label FROM r""",
    "zone_identity": _with("cl gaps", "SELECT zone_id, zone_name, CASE WHEN zone_name IS NOT NULL THEN CASE WHEN zone_id % 13 <> 0 THEN region_name ELSE 'Region not identified' END END AS region FROM (SELECT DISTINCT zone_id FROM cl) LEFT JOIN gaps USING (zone_id)"),
    "bounding_boxes": _with("fr", """SELECT flashpoint_id, round(latitude - up, 6) AS south, round(latitude + up, 6) AS north, round(longitude - up / cos(radians(abs(latitude) + up)), 6) AS west, round(longitude + up / cos(radians(abs(latitude) + up)), 6) AS east
        FROM (SELECT *, radius_km * 1.05 / 111.32 AS up FROM fr)"""),
    "states_at": _with("dd", "SELECT day, zone_id, arg_max(packed, activity_date) AS packed FROM (SELECT CAST(unnest(['" + "', '".join(DAYS) + "']) AS DATE) AS day) JOIN dd ON activity_date <= day GROUP BY 1, 2"),
    "breakdown_rest": _with("dim st", """SELECT country_id, count(*) FILTER (WHERE place > 3) AS n_rest, CAST(coalesce(sum(n) FILTER (WHERE place > 3), 0) AS BIGINT) AS rest_zones, count(*) FILTER (WHERE held = 0) AS n_quiet FROM (
        SELECT country_id, n, held, row_number() OVER (PARTITION BY country_id ORDER BY held DESC, n DESC, region_id) AS place FROM (SELECT country_id, region_id, count(*) AS n, count(*) FILTER (WHERE coalesce(packed, 0) >> 6 > 0) AS held FROM dim LEFT JOIN st USING (zone_id) GROUP BY 1, 2)) GROUP BY 1"""),
    "appearance_summary": f"SELECT count(*) AS n_keys, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS share_once, arg_min(zone_id, (-n, zone_id)) AS leader, max(n) AS leader_n FROM {_sub('appearances')}",
    "dropped_days": _with("ms", f"SELECT count(*) FILTER (WHERE d BETWEEN DATE '{BAD[0]}' AND DATE '{BAD[1]}') AS n_dropped, count(*) FILTER (WHERE d NOT BETWEEN DATE '{BAD[0]}' AND DATE '{BAD[1]}') AS n_kept FROM (SELECT DISTINCT report_date AS d FROM ms)"),
    "clusterless_share": _with("cs", "SELECT count(*) AS n_days, count(*) FILTER (WHERE most < 4) AS n_without, round(count(*) FILTER (WHERE most < 4) / count(*), 6) AS share FROM (SELECT report_date, max(n_zones) AS most FROM cs GROUP BY 1)"),
    "check_coverage": f"SELECT flashpoint_id, changelog_covered, evidence > 0 AS seen FROM {_sub('flashpoint')} WHERE changelog_covered <> (evidence > 0)",
    "check_partition": _with("fz", "SELECT flashpoint_id, zone_id, count(*) AS n, count(on_the_board) AS n_grouped FROM fz GROUP BY 1, 2 HAVING count(*) <> 1 OR count(on_the_board) <> count(*)"),
    "check_region_labels": _with("dim", "SELECT region_id, count(*) AS n_zones, count(DISTINCT region_name) AS n_labels FROM dim GROUP BY 1 HAVING count(DISTINCT region_name) <> 1"),
    "check_reports_unique": _with("rep", "SELECT report_date, zone_id, count(*) AS n FROM rep GROUP BY 1, 2 HAVING count(*) > 1"),
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
    "stream_state": "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1",
}
