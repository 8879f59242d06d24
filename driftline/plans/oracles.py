"""SQL that computes what the queries compute, written from the definitions."""

from __future__ import annotations

from ..sources.adapters import FLASHPOINTS

_D, _S = "DATE '1998-06-15'", "DATE '1998-01-01'"
_BAD = "report_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-11'"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _km(a: str, b: str, c: str, d: str) -> str:
    return _KM.format(a=a, b=b, c=c, d=d)


_SUMS = ", ".join(f"CAST(sum({c}_delta) AS BIGINT) AS {c}_delta" for c in ("legion", "swarm", "faceless"))
_FLASH = ", ".join(f"('{i}', '{lbl.replace(chr(39), chr(39) * 2)}', {z}, DATE '{a}', DATE '{b}', DATE '{c}', DATE '{d}', {r}::DOUBLE)" for i, lbl, z, a, b, c, d, r in FLASHPOINTS)

_CTES = {
    "cl": ("", """SELECT o_custkey AS zone_id, CAST(o_orderdate AS TIMESTAMP) + to_microseconds(o_orderkey) AS observed_at, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 4 AS control_state,
        CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) % 997 END AS legion,
        CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey * 7 % 997 END AS swarm, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey * 13 % 997 END AS faceless FROM orders"""),
    "sp0": ("cl", """SELECT *, legion - lag(legion, 1, 0) OVER w AS legion_delta, swarm - lag(swarm, 1, 0) OVER w AS swarm_delta, faceless - lag(faceless, 1, 0) OVER w AS faceless_delta,
        lag(control_state) OVER w AS prev_state, row_number() OVER w = 1 AS is_first FROM cl WINDOW w AS (PARTITION BY zone_id ORDER BY observed_at)"""),
    "sp": ("sp0", "SELECT *, legion + swarm + faceless AS total, legion_delta + swarm_delta + faceless_delta AS total_delta, coalesce(control_state, 0) IS DISTINCT FROM coalesce(prev_state, 0) AS is_capture, CAST(observed_at AS DATE) AS activity_date FROM sp0"),
    "dim": ("", """SELECT c_custkey AS zone_id, c_name AS zone_name, z.country_id, r_name AS country_name, c_nationkey AS region_id, n_name AS region_name,
        50 + (c_custkey * 7919 % 200) / 100.0::DOUBLE AS latitude, (c_custkey * 104729 % 300) / 100.0::DOUBLE AS longitude
        FROM (SELECT *, CAST(CASE WHEN c_custkey % 50 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS INTEGER) AS country_id FROM customer JOIN nation ON c_nationkey = n_nationkey) z
        JOIN region ON r_regionkey = z.country_id"""),
    "gaps": ("dim", "SELECT * FROM dim WHERE zone_id % 97 <> 0"),
    "ev": ("sp dim", "SELECT sp.*, country_id, region_id, latitude, longitude FROM sp LEFT JOIN dim USING (zone_id)"),
    "last": ("sp", "SELECT zone_id, activity_date, control_state, legion, swarm, faceless, total, count(*) OVER (PARTITION BY zone_id, activity_date) AS n_events FROM sp QUALIFY row_number() OVER (PARTITION BY zone_id, activity_date ORDER BY observed_at DESC) = 1"),
    "dd": ("last", """SELECT zone_id, activity_date, CAST(CASE WHEN total <= 0 THEN 0 ELSE 64 * (CASE WHEN CASE control_state WHEN 1 THEN legion WHEN 2 THEN swarm WHEN 3 THEN faceless END = greatest(legion, swarm, faceless) THEN control_state
        WHEN legion = greatest(legion, swarm, faceless) THEN 1 WHEN swarm = greatest(legion, swarm, faceless) THEN 2 ELSE 3 END) + least(63, 1 + round(log10(total + 1) * 8)) END AS INTEGER) AS packed FROM last"""),
    "st": ("dd", f"SELECT zone_id, arg_max(packed, activity_date) AS packed FROM dd WHERE activity_date <= {_D} GROUP BY 1"),
    "fl": ("dd", "SELECT zone_id, activity_date, f0 AS from_faction, f1 AS to_faction FROM (SELECT *, packed >> 6 AS f1, lag(packed >> 6, 1, 0) OVER (PARTITION BY zone_id ORDER BY activity_date) AS f0 FROM dd) WHERE f0 <> f1"),
    "days": ("sp", "SELECT CAST(unnest(generate_series(min(activity_date), max(activity_date), INTERVAL 1 DAY)) AS DATE) AS activity_date FROM sp"),
    "gd": ("sp days", """SELECT activity_date, n_events, n_captures, CAST(sum(l) OVER w AS BIGINT) AS legion, CAST(sum(s) OVER w AS BIGINT) AS swarm, CAST(sum(f) OVER w AS BIGINT) AS faceless FROM (
        SELECT d.activity_date, count(zone_id) AS n_events, count(*) FILTER (WHERE is_capture) AS n_captures, coalesce(sum(legion_delta), 0) AS l, coalesce(sum(swarm_delta), 0) AS s, coalesce(sum(faceless_delta), 0) AS f
        FROM days d LEFT JOIN sp ON sp.activity_date = d.activity_date GROUP BY 1) WINDOW w AS (ORDER BY activity_date)"""),
    "cd": ("ev days", """SELECT country_id, activity_date, n_events, n_captures, CAST(sum(l) OVER w AS BIGINT) AS legion, CAST(sum(s) OVER w AS BIGINT) AS swarm, CAST(sum(f) OVER w AS BIGINT) AS faceless FROM (
        SELECT r_regionkey AS country_id, d.activity_date, count(zone_id) AS n_events, count(*) FILTER (WHERE is_capture) AS n_captures, coalesce(sum(legion_delta), 0) AS l, coalesce(sum(swarm_delta), 0) AS s, coalesce(sum(faceless_delta), 0) AS f
        FROM days d CROSS JOIN region LEFT JOIN ev ON ev.activity_date = d.activity_date AND ev.country_id = r_regionkey GROUP BY 1, 2) WINDOW w AS (PARTITION BY country_id ORDER BY activity_date)"""),
    "lines": ("", "SELECT l_orderkey, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS a, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS r FROM lineitem GROUP BY 1"),
    "rep": ("lines", """SELECT *, zone_id < 0 AS is_tournament FROM (SELECT o_orderkey AS report_id, CASE WHEN o_custkey % 31 = 0 THEN -o_custkey ELSE o_custkey END AS zone_id, CAST(o_orderdate AS DATE) AS report_date,
        coalesce(a, 0) AS launch_1, coalesce(n, 0) AS launch_2, coalesce(r, 0) AS launch_3, coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0) AS launches, o_orderkey % 7 + 1 AS players FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)
        QUALIFY row_number() OVER (PARTITION BY report_date ORDER BY launches DESC, report_id) <= 10"""),
    "ba": ("rep dim", "SELECT rep.*, country_id, region_id, latitude, longitude FROM rep JOIN dim USING (zone_id) WHERE NOT is_tournament"),
    "ms": ("ba", "SELECT zone_id, report_date, max(launches) AS launches, max(players) AS players, max(launch_1) AS launch_1, max(launch_2) AS launch_2, max(launch_3) AS launch_3 FROM ba GROUP BY 1, 2"),
    "dt": ("ms", "SELECT report_date, CAST(sum(launches) AS BIGINT) AS total, count(*) AS n_reports, round(sum(launches) / count(*), 6) AS per_report FROM ms GROUP BY 1"),
    "fd": ("ms", f"SELECT report_date, a / (a + b + c) AS share_1, b / (a + b + c) AS share_2, c / (a + b + c) AS share_3 FROM (SELECT report_date, sum(launch_1) AS a, sum(launch_2) AS b, sum(launch_3) AS c FROM ms WHERE NOT {_BAD} GROUP BY 1) WHERE a + b + c > 0"),
    "ac": ("", "SELECT DISTINCT user_id AS zone_id, CAST(ts AS DATE) AS day FROM events"),
    "fp": ("", f"SELECT * FROM (VALUES {_FLASH}) t(flashpoint_id, label, anchor, board_start, board_end, run_start, run_end, radius_km)"),
    "fr": ("fp dim", "SELECT fp.*, latitude, longitude FROM fp JOIN dim ON zone_id = anchor"),
    "fz": ("fr ba dim", f"""SELECT flashpoint_id, zone_id, round(km, 6) AS km, EXISTS (SELECT 1 FROM ba WHERE ba.zone_id = c.zone_id AND report_date BETWEEN board_start AND board_end) AS on_the_board
        FROM (SELECT fr.*, dim.zone_id, {_km('fr.latitude', 'fr.longitude', 'dim.latitude', 'dim.longitude')} AS km FROM fr, dim) c WHERE km <= radius_km"""),
    "fi": ("fz fr sp", "SELECT flashpoint_id, activity_date, on_the_board, CAST(sum(total_delta) AS BIGINT) AS net_delta, count(DISTINCT zone_id) AS zones_moving, count(*) AS n_events FROM fz JOIN fr USING (flashpoint_id) JOIN sp USING (zone_id) WHERE activity_date BETWEEN run_start AND run_end GROUP BY 1, 2, 3"),
    "loc": ("ba", "SELECT DISTINCT report_date, zone_id, latitude, longitude FROM ba"),
    "dp": ("loc", f"SELECT a.report_date, a.zone_id AS a, b.zone_id AS b, {_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km FROM loc a JOIN loc b ON a.report_date = b.report_date AND a.zone_id < b.zone_id"),
    "reach": ("loc dp", "SELECT report_date, zone_id, zone_id AS root FROM loc UNION SELECT r.report_date, CASE WHEN r.zone_id = a THEN b ELSE a END, root FROM reach r JOIN dp ON dp.report_date = r.report_date AND (dp.a = r.zone_id OR dp.b = r.zone_id) AND km <= 48.28032"),
    "cu": ("reach", "SELECT report_date, zone_id, min(root) AS cluster FROM reach GROUP BY 1, 2"),
    "cs": ("cu dp", """SELECT report_date, cluster, count(*) AS n_zones, round(coalesce((SELECT max(km) FROM dp JOIN cu x ON x.report_date = dp.report_date AND x.zone_id = a JOIN cu y ON y.report_date = dp.report_date AND y.zone_id = b
        WHERE dp.report_date = cu.report_date AND x.cluster = cu.cluster AND y.cluster = cu.cluster), 0), 6) AS diameter FROM cu GROUP BY 1, 2"""),
}


def _with(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _CTES[name][0].split():
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + body


def _area(col: str) -> str:
    return _with("ev", f"SELECT {col}, activity_date, {_SUMS} FROM ev WHERE latitude IS NOT NULL GROUP BY ALL HAVING sum(legion_delta) <> 0 OR sum(swarm_delta) <> 0 OR sum(faceless_delta) <> 0")


ORACLE = {
    "event_spine": _with("sp", "SELECT * FROM sp"),
    "dim_zone": _with("dim", "SELECT * FROM dim"),
    "zone_events": _with("ev", "SELECT zone_id, observed_at, country_id, region_id, total_delta, is_capture FROM ev"),
    "current_state": _with("sp", "SELECT zone_id, control_state, legion, swarm, faceless, observed_at FROM sp QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY observed_at DESC) = 1"),
    "checkpoints": _with("cl", """SELECT zone_id, CAST(y AS INTEGER) AS boundary_year, observed_at, control_state, legion, swarm, faceless FROM (SELECT *, lead(observed_at) OVER (PARTITION BY zone_id ORDER BY observed_at) AS n FROM cl) e
        JOIN (SELECT unnest(generate_series((SELECT min(year(observed_at)) + 1 FROM cl), (SELECT max(year(observed_at)) FROM cl))) AS y) ON observed_at < make_timestamp(y, 1, 1, 0, 0, 0) AND (n IS NULL OR n >= make_timestamp(y, 1, 1, 0, 0, 0))"""),
    "zone_day": _with("last", "SELECT zone_id, activity_date, n_events, total, total - lag(total, 1, 0) OVER (PARTITION BY zone_id ORDER BY activity_date) AS step FROM last"),
    "display_day": _with("dd", "SELECT * FROM dd"),
    "global_daily": _with("gd", "SELECT * FROM gd"),
    "country_daily": _with("cd", "SELECT * FROM cd"),
    "area_series_country": _area("country_id"),
    "area_series_region": _area("region_id"),
    "area_series_cell": _area("CAST(floor(latitude + 90) * 360 + floor(longitude + 180) AS INTEGER) AS cell"),
    "scope_daily": _with("ev", "SELECT activity_date, CAST(sum(sum(legion_delta)) OVER w AS BIGINT) AS legion, CAST(sum(sum(swarm_delta)) OVER w AS BIGINT) AS swarm, CAST(sum(sum(faceless_delta)) OVER w AS BIGINT) AS faceless FROM ev WHERE latitude IS NOT NULL AND activity_date >= DATE '1995-07-01' GROUP BY 1 WINDOW w AS (ORDER BY activity_date)"),
    "densified_country": _with("cd ev", "SELECT country_id, activity_date, legion, swarm, faceless FROM cd WHERE activity_date BETWEEN (SELECT min(activity_date) FROM ev WHERE country_id IS NOT NULL AND total_delta <> 0) AND (SELECT max(activity_date) FROM ev WHERE country_id IS NOT NULL AND (legion_delta <> 0 OR swarm_delta <> 0 OR faceless_delta <> 0))"),
    "zone_series": _with("last days", "SELECT d.activity_date, (SELECT arg_max(total, activity_date) FROM last WHERE zone_id = 7 AND last.activity_date <= d.activity_date) AS total FROM days d WHERE d.activity_date >= (SELECT min(activity_date) FROM last WHERE zone_id = 7)"),
    "change_window": _with("gd", "SELECT a.activity_date, a.legion, a.swarm, a.faceless, a.legion - b.legion AS legion_change, a.swarm - b.swarm AS swarm_change, a.faceless - b.faceless AS faceless_change FROM gd a LEFT JOIN gd b ON b.activity_date = a.activity_date - 365"),
    "net_over": _with("sp", f"SELECT {_SUMS} FROM sp WHERE activity_date BETWEEN {_S} AND {_D}"),
    "anchors": _with("dd", "SELECT zone_id, CAST(y AS INTEGER) AS year, packed FROM (SELECT zone_id, y, arg_max(packed, activity_date) AS packed FROM dd JOIN (SELECT unnest(generate_series(1996, (SELECT max(year(activity_date)) FROM dd))) AS y) ON activity_date < make_date(y, 1, 1) GROUP BY 1, 2) WHERE packed <> 0"),
    "state_at": _with("st", "SELECT * FROM st"),
    "replay": _with("st dd", f"SELECT * FROM st WHERE packed <> 0 OR zone_id IN (SELECT zone_id FROM dd WHERE activity_date BETWEEN {_S} AND {_D})"),
    "state_step": _with("st", "SELECT * FROM st"),
    "flips": _with("fl", "SELECT * FROM fl"),
    "moved_between": _with("dd", f"SELECT DISTINCT zone_id FROM dd WHERE activity_date > {_S} AND activity_date <= {_D}"),
    "claimed_since": _with("fl", f"SELECT activity_date, count(*) AS n_new, CAST(sum(count(*)) OVER (ORDER BY activity_date) AS BIGINT) AS n_claimed FROM (SELECT zone_id, min(activity_date) AS activity_date FROM fl WHERE activity_date >= {_S} GROUP BY 1) GROUP BY 1"),
    "flip_trail": _with("fl", f"SELECT *, round(1 - ({_D} - activity_date) / 5.0::DOUBLE, 6) AS weight FROM fl WHERE activity_date > {_D} - 5 AND activity_date <= {_D}"),
    "state_totals": _with("st", "SELECT packed >> 6 AS faction, count(*) AS n_zones FROM st GROUP BY 1"),
    "occupancy": _with("st dim", "SELECT CASE WHEN packed IS NULL THEN 'never' WHEN packed = 0 THEN 'emptied' ELSE 'held' END AS occupancy, count(*) AS n_zones FROM dim LEFT JOIN st USING (zone_id) GROUP BY 1"),
    "region_breakdown": _with("st dim", """SELECT country_id, region_id, n_zones, n_held, n_1, n_2, n_3, CAST(CASE WHEN n_held = 0 THEN 0 WHEN n_1 = greatest(n_1, n_2, n_3) THEN 1 WHEN n_2 = greatest(n_1, n_2, n_3) THEN 2 ELSE 3 END AS INTEGER) AS lead_faction,
        CAST(row_number() OVER (PARTITION BY country_id ORDER BY n_held DESC, n_zones DESC, region_id) AS INTEGER) AS place FROM (SELECT country_id, region_id, count(*) AS n_zones, count(*) FILTER (WHERE packed >= 64) AS n_held, count(*) FILTER (WHERE packed >> 6 = 1) AS n_1, count(*) FILTER (WHERE packed >> 6 = 2) AS n_2, count(*) FILTER (WHERE packed >> 6 = 3) AS n_3 FROM dim LEFT JOIN st USING (zone_id) GROUP BY 1, 2) QUALIFY place <= 10"""),
    "area_index": _with("dim", "SELECT 'country' AS kind, country_id AS area_id, count(*) AS n_zones FROM dim GROUP BY 2 UNION ALL SELECT 'region', region_id, count(*) FROM dim GROUP BY 2"),
    "paint": _with("dd dim", "SELECT zone_id, packed IS NOT NULL AS ever_active, coalesce(packed, 0) AS packed FROM dim LEFT JOIN (SELECT zone_id, arg_max(packed, activity_date) AS packed FROM dd GROUP BY 1) USING (zone_id)"),
    "zone_battles": _with("ba", "SELECT report_id, zone_id, report_date, launches, country_id, region_id FROM ba"),
    "maz": _with("ba", "SELECT DISTINCT zone_id, report_date FROM ba"),
    "maz_stats": _with("ms", "SELECT * FROM ms"),
    "marks": _with("ac", "SELECT zone_id, count(*) AS n, max(day = d) AS fresh, round(least(1.0, ln(1 + count(*)) / ln(31.0::DOUBLE)), 6) AS weight FROM ac, (SELECT max(day) AS d FROM ac) WHERE day >= d - 10 GROUP BY 1"),
    "daily_totals": _with("dt", "SELECT * FROM dt"),
    "summary": _with("ms", """SELECT n, v[1]::DOUBLE AS lo, v[least(n // 2, n - 1) + 1]::DOUBLE AS median, v[least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1]::DOUBLE AS p90, v[least(CAST(floor(n * 0.99) AS BIGINT), n - 1) + 1]::DOUBLE AS p99, v[n]::DOUBLE AS hi, round(list_sum(v) / n, 6) AS mean FROM (SELECT list(launches ORDER BY launches) AS v, count(*) AS n FROM ms)"""),
    "log_bins": _with("ms", """SELECT CAST(b AS BIGINT) AS bin, count(launches) AS n FROM (SELECT unnest(generate_series(0, (SELECT CAST(greatest(0, ceil(log10(max(launches)) * 8)) AS BIGINT) FROM ms))) AS b) LEFT JOIN ms ON b = CASE WHEN launches <= 1 THEN 0 ELSE floor(log10(launches) * 8) END GROUP BY 1"""),
    "linear_bins": _with("ms", "SELECT CAST(b AS INTEGER) AS bin, count(launches) AS n FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN ms ON b = least(19, floor(launches / 250.0::DOUBLE * 20)) GROUP BY 1"),
    "biggest_reports": _with("ms", "SELECT zone_id, report_date, launches, players, round(launches / players, 6) AS per_player FROM ms WHERE launches >= 200"),
    "biggest_days": _with("ms", "SELECT report_date, CAST(sum(launches) AS BIGINT) AS launches, CAST(sum(players) AS BIGINT) AS players, count(*) AS n_reports FROM ms GROUP BY 1 HAVING sum(launches) >= 400"),
    "faction_daily": _with("fd", "SELECT report_date, round(share_1, 6) AS share_1, round(share_2, 6) AS share_2, round(share_3, 6) AS share_3 FROM fd"),
    "fight_shape": _with("ms", f"SELECT count(*) AS n, count(*) FILTER (WHERE greatest(launch_1, launch_2, launch_3) = t) AS n_one_sided, count(*) FILTER (WHERE least(launch_1, launch_2, launch_3) > 0) AS n_three_way, round(avg(greatest(launch_1, launch_2, launch_3) / t), 6) AS mean_dominance FROM (SELECT *, launch_1 + launch_2 + launch_3 AS t FROM ms WHERE NOT {_BAD}) WHERE t > 0"),
    "streaks": _with("ac", "SELECT zone_id, max(n) AS longest FROM (SELECT zone_id, g, count(*) AS n FROM (SELECT zone_id, day - CAST(row_number() OVER (PARTITION BY zone_id ORDER BY day) AS INTEGER) AS g FROM ac) GROUP BY 1, 2) GROUP BY 1"),
    "appearances": _with("ba", "SELECT zone_id, count(DISTINCT report_date) AS n FROM ba GROUP BY 1"),
    "report_days": _with("rep", "SELECT count(*) AS n_days, count(*) FILTER (WHERE n = 10) AS n_full, min(n) AS least, max(n) AS most FROM (SELECT report_date, count(*) AS n FROM rep GROUP BY 1)"),
    "trailing_mean": _with("dt", "SELECT report_date, round(m, 6) AS mean FROM (SELECT report_date, avg(total) OVER (ORDER BY report_date ROWS 29 PRECEDING) AS m, row_number() OVER (ORDER BY report_date) AS k, count(*) OVER () AS c FROM dt) WHERE k >= 30 AND c > 30"),
    "smoothed_shares": _with("fd", "SELECT report_date, round(a / (a + b + c), 6) AS share_1, round(b / (a + b + c), 6) AS share_2, round(c / (a + b + c), 6) AS share_3 FROM (SELECT report_date, avg(share_1) OVER w AS a, avg(share_2) OVER w AS b, avg(share_3) OVER w AS c FROM fd WINDOW w AS (ORDER BY report_date ROWS 29 PRECEDING))"),
    "flashpoint_zone": _with("fz", "SELECT * FROM fz"),
    "flashpoint_impact": _with("fi", "SELECT * FROM fi"),
    "flashpoint": _with("fr fz fi", """SELECT flashpoint_id, count(zone_id) AS n_circle, count(*) FILTER (WHERE on_the_board) AS n_board, CAST(any_value(e) AS BIGINT) AS evidence, any_value(e) > 0 AS changelog_covered
        FROM (SELECT fr.flashpoint_id, fz.zone_id, on_the_board, coalesce((SELECT sum(n_events) FROM fi WHERE fi.flashpoint_id = fr.flashpoint_id AND fi.on_the_board), 0) AS e FROM fr LEFT JOIN fz USING (flashpoint_id)) GROUP BY 1"""),
    "impact_summary": _with("fi fr", """SELECT flashpoint_id, on_the_board, CAST(b AS BIGINT) AS before, CAST(d AS BIGINT) AS during, CAST(a AS BIGINT) AS after, br AS before_rate, dr AS during_rate, CASE WHEN abs(b) > 1000 AND sign(b) = sign(d) THEN round(dr / br, 6) END AS multiple, sign(b) * sign(d) < 0 AS flipped FROM (
        SELECT *, CASE WHEN d0 > 0 THEN round(b / d0, 6) END AS br, CASE WHEN d1 > 0 THEN round(d / d1, 6) END AS dr FROM (SELECT flashpoint_id, on_the_board, coalesce(sum(net_delta) FILTER (WHERE activity_date < board_start), 0) AS b, coalesce(sum(net_delta) FILTER (WHERE activity_date BETWEEN board_start AND board_end), 0) AS d,
        coalesce(sum(net_delta) FILTER (WHERE activity_date > board_end), 0) AS a, any_value(board_start - run_start) AS d0, any_value(board_end - board_start + 1) AS d1 FROM fi JOIN fr USING (flashpoint_id) GROUP BY 1, 2))"""),
    "circle": _with("dim", f"SELECT zone_id, round(km, 6) AS km FROM (SELECT zone_id, {_km('51.0', '1.5', 'latitude', 'longitude')} AS km FROM dim) WHERE km <= 25.0"),
    "nearest": _with("dim", f"SELECT origin, zone_id, km, CAST(row_number() OVER (PARTITION BY origin ORDER BY km, zone_id) AS INTEGER) AS place FROM (SELECT a.zone_id AS origin, b.zone_id, round({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 6) AS km FROM dim a JOIN dim b ON a.zone_id <> b.zone_id AND abs(a.latitude - b.latitude) < 0.1) WHERE km <= 5.0 QUALIFY place <= 3"),
    "day_pairs": _with("dp", "SELECT report_date, a, b, round(km, 6) AS km FROM dp"),
    "spread": _with("dp", "SELECT report_date, round(max(km), 6) AS diameter, round(avg(km), 6) AS mean_km, round(min(km), 6) AS closest FROM dp GROUP BY 1"),
    "clusters": _with("cu", "SELECT * FROM cu"),
    "largest_by_day": _with("cs", "SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY report_date ORDER BY n_zones DESC, diameter, cluster) = 1"),
    "top_clusters": _with("cs", "SELECT * FROM cs WHERE n_zones >= 2 ORDER BY n_zones DESC, diameter, report_date, cluster LIMIT 14"),
    "cells_in_circle": _with("fr", f"SELECT flashpoint_id, CAST(y * 360 + x AS INTEGER) AS cell FROM fr, (SELECT unnest(range(0, 180)) AS y), (SELECT unnest(range(0, 360)) AS x) WHERE {_km('latitude', 'longitude', '(y - 89.5)', '(x - 179.5)')} <= radius_km * 4"),
    "stable_index": _with("dim", "SELECT row_number() OVER (ORDER BY g, zone_id) - 1 AS idx, zone_id FROM (SELECT zone_id, CASE WHEN zone_id % 3 = 0 THEN 0 ELSE 1 END AS g FROM dim UNION ALL SELECT unnest(range(900000001, 900000004)), 0)"),
    "merge_events": _with("cl", "SELECT CAST(year(observed_at) AS INTEGER) AS year, count(*) AS n, CAST(sum(legion) AS BIGINT) AS legion FROM cl GROUP BY 1"),
    "upsert_latest": _with("cl", "SELECT zone_id, observed_at, control_state, legion, swarm, faceless FROM cl QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY observed_at DESC) = 1"),
    "plan_days": _with("sp", "SELECT CAST(unnest(generate_series(max(activity_date), DATE '2001-08-19', INTERVAL 1 DAY)) AS DATE) AS activity_date FROM sp"),
    "plan_targets": _with("rep ba", "SELECT n FROM (SELECT report_id AS n FROM rep UNION SELECT unnest(range((SELECT greatest(100, coalesce(max(report_id), 0)) FROM ba) + 1, (SELECT max(report_id) FROM rep) + 1))) WHERE n NOT IN (SELECT report_id FROM ba) ORDER BY n LIMIT 40"),
    "links": """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS link FROM pages""",
    "delta_roundtrip": _with("sp", "SELECT zone_id, observed_at, legion_delta AS delta, legion AS level FROM sp"),
    "export_manifest": _with("sp dim", """SELECT (SELECT count(*) FROM dim) AS n_zones, min(activity_date) AS first_day, max(activity_date) AS last_day, count(*) AS n_events, count(DISTINCT zone_id) AS n_ever_active,
        CAST(sum(legion_delta) AS BIGINT) AS legion, CAST(sum(swarm_delta) AS BIGINT) AS swarm, CAST(sum(faceless_delta) AS BIGINT) AS faceless, (SELECT count(*) FROM (SELECT arg_max(total, observed_at) AS t FROM sp GROUP BY zone_id) WHERE t > 0) AS n_held FROM sp"""),
    "name_blocks": _with("dim", """SELECT CAST(i // 64 AS INTEGER) AS block, CAST(to_json(list(coalesce(zone_name, '') ORDER BY i)) AS VARCHAR) AS names FROM (SELECT unnest(range(0, (SELECT max(zone_id) FROM dim) + 1)) AS i) LEFT JOIN dim ON zone_id = i GROUP BY 1"""),
    "sparse_series": _with("gd sp", "SELECT activity_date, legion, swarm, faceless FROM gd WHERE activity_date >= DATE '1995-07-01' AND activity_date IN (SELECT activity_date FROM sp GROUP BY 1 HAVING sum(legion_delta) <> 0 OR sum(swarm_delta) <> 0 OR sum(faceless_delta) <> 0)"),
    "net_since": _with("gd", f"SELECT a.activity_date AS first_day, b.activity_date AS last_day, b.legion + b.swarm + b.faceless - a.legion - a.swarm - a.faceless AS net FROM gd a, gd b WHERE a.activity_date = {_S} AND b.activity_date = {_D}"),
    "series_for_cells": _with("ev", """SELECT d.activity_date, CAST(sum(coalesce(l, 0)) OVER w AS BIGINT) AS legion, CAST(sum(coalesce(s, 0)) OVER w AS BIGINT) AS swarm, CAST(sum(coalesce(f, 0)) OVER w AS BIGINT) AS faceless
        FROM (SELECT CAST(unnest(generate_series(min(activity_date), max(activity_date), INTERVAL 1 DAY)) AS DATE) AS activity_date FROM (SELECT activity_date FROM ev WHERE latitude IS NOT NULL GROUP BY floor(latitude), floor(longitude), activity_date HAVING sum(legion_delta) <> 0 OR sum(swarm_delta) <> 0 OR sum(faceless_delta) <> 0)) d
        LEFT JOIN (SELECT activity_date, sum(legion_delta) AS l, sum(swarm_delta) AS s, sum(faceless_delta) AS f FROM ev WHERE floor(latitude) BETWEEN 50 AND 52 AND floor(longitude) BETWEEN 0 AND 2 GROUP BY 1) x USING (activity_date) WINDOW w AS (ORDER BY d.activity_date)"""),
    "cluster_record": _with("cs cu ba", """SELECT report_date, cluster, members, regions, countries, launches, n_zones, diameter FROM cs JOIN (SELECT report_date, cluster, array_to_string(list_sort(list(DISTINCT zone_id)), ',') AS members, array_to_string(list_sort(list(DISTINCT region_id)), ',') AS regions,
        array_to_string(list_sort(list(DISTINCT country_id)), ',') AS countries, CAST(sum(launches) AS BIGINT) AS launches FROM cu JOIN ba USING (report_date, zone_id) GROUP BY 1, 2) USING (report_date, cluster) WHERE n_zones > 1"""),
    "unplaced_reports": _with("rep gaps", "SELECT report_date, count(*) AS n_missing FROM rep WHERE NOT is_tournament AND zone_id NOT IN (SELECT zone_id FROM gaps) GROUP BY 1"),
    "impact_series": _with("fr fi", """SELECT d.flashpoint_id, d.activity_date, CAST(coalesce(sum(net_delta) FILTER (WHERE on_the_board), 0) AS BIGINT) AS board, CAST(coalesce(sum(net_delta) FILTER (WHERE NOT on_the_board), 0) AS BIGINT) AS neighbors, CAST(coalesce(sum(zones_moving), 0) AS BIGINT) AS moving
        FROM (SELECT flashpoint_id, CAST(unnest(generate_series(run_start, run_end, INTERVAL 1 DAY)) AS DATE) AS activity_date FROM fr) d LEFT JOIN fi ON fi.flashpoint_id = d.flashpoint_id AND fi.activity_date = d.activity_date GROUP BY 1, 2"""),
    "board_lists": _with("fr fz dim", "SELECT flashpoint_id, coalesce(b, '') AS board FROM fr LEFT JOIN (SELECT flashpoint_id, array_to_string(list_sort(list(idx)), ',') AS b FROM fz JOIN (SELECT zone_id, row_number() OVER (ORDER BY zone_id) - 1 AS idx FROM dim) USING (zone_id) WHERE on_the_board GROUP BY 1) USING (flashpoint_id)"),
    "lookup_json": _with("dim", """SELECT '{"' || zone_id || '":["' || zone_name || '","' || region_id || '"]}' AS value FROM dim"""),
    "lookup_roundtrip": _with("dim", "SELECT zone_id, zone_name, region_id FROM dim"),
    "search_areas": _with("dim", "SELECT zone_id, zone_name AS label, region_name || ', ' || country_name AS detail FROM dim WHERE contains(lower(zone_name), '_3, e') OR contains(lower(region_name || ', ' || country_name), '_3, e') ORDER BY label, zone_id LIMIT 40"),
    "period_activity": _with("sp", """SELECT label, greatest(s, lo) AS first_day, least(e, hi) AS last_day, CAST(sum(legion_delta) AS BIGINT) AS legion_delta, CAST(sum(swarm_delta) AS BIGINT) AS swarm_delta, CAST(sum(faceless_delta) AS BIGINT) AS faceless_delta, count(*) AS n_events
        FROM (VALUES ('whole record', NULL::DATE, NULL::DATE), ('from 1997', DATE '1997-01-01', NULL), ('two years', DATE '1996-04-01', DATE '1998-03-31'), ('until 1996', NULL, DATE '1996-01-01')) p(label, s, e), (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM sp) x JOIN sp ON activity_date BETWEEN greatest(s, lo) AND least(e, hi) GROUP BY 1, 2, 3"""),
    "map_rows": _with("dd dim", """SELECT zone_id, CAST(round_even(latitude * 10000, 0) AS INTEGER) AS lat_e4, CAST(round_even(longitude * 10000, 0) AS INTEGER) AS lon_e4, packed IS NOT NULL AS ever_active, coalesce(packed, 0) AS packed
        FROM dim LEFT JOIN (SELECT zone_id, arg_max(packed, activity_date) AS packed FROM dd GROUP BY 1) USING (zone_id) WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""),
    "tile_manifest": _with("cl dim", """SELECT CAST(r * 23 + c AS INTEGER) AS tile, count(*) AS n_zones, count(*) FILTER (WHERE zone_id IN (SELECT zone_id FROM cl)) AS n_played, CAST(r * 16 - 90 AS INTEGER) AS south, CAST(c * 16 - 180 AS INTEGER) AS west
        FROM (SELECT zone_id, floor((latitude + 90) / 16) AS r, floor((longitude + 180) / 16) AS c FROM dim) GROUP BY r, c"""),
    "area_extent": _with("dim", "SELECT country_id, min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north FROM dim GROUP BY 1"),
    "daily_top": _with("ms", "SELECT report_date, CAST(row_number() OVER w AS INTEGER) AS place, zone_id, launches FROM ms WINDOW w AS (PARTITION BY report_date ORDER BY launches DESC, zone_id) QUALIFY row_number() OVER w <= 2"),
    "per_player": _with("ms", "SELECT zone_id, report_date, round(launches / nullif(players, 0), 6) AS per_player FROM ms"),
    "count_equal": _with("ms", "SELECT count(*) FILTER (WHERE launch_1 = 0) AS n_equal, count(*) AS n FROM ms"),
    "merge_reports": _with("rep", "SELECT report_id, CASE WHEN report_id % 3 = 0 THEN launches END AS launches, CASE WHEN report_id % 3 >= 1 THEN players END AS players FROM rep"),
    "densified_levels": _with("cd", """SELECT country_id, activity_date, legion, swarm, faceless FROM cd WHERE country_id IN (SELECT country_id FROM cd WHERE n_events > 0)
        AND activity_date BETWEEN (SELECT min(activity_date) FROM cd WHERE n_events > 0) AND (SELECT max(activity_date) FROM cd WHERE n_events > 0)"""),
    "flashpoint_codes": _with("fr", "SELECT flashpoint_id, CAST(row_number() OVER (ORDER BY run_start, flashpoint_id) - 1 AS INTEGER) AS code FROM fr"),
    "warehouse_events": _with("sp", """SELECT zone_id, dense_rank() OVER (ORDER BY zone_id) - 1 AS idx, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY observed_at) - 1 AS INTEGER) AS seq, observed_at, total FROM sp"""),
    "warehouse_rows": _with("sp dim last ms", """SELECT 'zone' AS name, count(*) AS n FROM dim UNION ALL SELECT 'zone_event', count(*) FROM sp UNION ALL SELECT 'zone_day', count(*) FROM last UNION ALL SELECT 'maz', count(*) FROM ms
        UNION ALL SELECT 'country', count(*) FROM region UNION ALL SELECT 'region', count(*) FROM nation"""),
    "years_present": _with("cl", "SELECT DISTINCT CAST(year(observed_at) AS INTEGER) AS year FROM cl"),
    "check_freshness": _with("cl", "SELECT age_days, CASE WHEN age_days > 7 THEN 'error' WHEN age_days > 2 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT CAST(DATE '2001-08-05' - CAST(max(observed_at) AS DATE) AS INTEGER) AS age_days FROM cl)"),
    "check_tile_totals": _with("dim", "SELECT a AS in_tiles, b AS in_scope FROM (SELECT count(latitude) AS a, count(*) AS b FROM dim) WHERE a <> b"),
    "check_unique_events": _with("cl", "SELECT zone_id, observed_at, count(*) AS n FROM cl GROUP BY 1, 2 HAVING count(*) > 1"),
    "check_orphans": _with("cl gaps", "SELECT DISTINCT zone_id FROM cl WHERE zone_id NOT IN (SELECT zone_id FROM gaps)"),
    "check_negative_totals": _with("gd cd", "SELECT activity_date, legion, swarm, faceless FROM gd WHERE least(legion, swarm, faceless) < 0 UNION ALL SELECT activity_date, legion, swarm, faceless FROM cd WHERE least(legion, swarm, faceless) < 0"),
    "check_checkpoints": "SELECT o_custkey AS zone_id, 0::INTEGER AS boundary_year, 0::BIGINT AS n FROM orders WHERE false",
    "check_anchors": _with("fp dim", "SELECT flashpoint_id, 'anchor' AS problem FROM fp WHERE anchor NOT IN (SELECT zone_id FROM dim)"),
    "check_tournaments": _with("rep", "SELECT report_id FROM rep WHERE is_tournament <> (zone_id < 0)"),
    "check_impact_run": _with("fi fr", "SELECT flashpoint_id, activity_date FROM fi JOIN fr USING (flashpoint_id) WHERE activity_date NOT BETWEEN run_start AND run_end"),
    "check_split": _with("rep", f"SELECT report_id FROM rep WHERE launches <> launch_1 + launch_2 + launch_3 AND NOT {_BAD}"),
    "check_same_keys": _with("ba ms", "SELECT zone_id, report_date, true AS in_a, true AS in_b FROM (SELECT zone_id, report_date FROM ba EXCEPT SELECT zone_id, report_date FROM ms)"),
    "check_relationship": _with("cl gaps", "SELECT DISTINCT zone_id, 'warn' AS severity FROM cl WHERE zone_id NOT IN (SELECT zone_id FROM gaps)"),
    "check_not_null": _with("sp gaps", "SELECT 'country_id' AS \"column\", count(*) AS n_nulls FROM sp WHERE zone_id NOT IN (SELECT zone_id FROM gaps) HAVING count(*) > 0"),
    "check_widths": _with("ms", "SELECT 'launches' AS \"column\", min(launches) AS lo, max(launches) AS hi, 0::BIGINT AS least, 255::BIGINT AS most FROM ms HAVING max(launches) > 255 OR min(launches) < 0"),
}
