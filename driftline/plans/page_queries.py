"""Registered queries over the given pages and over report pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import extract, pages, staging
from .oracles import _with


def _with_names(m) -> DataFrame:
    """Reports of known zones; tournaments have pages too, under their zone's number with a minus.

    Reading a page takes a thousand times as long as moving its report, so reports are dealt out before their pages are made.
    """
    names = m.dim.select("zone_id", "zone_name", "region_name", "country_name").withColumnRenamed("zone_id", "named")
    return m.reports.join(names, F.abs("zone_id") == F.col("named")).repartition(m.spark.sparkContext.defaultParallelism, "report_id")


def _fields(m) -> DataFrame:
    read = extract.extract(m.pages, pages.ARTICLE)
    lists = [F.array_join(c, "\n").alias(c) for c in ("links", "labels", "paragraphs")]
    return read.select("page_id", "title", "heading", *lists, "notice", F.size("paragraphs").cast("long").alias("n_paragraphs"), "reject")


def _reports(m) -> DataFrame:
    read = pages.extract_reports(pages.render_reports(_with_names(m)))
    return staging.stage_reports(read).select("battle_report_number", "zone_id", "battle_date", *_STAGED, "is_tournament")


_STAGED = (
    "reported_zone_name", "reported_region_name", "reported_country_name", "total_active_players", "total_launches", "bots_launched", "bots_killed", "legion_total_launches", "swarm_total_launches",
    "faceless_total_launches", "legion_active_players", "swarm_starting_bots", "legion_starting_bots", "faceless_starting_bots", "swarm_ending_bots", "legion_ending_bots", "faceless_ending_bots",
)


def _rejects(m) -> DataFrame:
    return extract.reject_counts(extract.extract(pages.render_reports(_with_names(m)), pages.REPORT, "report_id"))


def _numbers(m) -> DataFrame:
    found = pages.report_numbers(pages.render_index(m.reports), "report_date")
    return found.select("report_date", F.size("numbers").cast("long").alias("n"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


BUILD = {"page_fields": _fields, "report_fields": _reports, "report_rejects": _rejects, "report_numbers": _numbers}


def _plain(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


_PAGE = f"""
WITH p AS (
  SELECT page_id, html, html IS NULL OR trim(html, ' ' || chr(9) || chr(10) || chr(13)) = '' AS none, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS article, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages
), f AS (
  SELECT page_id, none, {_plain("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_plain("regexp_extract(article, '<h1>(.*?)</h1>', 1, 's')")} AS heading,
    regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links, list_transform(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), lambda x: {_plain("x")}) AS labels,
    list_transform(string_split(article, '<p>')[2:], lambda x: {_plain("x")}) AS paragraphs, {_plain("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS notice FROM p
)
SELECT page_id, CASE WHEN NOT none AND title <> '' THEN title END AS title, CASE WHEN NOT none AND heading <> '' THEN heading END AS heading, CASE WHEN NOT none THEN array_to_string(links, chr(10)) END AS links,
  CASE WHEN NOT none THEN array_to_string(labels, chr(10)) END AS labels, CASE WHEN NOT none THEN array_to_string(paragraphs, chr(10)) END AS paragraphs, CASE WHEN NOT none AND notice <> '' THEN notice END AS notice,
  CASE WHEN NOT none THEN len(paragraphs) ELSE NULL END AS n_paragraphs, CASE WHEN none THEN 'no page' END AS reject FROM f
"""
_COUNTS = f"""
SELECT page_id, CASE WHEN status = 'ok' THEN title END AS title, CASE WHEN status = 'ok' THEN CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) ELSE 0 END AS n_links,
  CASE WHEN status = 'ok' THEN CAST(len(regexp_extract_all(html, '<h[1-6]>')) AS INTEGER) ELSE 0 END AS n_headings, CASE WHEN status = 'ok' THEN CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) ELSE 0 END AS n_paragraphs, status
FROM (SELECT *, CASE WHEN html IS NULL OR trim(html, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'missing' ELSE 'ok' END AS status, {_plain("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title FROM pages)
"""
_NAMED = "(SELECT rep.*, dim.zone_name, dim.region_name, dim.country_name FROM rep JOIN dim ON abs(rep.zone_id) = dim.zone_id)"
ORACLE = {
    "page_fields": _PAGE,
    "page_reports": _COUNTS,
    "report_fields": _with("rep dim", f"""SELECT report_id AS battle_report_number, CAST(zone_id AS INTEGER) AS zone_id, report_date AS battle_date, zone_name AS reported_zone_name, region_name AS reported_region_name, country_name AS reported_country_name,
        players AS total_active_players, launches AS total_launches, launches * 7 AS bots_launched, CAST(NULL AS BIGINT) AS bots_killed, launch_1 AS legion_total_launches, launch_2 AS swarm_total_launches, launch_3 AS faceless_total_launches, CAST(NULL AS BIGINT) AS legion_active_players,
        launch_2 + 1000 AS swarm_starting_bots, launch_1 * 2 + 1000 AS legion_starting_bots, launch_3 * 3 + 1000 AS faceless_starting_bots, launch_2 * 4 + 1000 AS swarm_ending_bots, launch_1 * 5 + 1000 AS legion_ending_bots, launch_3 * 6 + 1000 AS faceless_ending_bots, zone_id < 0 AS is_tournament
        FROM {_NAMED} WHERE report_id % 13 > 4"""),
    "report_rejects": _with("rep dim", f"""SELECT CASE report_id % 13 WHEN 0 THEN 'no page' WHEN 2 THEN 'count' WHEN 4 THEN 'value' ELSE 'missing' END AS reject,
        CASE report_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'Zone Name' WHEN 2 THEN 'div.progress' WHEN 3 THEN 'players' ELSE 'Total Launches' END AS reject_field, count(*) AS n FROM {_NAMED} WHERE report_id % 13 <= 4 GROUP BY 1, 2"""),
    "report_numbers": _with("rep", "SELECT report_date, count(*) AS n, string_agg(report_id, ',' ORDER BY report_id) AS numbers FROM rep GROUP BY 1"),
}
