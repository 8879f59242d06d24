"""Staging: raw tables with the source's own column names become tables with the model's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Raw names and the model's, by table.
ZONES = {
    "ZoneId": "zone_id", "Description": "zone_name", "RegionId": "region_id", "CountryId": "country_id", "ZoneControlState": "control_state", "Latitude": "latitude", "Longitude": "longitude",
    "LegionCount": "legion_count", "SwarmCount": "swarm_count", "FacelessCount": "faceless_count", "TotalCount": "total_count", "LastUpdateDateUtc": "observed_at", "DateCapturedUtc": "captured_at",
}
COUNTRIES = {"countryid": "country_id", "Code": "country_code", "Description": "country_name"}
FACTIONS = {"id": "faction_id", "name": "faction_name"}
_REPORT = {
    "Battle Report Number": "battle_report_number", "Zone ID": "zone_id", "Date": "battle_date", "Zone Name": "reported_zone_name", "Region": "reported_region_name", "Country": "reported_country_name",
    "Total Active Players": "total_active_players", "Total Launches": "total_launches", "Bots Launched": "bots_launched", "Bots Killed": "bots_killed", "Bots Lost": "bots_lost",
}
#: Raw endings and the model's, for each faction.
_SPLIT = {"Starting Bots": "starting_bots", "Ending Bots": "ending_bots", "Total Active Players": "active_players", "Total Launches": "total_launches"}
REPORTS = _REPORT | {f"{faction} {raw}": f"{faction.lower()}_{name}" for raw, name in _SPLIT.items() for faction in ("Legion", "Swarm", "Faceless")}


def stage(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names``, renamed; others are not read. A missing column is an error that names it."""
    if missing := [c for c in names if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))


def stage_reports(raw: DataFrame) -> DataFrame:
    """Reports with whole-number zone ids; a negative one is a tournament's. A null id stays null, and so does its flag."""
    rows = stage(raw, REPORTS).withColumn("zone_id", F.col("zone_id").cast("int"))
    return rows.withColumn("is_tournament", F.col("zone_id") < 0)
