"""A warehouse in shards: written in one pass a table, read back as the tables that queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import EPOCH, tile_of
from ..sources.contracts import write_sharded
from ..sources.guards import Guard, write_guarded

#: Entities of one block of histories.
BLOCK = 4096
#: The column of the layout and the order inside its folders, by table.
LAYOUT = {
    "zone": ("tile", ["latitude", "longitude", "zone_id"]),
    "zone_event": ("block", ["idx", "seq"]),
    "zone_day": ("year", ["zone_id", "activity_date"]),
    "maz": ("year", ["report_date", "zone_id"]),
}
SMALL = ("country", "region")
_COUNTS = dict.fromkeys(("legion", "swarm", "faceless"), "uint32")
#: What the columns of each table have to fit. A zone may have no place, and so no tile; nothing else may lack its shard.
GUARDS = {
    "zone": Guard({"country_id": "uint8", "region_id": "uint16"}, required=("zone_id",)),
    "zone_event": Guard({"idx": "uint32", "seq": "uint32", "control_state": "uint8"} | _COUNTS, required=("block", "idx", "observed_at", *_COUNTS)),
    "zone_day": Guard(_COUNTS, required=("year", "zone_id", *_COUNTS)),
    "maz": Guard({"launches": "uint31", "players": "uint16"}, required=("year", "zone_id", "launches")),
    "country": Guard(required=("country_id", "country_name")),
    "region": Guard(required=("region_id", "region_name")),
}


def sequence(spine: DataFrame, index: DataFrame) -> DataFrame:
    """The spine with each zone's index and ``seq``, its place in the zone's history from 0. It is stored: a place counted
    after reading would depend on how files are dealt out. Rows of zones without an index are left out."""
    w = Window.partitionBy("zone_id").orderBy("observed_at")
    return spine.withColumn("seq", F.row_number().over(w) - 1).join(index, "zone_id")


def write_warehouse(root: str, dim: DataFrame, spine: DataFrame, index: DataFrame, days: DataFrame, battles: DataFrame, countries: DataFrame, regions: DataFrame) -> None:
    """Writes zones by tile, events by block of indexes, zone-days and report days by year, and the two small lookups."""
    tables = {
        "zone": dim.withColumn("tile", tile_of("latitude", "longitude")),
        "zone_event": sequence(spine, index).withColumn("block", F.floor(F.col("idx") / BLOCK).cast("int")),
        "zone_day": days.withColumn("year", F.year("activity_date")),
        "maz": battles.withColumn("year", F.year("report_date")),
    }
    for name, df in tables.items():
        write_sharded(df, f"{root}/{name}", *LAYOUT[name], GUARDS[name].on(df.columns))
    for name, df in zip(SMALL, (countries, regions), strict=True):
        write_guarded(df, f"{root}/{name}", GUARDS[name].on(df.columns))


def rebuild_warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables by name, without the columns of the layout."""
    tables = {name: spark.read.parquet(f"{root}/{name}").drop(shard) for name, (shard, _) in LAYOUT.items()}
    return tables | {name: spark.read.parquet(f"{root}/{name}") for name in SMALL}


def write_display(root: str, display: DataFrame, index: DataFrame, epoch: str = EPOCH) -> None:
    """The packed history by year, in order of (idx, day); refused if an index, a packed state or a day does not fit."""
    rows = display.join(index, "zone_id").select("idx", "activity_date", "packed", F.year("activity_date").alias("year"))
    write_sharded(rows, root, "year", ["idx", "activity_date"], Guard({"idx": "uint32", "packed": "uint8"}, ("year", "idx", "packed"), ("activity_date",), epoch))


def read_display(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(idx, activity_date, packed) of the years from ``first`` to ``last``; other years' files are not read."""
    rows = spark.read.parquet(root)
    rows = rows if first is None else rows.where(F.col("year") >= first)
    return (rows if last is None else rows.where(F.col("year") <= last)).drop("year")
