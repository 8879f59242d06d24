"""What a viewer loads: the manifest and series as nested JSON, and the order of rows in written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.guards import Guard, observed, remove
from .spine import COUNTS, current_state

MANIFEST = (
    "scope struct<zones: long, ever_active: long>, days struct<first: date, last: date>, events long, current struct<legion: long, swarm: long, faceless: long, held: long>"
)


def manifest(dim: DataFrame, events: DataFrame) -> DataFrame:
    """One row of nested fields: zones in scope and ever active, first and last day, current totals and zones held. Empty tables give zeros and null days."""
    state = current_state(events)
    total = sum(F.col(c) for c in COUNTS)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    scope = dim.agg(F.count("*").alias("zones"))
    span = events.agg(F.count("*").alias("events"), F.count_distinct("zone_id").alias("ever_active"), F.min("activity_date").alias("first"), F.max("activity_date").alias("last"))
    held = state.agg(*(zero(F.sum(c)).alias(c) for c in COUNTS), F.count_if(total > 0).alias("held"))
    # Three tables of one row each.
    one = scope.join(F.broadcast(span)).join(F.broadcast(held))
    return one.select(F.struct("zones", "ever_active").alias("scope"), F.struct("first", "last").alias("days"), "events", F.struct(*COUNTS, "held").alias("current"))


def write_manifest(found: DataFrame, path: str) -> None:
    """One JSON file under ``path``; it is written last, when every table that it speaks of is there. A manifest without zones or days is refused."""
    lines = found.select(F.to_json(F.struct(*found.columns)).alias("value"), F.col("days.first").alias("first"), F.when(F.col("scope.zones") > 0, 1).alias("zones"))
    try:
        observed(lines.coalesce(1), Guard(required=("first", "zones")), lambda rows: rows.select("value").write.mode("overwrite").text(path))
    except ValueError:
        remove(found.sparkSession, path)
        raise


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def series_json(levels: DataFrame, by: list, day: str = "activity_date", cols: tuple[str, ...] = COUNTS) -> DataFrame:
    """(by, series): each group's rows as one JSON object of parallel arrays in order of days: ``{"day": [...], "legion": [...], ...}``.

    A group's array is as long as its days. Group by what bounds them, an area or a year. Null levels stay null in their array.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), *cols)))
    held = levels.groupBy(*by).agg(rows.alias("rows"))
    parts = [F.col(f"rows.{c}").alias(c) for c in ("day", *cols)]
    names = [c for c in held.columns if c != "rows"]
    return held.select(*names, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("series"))


def read_series(lines: DataFrame, cols: tuple[str, ...] = COUNTS) -> DataFrame:
    """The rows that ``series_json`` was made from."""
    schema = f"day array<date>, {', '.join(f'{c} array<long>' for c in cols)}"
    names = [c for c in lines.columns if c != "series"]
    parsed = lines.select(*names, F.from_json("series", schema).alias("s"))
    zipped = F.arrays_zip(*(F.col(f"s.{c}") for c in ("day", *cols)))
    return parsed.select(*names, F.explode(zipped).alias("r")).select(*names, F.col("r.day").alias("activity_date"), *(F.col(f"r.{c}").alias(c) for c in cols))


def file_places(spark: SparkSession, root: str, shard: str) -> DataFrame:
    """The rows of a sharded table with ``place``, from 1 in each shard: by the names of its files, which follow the ranges that were dealt out, then as they stand in the file."""
    rows = spark.read.parquet(root).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(shard).orderBy("file", "at"))).drop("file", "at")


def out_of_order(spark: SparkSession, root: str, shard: str, order: list[str]) -> DataFrame:
    """Rows of a sharded table that come before their predecessor, within a file or from one file of a shard to the next."""
    placed = file_places(spark, root, shard)
    key = F.struct(*order)
    before = F.lag(key).over(Window.partitionBy(shard).orderBy("place"))
    return placed.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") > key)).select(shard, "place", *order)
