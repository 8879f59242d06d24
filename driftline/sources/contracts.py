"""Contracts: schemas are enforced where data comes in, never repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import Guard, write_guarded

CHANGELOG = T.StructType(
    [
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("observed_at", T.TimestampNTZType()),
        T.StructField("captured_at", T.TimestampNTZType()),
        T.StructField("control_state", T.ByteType()),
        T.StructField("legion", T.LongType()),
        T.StructField("swarm", T.LongType()),
        T.StructField("faceless", T.LongType()),
    ]
)
#: The drop's column names.
NAMES = {"ZoneId": "zone_id", "LastUpdateDateUtc": "observed_at", "DateCapturedUtc": "captured_at", "ZoneControlState": "control_state", "LegionCount": "legion", "SwarmCount": "swarm", "FacelessCount": "faceless"}


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Select, order and cast to the contract; a missing column is an error that names it."""
    missing = [f.name for f in contract if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in contract))


def parse_stamps(df: DataFrame, required: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Text stamps to timestamps, cut after the second. Absent stamps are null; a required one that cannot be read is an error."""
    parsed = lambda c: F.try_to_timestamp(F.substring(F.nullif(F.trim(c), F.lit("")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    bad = df.where((F.trim(required) != "") & parsed(required).isNull()).select(required).limit(5).collect()
    if bad:
        raise ValueError(f"unreadable {required}: {', '.join(r[0] for r in bad)}")
    return df.withColumns({c: parsed(c) for c in (required, *optional)})


def _drops(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    text = T.StructType([T.StructField(c, T.StringType()) for c in NAMES])
    raw = spark.read.csv(paths, header=True, schema=text).withColumnsRenamed(NAMES)
    return conform(parse_stamps(raw, "observed_at", ("captured_at",)), CHANGELOG)


def read_zone_state_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Daily drops as states: rows without an event time stay (such a zone was never touched), totals are summed here."""
    return _drops(spark, paths).withColumn("total", F.col("legion") + F.col("swarm") + F.col("faceless"))


def ingest_lookups(spark: SparkSession, src: str, dst: str, contract: T.StructType) -> DataFrame:
    """A lookup's CSV, conformed and written as Parquet; returns the written table. Its first column, the key, has to be known in every row."""
    write_guarded(conform(spark.read.csv(src, header=True), contract), dst, Guard(required=(contract.names[0],)))
    return spark.read.schema(contract).parquet(dst)


def read_seeds(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """A curated CSV with a header: dates, numbers and quoted labels, in which a quote is doubled. Names in another order than the
    contract's and values that do not parse are errors."""
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd"}
    return spark.read.options(**options).schema(contract).csv(path)


def read_changelog_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Daily drops as change rows: rows without an event time are left out, one row per key."""
    rows = _drops(spark, paths).where("observed_at IS NOT NULL")
    return rows.groupBy("zone_id", "observed_at").agg(F.max(F.struct("captured_at", "control_state", "legion", "swarm", "faceless")).alias("r")).select("zone_id", "observed_at", "r.*")


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned table; the year of the layout is not shown."""
    return spark.read.parquet(path).drop("year")


def write_sharded(df: DataFrame, root: str, shard: str, order: list[str], guard: Guard | None = None) -> None:
    """One folder per shard, rows in order inside each file: one pass, not one scan per shard. A table that ``guard`` finds a fault in is not put there.

    Rows are dealt out by ranges of (shard, order), so that a shard with a third of all rows is several files of several tasks.
    """
    write_guarded(df.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order), root, guard or Guard(), shard)
