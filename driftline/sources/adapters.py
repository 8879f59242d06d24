"""The given tables in the roles of the state-change model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import daily_top

#: Curated incidents (id, label, anchor zone, board window, run window, radius in km).
FLASHPOINTS = (
    ("alpha", "Alpha rising", 7, "1996-03-01", "1996-09-30", "1996-01-01", "1996-12-31", 48.28032),
    ("bravo", "Bravo falls", 42, "1997-02-01", "1997-12-31", "1997-01-01", "1998-03-31", 60.0),
    ("carol", "Carol's stand", 101, "1998-06-01", "1999-01-31", "1998-05-01", "1999-03-31", 48.28032),
    ("delta", "Delta quiet", 11, "2030-01-01", "2030-01-31", "2030-01-01", "2030-02-28", 48.28032),
    ("echo", "Echo lost", 970000001, "1999-01-01", "1999-12-31", "1999-01-01", "1999-12-31", 48.28032),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as state changes of customers: one row per (zone_id, observed_at)."""
    orders = table(spark, sf_dir, "orders")
    empty = F.col("o_orderkey") % 11 == 0
    count = lambda x: F.when(empty, F.lit(0).cast("long")).otherwise(x % 997)
    return orders.select(
        F.col("o_custkey").alias("zone_id"),
        F.expr("timestampadd(MICROSECOND, o_orderkey, o_orderdate)").cast("timestamp_ntz").alias("observed_at"),
        (F.substring("o_orderpriority", 1, 1).cast("int") % 4).alias("control_state"),
        count(F.round(F.col("o_totalprice") * 100).cast("long")).alias("legion"),
        count(F.col("o_orderkey") * 7).alias("swarm"),
        count(F.col("o_orderkey") * 13).alias("faceless"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as located zones."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return c.select(
        key.alias("zone_id"),
        F.col("c_name").alias("zone_name"),
        F.col("c_nationkey").alias("region_id"),
        F.when(key % 50 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey")).cast("int").alias("country_id"),
        (50 + (key * 7919 % 200) / 100).alias("latitude"),
        ((key * 104729 % 300) / 100).alias("longitude"),
    )


def with_gaps(dim: DataFrame) -> DataFrame:
    """Zones without every 97th, for the checks that look for changes and reports of unknown zones: the given tables have none."""
    return dim.where(F.col("zone_id") % 97 != 0)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region_name"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country_name"))


def flashpoints(spark: SparkSession) -> DataFrame:
    names = "flashpoint_id string, label string, anchor_zone_id long, board_start string, board_end string, run_start string, run_end string, radius_km double"
    df = spark.createDataFrame(list(FLASHPOINTS), names)
    return df.withColumns({c: F.col(c).cast("date") for c in ("board_start", "board_end", "run_start", "run_end")})


def reports(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Leaderboard reports: orders with their lines split by return flag, the top ``k`` of each day."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).cast("long").alias(n) for f, n in (("A", "launch_1"), ("N", "launch_2"), ("R", "launch_3"))))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["launch_1", "launch_2", "launch_3"])
    zone = F.when(F.col("o_custkey") % 31 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    rows = both.select(F.col("o_orderkey").alias("report_id"), zone.alias("zone_id"), F.to_date("o_orderdate").alias("report_date"), "launch_1", "launch_2", "launch_3", (F.col("launch_1") + F.col("launch_2") + F.col("launch_3")).alias("launches"), (F.col("o_orderkey") % 7 + 1).alias("players"))
    return daily_top(rows, "report_date", "launches", "report_id", k).drop("place").withColumn("is_tournament", F.col("zone_id") < 0)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, day) of the event stream, distinct."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("zone_id"), F.to_date("ts").alias("day")).distinct()
