"""Statistics of leaderboard reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

LAUNCHES = ("launch_1", "launch_2", "launch_3")


def zone_battles(reports: DataFrame, dim: DataFrame) -> DataFrame:
    """Reports of known zones, tournaments and undated ones left out."""
    return reports.where("NOT is_tournament AND report_date IS NOT NULL").join(dim.select("zone_id", "country_id", "region_id", "latitude", "longitude"), "zone_id")


def maz(battles: DataFrame) -> DataFrame:
    return battles.select("zone_id", "report_date").distinct()


def maz_stats(battles: DataFrame) -> DataFrame:
    """One row per zone and day, the largest of each measure."""
    return battles.groupBy("zone_id", "report_date").agg(*(F.max(c).alias(c) for c in ("launches", "players", *LAUNCHES)))


def summarize(df: DataFrame, col: str) -> DataFrame:
    """Count, extremes, mean and the quantiles at index floor(p * n), n - 1 at most; zeros when empty."""
    rows = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    # Distinct values in ranges: a running count inside each range, over the counts of the ranges before it.
    ranges = materialize(rows.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("part").agg(F.sum("c").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranges.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("upto", F.col("inside") + F.col("before"))
    n = rows.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    out = ranked.join(F.broadcast(n))
    return out.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), zero(F.min("v")).alias("lo"), zero(at(0.5)).alias("median"), zero(at(0.9)).alias("p90"), zero(at(0.99)).alias("p99"), zero(F.max("v")).alias("hi"), F.round(zero(F.sum(F.col("v") * F.col("c")) / F.sum("c")), 6).alias("mean"))


def log_bins(df: DataFrame, col: str, per_decade: int = 8) -> DataFrame:
    """Counts per logarithmic bin, empty bins kept; values up to 1 fall into bin 0."""
    top = df.agg(F.max(col).alias("m"))
    last = F.when(F.col("m").isNull() | (F.col("m") <= 1), 0).otherwise(F.greatest(F.lit(0), F.ceil(F.log10("m") * per_decade)))
    bins = top.select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin"))
    index = F.when(F.col(col) <= 1, 0).otherwise(F.least(F.floor(F.log10(col) * per_decade), F.col("last"))).cast("long")
    hits = df.where(F.col(col).isNotNull()).join(F.broadcast(top.select(last.cast("long").alias("last")))).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(hits, "bin", "left").na.fill(0, ["n"])


def linear_bins(df: DataFrame, col: str, bins: int, top: float) -> DataFrame:
    """Counts in equal bins over [0, top]; larger values fall into the last, negative ones out."""
    index = F.least(F.floor(F.col(col) / top * bins), F.lit(bins - 1)).cast("int")
    hits = df.where(F.col(col) >= 0).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(hits, "bin", "left").na.fill(0, ["n"])


def daily_totals(stats: DataFrame, col: str = "launches") -> DataFrame:
    out = stats.groupBy("report_date").agg(F.sum(col).alias("total"), F.count("*").alias("n_reports"))
    return out.withColumn("per_report", F.round(F.col("total") / F.col("n_reports"), 6))


def biggest_reports(stats: DataFrame, least: int) -> DataFrame:
    return stats.where(F.col("launches") >= least).select("zone_id", "report_date", "launches", "players", F.round(F.try_divide("launches", "players"), 6).alias("per_player"))


def biggest_days(stats: DataFrame, least: int) -> DataFrame:
    return stats.groupBy("report_date").agg(F.sum("launches").alias("launches"), F.sum("players").alias("players"), F.count("*").alias("n_reports")).where(F.col("launches") >= least)


def drop_window(stats: DataFrame, start: str, end: str) -> DataFrame:
    return stats.where(~F.col("report_date").between(start, end))


def faction_daily(stats: DataFrame, start: str, end: str, digits: int = 6) -> DataFrame:
    """Shares of the three factions a day, a known bad window and days without launches left out."""
    sums = drop_window(stats, start, end).groupBy("report_date").agg(*(F.sum(c).alias(c) for c in LAUNCHES))
    total = sum(F.col(c) for c in LAUNCHES)
    return sums.where(total > 0).select("report_date", *(F.round(F.col(c) / total, digits).alias(f"share_{k}") for k, c in enumerate(LAUNCHES, 1)))


def fight_shape(stats: DataFrame, start: str, end: str) -> DataFrame:
    total = sum(F.col(c) for c in LAUNCHES)
    rows = drop_window(stats, start, end).where(total > 0)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.greatest(*LAUNCHES) == total).alias("n_one_sided"), F.count_if(F.least(*LAUNCHES) > 0).alias("n_three_way"), F.round(F.avg(F.greatest(*LAUNCHES) / total), 6).alias("mean_dominance"))


def longest_streaks(days: DataFrame, key: str = "zone_id", day: str = "day") -> DataFrame:
    """Longest run of consecutive days per key."""
    w = Window.partitionBy(key).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    return days.select(key, day).distinct().withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def appearances(reports: DataFrame, key: str = "zone_id") -> DataFrame:
    return reports.groupBy(key).agg(F.count("*").alias("n"))


def report_days(reports: DataFrame, k: int = 10) -> DataFrame:
    per = reports.groupBy("report_date").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_days"), F.count_if(F.col("n") == k).alias("n_full"), F.min("n").alias("least"), F.max("n").alias("most"))


def marks(days: DataFrame, day: str, window: int = 30) -> DataFrame:
    """Appearances in [D - window, D], D at most the newest day; weight grows with the log of the count."""
    newest = days.agg(F.least(F.max("day"), F.lit(day).cast("date")).alias("d"))
    rows = days.join(F.broadcast(newest)).where((F.col("day") <= F.col("d")) & (F.col("day") >= F.date_sub("d", window)))
    out = rows.groupBy("zone_id").agg(F.count("*").alias("n"), F.max(F.col("day") == F.col("d")).alias("fresh"))
    return out.withColumn("weight", F.round(F.least(F.lit(1.0), F.log1p("n") / F.log1p(F.lit(30.0))), 6))


def trailing_mean(daily: DataFrame, col: str = "total", n: int = 30) -> DataFrame:
    """Mean of the last ``n`` samples, full windows only; no row at all when there are no more than ``n``."""
    w = Window.orderBy("report_date")
    rows = daily.withColumn("k", F.row_number().over(w)).withColumn("mean", F.round(F.avg(col).over(w.rowsBetween(1 - n, 0)), 6))
    size = daily.agg(F.count("*").alias("size"))
    return rows.join(F.broadcast(size)).where((F.col("k") >= n) & (F.col("size") > n)).select("report_date", "mean")


def smoothed_shares(shares: DataFrame, n: int = 30) -> DataFrame:
    """Trailing means of the shares, brought back to a sum of 1."""
    w = Window.orderBy("report_date").rowsBetween(1 - n, 0)
    rows = shares.select("report_date", *(F.avg(f"share_{k}").over(w).alias(f"m{k}") for k in (1, 2, 3)))
    total = F.col("m1") + F.col("m2") + F.col("m3")
    return rows.select("report_date", *(F.round(F.when(total > 0, F.col(f"m{k}") / total).otherwise(0.0), 6).alias(f"share_{k}") for k in (1, 2, 3)))


def daily_top(df: DataFrame, day: str, metric: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` rows of each day with the largest ``metric`` (ties: smallest key), and their ``place``."""
    w = Window.partitionBy(day).orderBy(F.desc(metric), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def per_player(stats: DataFrame, col: str = "launches") -> DataFrame:
    """``col`` a player; null without players."""
    return stats.withColumn("per_player", F.round(F.try_divide(col, "players"), 6))


def count_equal(df: DataFrame, col: str, value) -> DataFrame:
    """How many rows have ``value`` in ``col``, of how many; nulls never do."""
    return df.agg(F.count_if(F.col(col) == value).alias("n_equal"), F.count("*").alias("n"))


def appearance_summary(reports: DataFrame, key: str = "zone_id") -> DataFrame:
    """Keys in all, the share of those that appear once, and the key that appears most (ties: the smallest)."""
    per = appearances(reports, key)
    once = F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6)
    return per.agg(F.count("*").alias("n_keys"), once.alias("share_once"), F.min_by(key, F.struct(-F.col("n"), key)).alias("leader"), F.max("n").alias("leader_n"))


def dropped_days(daily: DataFrame, start: str, end: str, day: str = "report_date") -> DataFrame:
    """How many days a known-bad window, ends included, drops from ``daily``, and how many stay."""
    bad = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return daily.select(day).distinct().agg(F.count_if(bad).alias("n_dropped"), F.count_if(~bad).alias("n_kept"))


def clusterless_share(sizes: DataFrame, least: int = 4) -> DataFrame:
    """Days in all, days without a cluster of ``least`` zones, and their share."""
    per = sizes.groupBy("report_date").agg(F.max("n_zones").alias("most"))
    out = per.agg(F.count("*").alias("n_days"), F.count_if(F.col("most") < least).alias("n_without"))
    return out.withColumn("share", F.round(F.col("n_without") / F.col("n_days"), 6))


def maz_range(battles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many distinct (zone, day) entries the board has, and its first and last day; in all, or for each group of ``by``."""
    entries = battles.select(*(by or []), "zone_id", "report_date").distinct()
    return entries.groupBy(*(by or [])).agg(F.count("*").alias("n_entries"), F.min("report_date").alias("first_day"), F.max("report_date").alias("last_day"))
