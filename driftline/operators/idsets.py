"""Sets of ids as bitmaps: one row per group and bucket of 32,768 ids, 4 KB at most, whatever the number of ids.

Sets over parts of the data are put together by OR, so they can be built per day, per shard or per batch and merged later; a set
that only grows is the running OR of what came by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_sets(rows: DataFrame, by: list[str], key: str = "zone_id") -> DataFrame:
    """(by, bucket, ids): the distinct ids of each group. Tasks send one bitmap per group and bucket, not their rows. Null ids are left out."""
    known = rows.where(F.col(key).isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("ids"))


def merge_sets(*sets: DataFrame, by: list[str]) -> DataFrame:
    """The union of sets of the same groups, of tables of any origin."""
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return every.groupBy(*by, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def sizes(sets: DataFrame, by: list[str]) -> DataFrame:
    """The number of ids of each group."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("ids")).alias("n"))


def running_sets(sets: DataFrame, day: str) -> DataFrame:
    """(day, bucket, ids, n_new): what each bucket holds by the end of each day on which it grew; days that add nothing are left out.

    A bucket is a partition of its own, with a row a day.
    """
    until = Window.partitionBy("bucket").orderBy(day)
    grown = sets.groupBy(day, "bucket").agg(F.bitmap_or_agg("ids").alias("ids")).withColumn("ids", F.bitmap_or_agg("ids").over(until))
    size = F.bitmap_count("ids")
    return grown.withColumn("n_new", size - F.lag(size, 1, 0).over(until)).where("n_new > 0")


def sets_on(running: DataFrame, day: str, at: Column | str) -> DataFrame:
    """(bucket, ids) by the end of the day ``at``: of each bucket its last row until then."""
    until = running.where(F.col(day) <= (F.lit(at).cast("date") if isinstance(at, str) else at))
    return until.groupBy("bucket").agg(F.max_by("ids", day).alias("ids"))


def members(sets: DataFrame, key: str = "zone_id") -> DataFrame:
    """A row for each id of each set, with the set's other columns."""
    others = [c for c in sets.columns if c not in ("bucket", "ids")]
    byte = lambda i: F.conv(F.hex(F.substring("ids", i + 1, F.lit(1))), 16, 10).cast("int")
    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.struct(i.alias("i"), byte(i).alias("byte"))), lambda x: x["byte"] > 0)
    bits = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(x["byte"], k) == 1), lambda k: x["i"] * 8 + k)
    out = sets.select(*others, "bucket", F.explode(F.flatten(F.transform(held, bits))).alias("at"))
    # Bucket 1 holds the ids from 1 to 32,768; from bucket 0 down they are counted away from zero.
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("at") + 1).otherwise(F.col("bucket") * 32768 - F.col("at"))
    return out.select(*others, number.alias(key))


def claimed_sets(flipped: DataFrame, start: str) -> DataFrame:
    """The zones that have flipped from ``start`` on, as running sets by day: a zone enters on its first flip and stays."""
    since = flipped.where(F.col("activity_date") >= F.lit(start).cast("date"))
    return running_sets(id_sets(since, ["activity_date"]), "activity_date")


def claimed_counts(claimed: DataFrame) -> DataFrame:
    """(activity_date, n_new, n_claimed) of the days on which a zone entered."""
    daily = claimed.groupBy("activity_date").agg(F.sum("n_new").alias("n_new"))
    return daily.withColumn("n_claimed", F.sum("n_new").over(Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)))
