"""Keys and merges: stable indexes, keyed merges, plans of what is missing, delta codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.guards import Guard


def stable_index(previous: DataFrame, ids: DataFrame) -> DataFrame:
    """(idx, zone_id): old numbers stay, removed ids keep theirs, new ids get the next ones in order of id.

    New ids are numbered by range partitions and offsets, so that no task sorts all of them.
    """
    new = ids.select("zone_id").distinct().join(previous, "zone_id", "left_anti")
    ranged = materialize(new.repartitionByRange("zone_id").withColumn("part", F.spark_partition_id()), "new-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    top = previous.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("top"))
    w = Window.partitionBy("part").orderBy("zone_id")
    numbered = ranged.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(top)).join(offsets, "part")
    added = numbered.select((F.col("k") + F.col("base") + F.col("top")).cast("long").alias("idx"), "zone_id")
    return previous.select(F.col("idx").cast("long").alias("idx"), "zone_id").unionByName(added)


def last_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of both tables, one per key: the greatest by ``order`` (nulls lowest), incoming before existing."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_src"]
    tie = F.struct(*(F.col(c).isNotNull() for c in (order or [])), *(F.col(c) for c in (order or [])), F.col("_src"), F.to_json(F.struct(*cols)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), tie).alias("_row")).select(*keys, "_row.*").select(*cols)


def merge_events(spark: SparkSession, incoming: DataFrame, root: str, keys: list[str], partition: str = "year") -> dict[int, int]:
    """Merge rows into a table partitioned by ``partition``; returns rows added per partition. Running it twice adds nothing.

    Only partitions that ``incoming`` touches are read and rewritten. The merged rows are written beside the table first:
    a path cannot be overwritten while it is being read. An incoming row wins over an equal key. A row without one of its
    keys or its partition is an error, and the table stays as it is.
    """
    incoming = materialize(incoming, "incoming", Guard(required=(*keys, partition)))
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    if not touched:
        return {}
    try:
        existing = spark.read.schema(incoming.schema).parquet(root).where(F.col(partition).isin(touched))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = incoming.limit(0)
    before = {r[0]: r[1] for r in existing.groupBy(partition).count().collect()}
    merged = materialize(last_wins(existing, incoming, keys), "merged")
    (merged.repartitionByRange(partition, *keys).sortWithinPartitions(partition, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(root))
    return {r[0]: r[1] - before.get(r[0], 0) for r in merged.groupBy(partition).count().collect()}


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key, the newest by ``ts``; a null never displaces a stamped row, equal stamps go to the incoming row."""
    return last_wins(existing, incoming, [key], [ts])


def merge_reports(existing: DataFrame, incoming: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per key, the incoming before the existing one; columns that only one table has are null in rows of the other."""
    return last_wins(existing, incoming, [key])


def plan_days(events: DataFrame, today: str, ring: bool = True, day: str = "activity_date") -> DataFrame:
    """Days to fetch: from the newest event's day, included, to yesterday.

    With ``ring``, two days with the same number in their months are refused: the source has overwritten one of them.
    No history is refused too.
    """
    span = events.agg(F.max(day).alias("have")).select("have", F.date_sub(F.lit(today).cast("date"), 1).alias("until"))
    row = span.collect()[0]
    if row["have"] is None:
        raise ValueError("no history: nothing tells where to resume")
    days = span.where("have <= until").select(F.explode(F.sequence("have", "until")).alias(day))
    if ring and not days.groupBy(F.dayofmonth(day)).count().where("count > 1").isEmpty():
        raise ValueError("the gap spans two days with the same number; one of them is lost")
    return days


def plan_targets(listed: DataFrame, have: DataFrame, checked: int, cap: int = 40) -> DataFrame:
    """Numbers to fetch: listed ones and those between the last known or checked and the last listed, without those at hand."""
    ends = listed.agg(F.max("n").alias("top")).join(F.broadcast(have.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(checked)).alias("low"))))
    between = ends.where("low < top").select(F.explode(F.sequence(F.col("low") + 1, F.col("top"))).alias("n"))
    return listed.select("n").unionByName(between).distinct().join(have, "n", "left_anti").orderBy("n").limit(cap)


def extract_links(pages: DataFrame, pattern: str = r'href="/([^"]*)"') -> DataFrame:
    """Distinct link targets of HTML pages."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("link")).distinct()


def name_blocks(named: DataFrame, size: int = 64) -> DataFrame:
    """Names by block of ``size`` indexes, placed by index; gaps are empty strings."""
    last = named.agg(F.max("idx")).first()[0]
    spine = named.sparkSession.range(0 if last is None else last + 1).withColumnRenamed("id", "idx")
    rows = spine.join(named, "idx", "left").select((F.floor(F.col("idx") / size)).cast("int").alias("block"), "idx", F.coalesce("name", F.lit("")).alias("name"))
    return rows.groupBy("block").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"])).alias("names"))


def delta_encode(df: DataFrame, part: str, order: str, col: str, signed: bool = True) -> DataFrame:
    """First differences from 0; without ``signed`` a falling column is an error."""
    w = Window.partitionBy(part).orderBy(order)
    out = df.withColumn("delta", F.col(col) - F.lag(col, 1, 0).over(w))
    if not signed:
        out = out.withColumn("delta", F.when(F.col("delta") < 0, F.raise_error(F.lit(f"{col} falls"))).otherwise(F.col("delta")))
    return out


def delta_decode(df: DataFrame, part: str, order: str, delta: str = "delta") -> DataFrame:
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("level", F.sum(F.col(delta).cast("long")).over(w))
