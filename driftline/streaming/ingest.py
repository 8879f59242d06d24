"""The nightly batch rules as streams: idempotent merges, late rows, daily and trailing counts, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import last_wins, merge_events
from ..plans.scratch import materialize
from ..sources.guards import Guard


def drops(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_stream(changes: DataFrame, root: str, checkpoint: str, ts: str = "observed_at", key: str = "zone_id") -> StreamingQuery:
    """Merge each micro-batch into the table partitioned by year; a batch that is run again, and a drop that comes twice, add nothing."""

    def put(batch: DataFrame, _: int) -> None:
        merge_events(batch.sparkSession, batch.withColumn("year", F.year(ts)), root, [key, ts])

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS = 64


def state_stream(changes: DataFrame, root: str, checkpoint: str, ts: str = "observed_at", key: str = "zone_id") -> StreamingQuery:
    """Keep the newest row per key under ``root``; a late row never rolls a key back.

    Keys lie in ``BUCKETS`` buckets. A batch reads and writes the buckets of its own keys only, as version ``n`` of them; what it does
    is the same when it is run again. ``read_state`` takes the newest version of each bucket. Versions that not even a
    batch that is run again would read go, so a bucket has two at most.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        versions = _versions(spark, root)
        old = _read_versions(spark, root, rows.schema, {b: max((v for v in versions.get(b, ()) if v < number), default=None) for b in touched})
        merged = materialize(last_wins(old, rows, [key], [ts]), "state", Guard(required=(key, "bucket")))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/version={number}")
        _forget(spark, root, versions, number)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The versions of each bucket, from the names of folders: at most two of each, whatever the table holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/bucket=*")
    out: dict[int, list[int]] = {}
    for found in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ():
        bucket = found.getPath()
        out.setdefault(int(bucket.getName().partition("=")[2]), []).append(int(bucket.getParent().getName().partition("=")[2]))
    return out


def _read_versions(spark: SparkSession, root: str, schema: T.StructType, wanted: dict[int, int | None]) -> DataFrame:
    paths = [f"{root}/version={v}/bucket={b}" for b, v in wanted.items() if v is not None]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", root).schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])).parquet(*paths).select(schema.names)


def _forget(spark: SparkSession, root: str, versions: dict[int, list[int]], number: int) -> None:
    """Delete what batch ``number`` would not read if it came again: all versions of a bucket but the newest before it."""
    jvm = spark.sparkContext._jvm
    for bucket, held in versions.items():
        earlier = sorted(v for v in held if v < number)
        for version in earlier[:-1]:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/version={version}/bucket={bucket}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_state(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The state that ``state_stream`` keeps: one row per key, with the columns of the changes. Read it between runs: a run deletes old versions."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return _read_versions(spark, root, full, {b: max(held) for b, held in _versions(spark, root).items()}).drop("bucket")


def deduplicated(changes: DataFrame, key: str = "zone_id", ts: str = "observed_at", delay: str = "1 day") -> DataFrame:
    """One row per key and time, as long as equal rows come within ``delay`` of each other; state is dropped after that."""
    return changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, ts])


def daily_counts(changes: DataFrame, by: str, ts: str = "observed_at", delay: str = "1 day") -> DataFrame:
    """Events per day and ``by``; a day comes out once the watermark has passed its end."""
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, "1 day"), by).agg(F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("day"), by, "n")


def trailing_counts(changes: DataFrame, key: str = "zone_id", ts: str = "observed_at", days: int = 31, delay: str = "1 day") -> DataFrame:
    """Appearances of each key in the ``days`` up to each day."""
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, f"{days} days", "1 day"), key).agg(F.count("*").alias("n"))
    return out.select(F.date_sub(F.to_date("window.end"), 1).alias("day"), key, "n")


def streaks(changes: DataFrame, key: str = "zone_id", ts: str = "observed_at", delay: str = "2 days") -> DataFrame:
    """Runs of consecutive active days, as session windows over midnights."""
    rows = changes.withColumn("midnight", F.date_trunc("day", F.col(ts).cast("timestamp"))).withWatermark("midnight", delay)
    out = rows.groupBy(F.session_window("midnight", "1 day"), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.to_date("session_window.start").alias("first_day"), F.datediff(F.to_date("session_window.end"), F.to_date("session_window.start")).alias("n_days"))


def stateful_deltas(changes: DataFrame, key: str = "zone_id", ts: str = "observed_at", col: str = "total") -> DataFrame:
    """Difference of ``col`` to the key's previous row, kept in state across batches.

    Rows of a batch are taken in order of time. A row older than the last one of its key gets no delta (null): the
    batch spine is what counts for late rows.
    """

    def run(keys, frames, state):
        import pandas as pd

        last_ts, last = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(ts)
        out = []
        for at, value in zip(rows[ts], rows[col]):
            micros = int(at.value // 1000)
            late = last_ts is not None and micros < last_ts
            out.append((keys[0], at, value, None if late else int(value) - last))
            if not late:
                last_ts, last = micros, int(value)
        state.update((last_ts, last))
        frame = pd.DataFrame(out, columns=[key, ts, col, "delta"])
        yield frame.astype({"delta": "Int64"})

    rows = changes.select(F.col(key).cast("long"), F.col(ts).cast("timestamp"), F.col(col).cast("long"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {ts} timestamp, {col} long, delta long", "at long, last long", "append", "NoTimeout")
