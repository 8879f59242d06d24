"""Registered queries that read the given events as a stream of drops, in several runs on one checkpoint, with their batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import adapters as A
from ..streaming import ingest
from .scratch import new_path

FAR = "36500 days"


def _finish(stream: DataFrame, out: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _paths(m, *names: str) -> list[str]:
    return [new_path(m.spark, f"stream_{name}") for name in names]


def _events(m) -> DataFrame:
    return A.table(m.spark, m.sf_dir, "events").select("user_id", "ts", "event_id")


def _merge(m) -> DataFrame:
    """Drops merged by year. The second run meets new drops and the first ones again, the third run nothing; a fourth, on a new
    checkpoint, meets all of them once more."""
    rows = _events(m)
    drops, root, checkpoint, other = _paths(m, "drops", "table", "checkpoint", "other")
    run = lambda at: ingest.merge_stream(ingest.drops(m.spark, drops, rows.schema), root, at, "ts", "user_id").awaitTermination()
    for part in (rows.where("event_id % 3 = 0"), rows.where("event_id % 3 < 2"), rows.where("event_id % 3 = 2")):
        part.coalesce(2).write.mode("append").parquet(drops)
        run(checkpoint)
    run(checkpoint)
    run(other)
    return m.spark.read.parquet(root).groupBy("year").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _dedupe(m) -> DataFrame:
    """Every event comes twice in one batch, and a third of them again in the next one."""
    rows = _events(m)
    drops, out, checkpoint = _paths(m, "drops", "out", "checkpoint")
    for part in (rows.where("event_id % 3 > 0"), rows.where("event_id % 3 < 2")):
        part.unionByName(part).write.mode("append").parquet(drops)
        unique = ingest.deduplicated(ingest.drops(m.spark, drops, rows.schema, 1 << 20), "user_id", "ts", FAR)
        _finish(unique, out, checkpoint)
    return m.spark.read.schema(unique.schema).parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _trailing(m) -> DataFrame:
    rows = _events(m).select("user_id", "ts")
    out, checkpoint = _paths(m, "out", "checkpoint")
    counts = ingest.trailing_counts(ingest.drops(m.spark, f"{m.sf_dir}/events.parque[t]", rows.schema, 1 << 20), "user_id", "ts", 7, "0 seconds")
    _finish(counts, out, checkpoint)
    return m.spark.read.schema(counts.schema).parquet(out)


def _streaks(m) -> DataFrame:
    rows = _events(m).select("user_id", "ts")
    out, checkpoint = _paths(m, "out", "checkpoint")
    runs = ingest.streaks(ingest.drops(m.spark, f"{m.sf_dir}/events.parque[t]", rows.schema, 1 << 20), "user_id", "ts", "0 seconds")
    _finish(runs, out, checkpoint)
    return m.spark.read.schema(runs.schema).parquet(out)


BUILD = {"stream_merge": _merge, "stream_dedupe": _dedupe, "stream_trailing": _trailing, "stream_streaks": _streaks}

ORACLE = {
    "stream_merge": "SELECT year(ts) AS year, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1",
    "stream_dedupe": "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1",
    "stream_trailing": """SELECT CAST(day AS DATE) AS day, user_id, count(*) AS n FROM (SELECT user_id, unnest(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + 6, INTERVAL 1 DAY)) AS day FROM events)
        WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""",
    "stream_streaks": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
        SELECT user_id, min(day) AS first_day, CAST(count(*) AS INTEGER) AS n_days FROM g GROUP BY user_id, island HAVING max(day) + 1 <= (SELECT max(day) FROM d)""",
}
