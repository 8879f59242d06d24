"""Names of areas: JSON lookups keyed by id, search, named periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_json(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One JSON object a row, ``{"<key>": [values as text]}``: a file of such lines needs no task that holds them all.

    Rows without a key are left out; null values are kept as null.
    """
    entry = F.create_map(F.col(key).cast("string"), F.array(*(F.col(v).cast("string") for v in values)))
    return df.where(F.col(key).isNotNull()).select(F.to_json(entry).alias("value"))


def read_lookup_json(lines: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """The table behind JSON objects keyed by id, one or many keys an object; ``values`` has types by name.

    Lines that are no such object give no row.
    """
    rows = lines.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("id", "cells"))
    return rows.select(F.col("id").cast("long").alias(key), *(F.get("cells", F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(values.items())))


def search_areas(df: DataFrame, needle: str, label: str = "label", detail: str = "detail", key: str = "zone_id", n: int = 40) -> DataFrame:
    """The first ``n`` rows by (label, key) whose label or detail holds ``needle`` in any case; a blank one finds all."""
    wanted = F.lit(needle.strip().lower())
    return df.where(F.lower(label).contains(wanted) | F.lower(detail).contains(wanted)).orderBy(label, key).limit(n)


def period_bounds(periods: DataFrame, record: DataFrame, day: str = "activity_date") -> DataFrame:
    """(label, first_day, last_day): named periods inside the record, an open end being the record's own.

    A period that ends up without length lasts one day more, as a span must have one; without a record there are no rows.
    """
    span = record.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo IS NOT NULL")
    rows = periods.join(F.broadcast(span)).select("label", F.greatest("start", "lo").alias("first_day"), F.least("end", "hi").alias("b"))
    return rows.select("label", "first_day", F.when(F.col("b") > F.col("first_day"), F.col("b")).otherwise(F.date_add("first_day", 1)).alias("last_day"))


def period_activity(bounds: DataFrame, daily: DataFrame) -> DataFrame:
    """Net changes and events of each named period; ``bounds`` has a row per name, ``daily`` a row per day."""
    rows = daily.join(F.broadcast(bounds), F.col("activity_date").between(F.col("first_day"), F.col("last_day")))
    sums = rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("legion_delta", "swarm_delta", "faceless_delta", "n_events")))
    return bounds.join(sums, "label", "left").na.fill(0)
