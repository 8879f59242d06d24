"""Importance resampling of documents towards a target corpus, without replacement.

Hashed word counts of documents and target give each bucket a gain, the log of its smoothed odds in thousandths: an
array of ``buckets`` integers. A document's weight is the mean gain of its features, its score adds Gumbel noise that
depends on its id alone, and the highest scores are drawn. The last score that is drawn is found by distributed
quickselect: random pivot keys, exact counts of the keys below, at and above each, then the same within the one part that
holds the k-th key. Only the keys up to that one are sorted, by range partitions, and numbered.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.scratch import materialize
from .columns import fresh
from .text import IS_ALNUM, LOWER

#: Bytes to lower case, all that is no letter, digit or part of a longer character to a space.
_WORDS = bytes(np.where(IS_ALNUM == 1, LOWER, 32).astype(np.uint8))
KEY = ("below", "id", "n_features", "weight")


def features(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and all its runs of 1 to ``longest`` words."""
    words = (text or "").encode().translate(_WORDS).split()
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def _buckets(runs: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a task sends one row a bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_buckets(features(text.as_py(), longest)[1], buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """The gain of every bucket. The driver reads two arrays of ``buckets`` numbers, whatever the tables hold."""
    spark = docs.sparkSession
    per = [bucket_counts(t, text_col, longest, buckets).withColumnRenamed("n", n) for t, n in ((docs, "s"), (target, "t"))]
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(per[0], "bucket", "left").join(per[1], "bucket", "left").fillna(0)
    sums = Window.partitionBy()
    s, t = (F.col(c).cast("double") for c in "st")
    all_s, all_t = (F.sum(c).over(sums).cast("double") for c in "st")
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    out = np.zeros(buckets, np.int64)
    for bucket, value in both.select("bucket", gain).collect():
        out[bucket] = value
    return out


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every document; the weight is 0 without features."""

    def of(batches):
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                n, runs = features(text.as_py(), longest)
                rows[:, i] = n, len(runs), gains[_buckets(runs, len(gains))].sum() // len(runs) if runs else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], ["id", "n_words", "n_features", "weight"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([ids.schema["id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return ids.mapInArrow(of, schema)


def _key_at(row: tuple, schema: StructType) -> Column:
    return F.struct(*(F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(KEY, row)))


def kth_key(keys: DataFrame, k: int, pivots: int = 32) -> tuple | None:
    """The ``k``-th smallest key (from 1) of a table of ``KEY`` columns, None if it has fewer; equal keys count each.

    Every round draws up to ``pivots`` keys by a hash that the round seeds, and counts the keys between and at them.
    What the driver sees is bounded by ``pivots``. Lost tasks repeat with the same pivots and counts.
    """
    key, low, high, before, turn = F.struct(*KEY), None, None, 0, 0
    while True:
        turn += 1
        part = keys
        if low is not None:
            part = part.where(key > _key_at(low, keys.schema))
        if high is not None:
            part = part.where(key < _key_at(high, keys.schema))
        drawn = F.xxhash64(F.lit(turn), *KEY)
        chosen = part.groupBy(F.pmod(drawn, F.lit(pivots)).alias("slot")).agg(F.min_by(key, drawn).alias("key")).select("key.*").distinct()
        rows = sorted(tuple(r) for r in chosen.collect())
        if not rows:
            return None
        at = F.array(*(_key_at(r, keys.schema) for r in rows))
        place = F.aggregate(at, F.lit(0), lambda n, p: n + F.when(p < key, 2).when(p == key, 1).otherwise(0))
        found = dict(part.groupBy(place.alias("place")).count().collect())
        for place in range(2 * len(rows) + 1):
            if before + found.get(place, 0) >= k:
                break
            before += found.get(place, 0)
        else:
            return None
        if place % 2:
            return rows[place // 2]
        low = rows[place // 2 - 1] if place else low
        high = rows[place // 2] if place // 2 < len(rows) else high


def numbered(keys: DataFrame) -> DataFrame:
    """``keys`` with ``rank``, from 1 in order of ``KEY``: range partitions, the place within each, and offsets of the partitions."""
    ranged = keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranked_keys").withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # One row a partition: bounded by the number of partitions.
    return ranged.join(F.broadcast(offsets), "part").select(*keys.columns, rank.alias("rank"))


def score_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: str = "10/100", least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every document; ``rank`` is null for those that are not drawn.

    Of the N documents with at least ``least_words`` words, floor(fraction * N) with the highest scores are drawn; ties go
    to the smaller id, then to fewer features. Null texts have no words. A null id has no score, is not counted in N and never
    drawn. Rows that repeat an id are ranked each, by their own texts, with the same noise. Without target texts all gains
    still count (smoothing). An empty table gives an empty table; columns besides id and text do not matter.
    """
    gains = bucket_gains(docs, target, text_col, longest, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = materialize(weigh(docs, gains, id_col, text_col, longest).withColumn("score", score.cast("long")).withColumn("below", -F.col("score")), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    keys = scored.where(able).select(*KEY)
    share = Fraction(fraction)
    k = keys.count() * share.numerator // share.denominator
    last = kth_key(keys, k) if k else None
    columns = [F.col("id").alias(id_col), "n_features", "weight"]
    if last is None:
        return scored.select(*columns, "score", F.lit(None).cast("long").alias("rank"))
    top = able & (F.struct(*KEY) <= _key_at(last, scored.schema))
    # Keys equal to the last one may be more than are left to draw; they differ in nothing, so any of them may go.
    ranked = numbered(scored.where(top).select(*KEY)).select(*columns, (-F.col("below")).alias("score"), F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(top, F.lit(False))).select(*columns, "score", F.lit(None).cast("long").alias("rank")))


def draw_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", rank_col: str | None = None, **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns and ``rank_col`` (a free name like ``rank`` by default).

    Takes the parameters of ``score_documents``. Rows that repeat an id are drawn together, at the better rank.
    """
    name = rank_col or fresh(docs.columns, "rank")[0]
    (own,) = fresh([*docs.columns, name], "drawn_id")
    drawn = score_documents(docs, target, id_col=id_col, **how).where("rank is not null").groupBy(F.col(id_col).alias(own)).agg(F.min("rank").alias(name))
    return docs.join(drawn, F.col(id_col) == F.col(own)).drop(own)
