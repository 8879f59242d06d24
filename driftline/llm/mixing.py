"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: target share * total documents / documents of the source. A document's count
is the Poisson quantile, at that rate, of a uniform number hashed from seed and id: the same on every run, and without
a draw that depends on other rows. A rate above ``MOST`` is split evenly over several draws, whose sum has the same
distribution. Documents are exploded by their count and shuffled by the hash of (seed, id, copy).
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .columns import fresh

#: exp(-rate) is a normal number up to here; higher rates are split into parts of at most ``PART``.
MOST, PART = 700, 500


def uniform(seed: int, *parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of an md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, rate, parts, cdf): the mean count of each source, the number of draws that it is split into and the
    Poisson distribution function of one draw at 0, 1, 2, ...

    Without ``weights`` all sources share alike; with them, sources left out get 0. ``total`` defaults to the number of documents.
    The distribution ends where what is left is under 1e-15.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("n_all"), F.count("*").alias("n_sources"))
    both = counts.join(F.broadcast(whole))
    if weights is None:
        share = F.lit(1.0) / F.col("n_sources")
    else:
        scale = sum(weights.values())
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(weight / scale)).otherwise(share)
    rate = share * (F.lit(float(total)) if total is not None else F.col("n_all").cast("double")) / F.col("n")
    both = both.select("source", rate.alias("rate"))
    both = both.withColumn("parts", F.when(F.col("rate") > MOST, F.ceil(F.col("rate") / PART)).otherwise(1).cast("int"))
    both = both.withColumn("each", F.col("rate") / F.col("parts"))
    top = F.ceil(F.col("each") + 12 * F.sqrt("each") + 20).cast("int")
    start = F.struct(F.exp(-F.col("each")).alias("p"), F.exp(-F.col("each")).alias("sum"), F.array(F.exp(-F.col("each"))).alias("cdf"))

    def add(acc, k):
        p = acc["p"] * F.col("each") / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + p)).alias("cdf"))

    return both.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), top), start, add)["cdf"].alias("cdf"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None, seed: int = 17) -> DataFrame:
    """``docs``, each row as often as its count says, with ``_copy`` (from 0) and ``_order``, globally shuffled.

    If ``docs`` has columns of these names, underscores are added to the new ones'. Rows of equal ids have equal counts, rows that
    repeat an id are drawn each. Null sources are one source, null ids count as empty text. Texts are not looked at. Every
    rate works. An empty table gives an empty table.

    The table of rates is written first: Spark sees its size, and sends it to all tasks while it is small enough, so that documents are
    not moved by source.
    """
    copy, order, source, parts, cdf, u, others, n = fresh(docs.columns, "_copy", "_order", "_source", "_parts", "_cdf", "_u", "_others", "_n")
    table = materialize(rates(docs, source_col, weights, total), "rates")
    table = table.select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    drawn = docs.join(table, F.col(source_col).eqNullSafe(F.col(source)))
    count = lambda x: F.size(F.filter(cdf, lambda c: c <= x))
    # All draws but the first have their own text to hash.
    draws = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda k: uniform(seed, F.lit("draw"), k, F.col(id_col)))
    drawn = drawn.withColumn(u, uniform(seed, F.col(id_col))).withColumn(others, F.when(F.col(parts) > 1, draws))
    more = F.when(F.col(others).isNotNull(), F.aggregate(others, F.lit(0), lambda k, x: k + count(x))).otherwise(0)
    drawn = drawn.withColumn(n, count(F.col(u)) + more).where(F.col(n) > 0)
    copies = drawn.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    copies = copies.withColumn(order, uniform(seed + 1, F.col(id_col), F.col(copy)))
    return copies.repartition(order, copy).sortWithinPartitions(order, id_col, copy)
