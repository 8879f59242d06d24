"""Guards of written tables: nulls and numbers that do not fit are found in the write's own pass, and a table that fails is never there.

Rows are written beside the table's place, with their extremes observed on the way; only when those have passed does the new table
take the place of the old one. A failed write leaves the old table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import EPOCH

#: Least and greatest number by the name of a width.
WIDTHS = {
    "uint8": (0, 255), "uint16": (0, 65535), "uint31": (0, 2147483647), "uint32": (0, 4294967295),
    "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647),
}


@dataclass(frozen=True)
class Guard:
    """``widths`` of whole-number columns, columns that hold no null, and dates that are stored as days since ``epoch`` in 16 bits."""

    widths: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    days: tuple[str, ...] = ()
    epoch: str = EPOCH

    def on(self, columns: list[str]) -> Guard:
        """The guard of those columns alone, for tables that may lack some."""
        return replace(self, widths={c: w for c, w in self.widths.items() if c in columns}, required=tuple(c for c in self.required if c in columns), days=tuple(c for c in self.days if c in columns))

    def metrics(self) -> list[Column]:
        """What is observed: bounded by the number of columns."""
        numbers = {c: F.col(c).cast("long") for c in self.widths} | {c: F.datediff(c, F.lit(self.epoch).cast("date")).cast("long") for c in self.days}
        ends = [part for c, x in numbers.items() for part in (F.min(x).alias(f"least {c}"), F.max(x).alias(f"most {c}"))]
        # At least one metric, also for a guard that asks for nothing.
        return [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"nulls {c}") for c in self.required), *ends]

    def faults(self, seen: dict) -> list[str]:
        out = [f"{c} holds {seen[f'nulls {c}']} nulls" for c in self.required if seen.get(f"nulls {c}")]
        for c, (least, most) in [(c, WIDTHS[w]) for c, w in self.widths.items()] + [(c, WIDTHS["uint16"]) for c in self.days]:
            low, high = seen.get(f"least {c}"), seen.get(f"most {c}")
            if low is None or (low >= least and high <= most):
                continue
            out.append(f"{c} is before {self.epoch}" if c in self.days and low < 0 else f"{c} is from {low} to {high}, not from {least} to {most}")
        return out


def observed(df: DataFrame, guard: Guard, write: Callable[[DataFrame], None]) -> None:
    """Write ``df`` by ``write``, which has to run one job over all rows; raises if the guard finds a fault in what was written."""
    seen = Observation()
    write(df.observe(seen, *guard.metrics()))
    if found := guard.faults(seen.get):
        raise ValueError("; ".join(found))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def write_guarded(df: DataFrame, path: str, guard: Guard, partition: str | None = None) -> None:
    """Write ``df`` as the Parquet table ``path``, in place of what is there, if ``guard`` finds no fault in it."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def write(rows: DataFrame) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(staging)

    try:
        observed(df, guard, write)
    except BaseException:
        remove(spark, staging)
        raise
    remove(spark, path)
    files, at = _files(spark, staging)
    target = _files(spark, path)[1]
    files.mkdirs(target.getParent())
    if not files.rename(at, target):
        raise OSError(f"cannot put {staging} at {path}")
