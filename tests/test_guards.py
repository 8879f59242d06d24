"""Guards of written tables: a null or a number that does not fit leaves no table, and an old one as it was."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import keys
from driftline.plans import warehouse
from driftline.sources import contracts
from driftline.sources.guards import Guard, write_guarded


def _rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(str(path)).collect())


def _left(path):
    return sorted(os.listdir(path)) if os.path.exists(path) else []


@pytest.mark.parametrize(
    "guard, rows, says",
    [
        (Guard({"n": "uint8"}), [(1, 255), (2, 256)], "n is from 255 to 256, not from 0 to 255"),
        (Guard({"n": "uint31"}), [(1, 0), (2, -1)], "n is from -1 to 0, not from 0 to 2147483647"),
        (Guard({"n": "uint31"}), [(1, 2**31)], "n is from 2147483648"),
        (Guard({"n": "int8"}, ("n",)), [(1, None), (2, None)], "n holds 2 nulls"),
        (Guard({"n": "uint8"}, ("k", "n")), [(None, 300)], "k holds 1 nulls; n is from 300"),
    ],
)
def test_a_fault_leaves_no_table(spark, tmp_path, guard, rows, says):
    frame = spark.createDataFrame(rows, "k int, n long")
    with pytest.raises(ValueError, match=says):
        write_guarded(frame, f"{tmp_path}/t", guard)
    assert _left(tmp_path) == []
    write_guarded(frame.limit(0), f"{tmp_path}/t", guard)
    assert _rows(spark, tmp_path / "t") == []
    write_guarded(spark.createDataFrame([(1, 5)], frame.schema), f"{tmp_path}/t", guard)
    with pytest.raises(ValueError):
        write_guarded(frame, f"{tmp_path}/t", guard)
    assert _rows(spark, tmp_path / "t") == [(1, 5)] and _left(tmp_path) == ["t"]


def test_a_job_that_fails_leaves_no_table(spark, tmp_path):
    frame = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        write_guarded(frame, f"{tmp_path}/t", Guard())
    assert _left(tmp_path) == []


def test_dates_before_the_epoch(spark, tmp_path):
    frame = spark.sql("SELECT DATE'2012-01-01' AS day, 1 AS k")
    with pytest.raises(ValueError, match="day is before 2013-01-01"):
        write_guarded(frame, f"{tmp_path}/t", Guard(days=("day",), epoch="2013-01-01"))
    with pytest.raises(ValueError, match="day is from 65744 to 65744"):
        write_guarded(frame, f"{tmp_path}/t", Guard(days=("day",), epoch="1832-01-01"))


def test_shards_are_guarded(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2), (1, None)], "shard int, k int")
    with pytest.raises(ValueError, match="k holds 1 nulls"):
        contracts.write_sharded(frame, f"{tmp_path}/t", "shard", ["k"], Guard({"k": "uint8"}, ("shard", "k")))
    assert _left(tmp_path) == []
    contracts.write_sharded(frame, f"{tmp_path}/t", "shard", ["k"], Guard({"k": "uint8", "gone": "uint8"}, ("shard", "gone")).on(frame.columns))
    assert _left(tmp_path) == ["t"] and spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_merges_refuse_rows_without_a_key(spark, tmp_path):
    schema = "zone_id long, at int, year int"
    keys.merge_events(spark, spark.createDataFrame([(1, 1, 2020)], schema), f"{tmp_path}/t", ["zone_id", "at"])
    for row, says in (((None, 2, 2020), "zone_id holds 1"), ((2, None, 2020), "at holds 1"), ((2, 2, None), "year holds 1")):
        with pytest.raises(ValueError, match=says):
            keys.merge_events(spark, spark.createDataFrame([row, (1, 1, 2020)], schema), f"{tmp_path}/t", ["zone_id", "at"])
    assert _rows(spark, tmp_path / "t") == [(1, 1, 2020)]


def test_lookups_need_their_key(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\n,b\n")
    contract = T.StructType.fromDDL("id int, name string")
    with pytest.raises(ValueError, match="id holds 1 nulls"):
        contracts.ingest_lookups(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", contract)
    assert _left(tmp_path) == ["in.csv"]


def test_every_table_of_the_warehouse_is_guarded(spark, tmp_path):
    """The tables before the faulty one are there, it and those after it are not."""
    assert set(warehouse.GUARDS) == {*warehouse.LAYOUT, *warehouse.SMALL}
    dim = spark.sql("SELECT 1L AS zone_id, 'a' AS zone_name, 1 AS country_id, 'c' AS country_name, 1 AS region_id, 'r' AS region_name, 50.0D AS latitude, 1.0D AS longitude")
    spine = spark.sql("SELECT 1L AS zone_id, timestamp_ntz'2020-01-01' AS observed_at, 1 AS control_state, 4294967296L AS legion, 0L AS swarm, 0L AS faceless")
    index, days = spark.sql("SELECT 0L AS idx, 1L AS zone_id"), spark.sql("SELECT 1L AS zone_id, DATE'2020-01-01' AS activity_date, 1L AS legion, 0L AS swarm, 0L AS faceless")
    battles = spark.sql("SELECT 1L AS zone_id, DATE'2020-01-01' AS report_date, 5L AS launches, 1L AS players")
    small = [spark.sql(f"SELECT 1 AS {n}_id, 'x' AS {n}_name") for n in ("country", "region")]
    with pytest.raises(ValueError, match="legion is from 4294967296"):
        warehouse.write_warehouse(str(tmp_path / "w"), dim, spine, index, days, battles, *small)
    assert _left(tmp_path / "w") == ["zone"]
    fits = spine.withColumn("legion", F.lit(7).cast("long"))
    for launches, says in ((-1, "launches is from -1"), (2**31, "launches is from 2147483648"), (None, "launches holds 1 nulls")):
        with pytest.raises(ValueError, match=says):
            warehouse.write_warehouse(str(tmp_path / "w"), dim, fits, index, days, battles.withColumn("launches", F.lit(launches).cast("long")), *small)
        assert "maz" not in _left(tmp_path / "w")
    warehouse.write_warehouse(str(tmp_path / "w"), dim, fits, index, days, battles, *small)
    assert _left(tmp_path / "w") == sorted(warehouse.GUARDS)


def test_the_merged_table_is_read_without_its_layout(spark, tmp_path):
    keys.merge_events(spark, spark.createDataFrame([(1, 1, 2020), (2, 1, 2021)], "zone_id long, at int, year int"), f"{tmp_path}/t", ["zone_id", "at"])
    assert sorted(tuple(r) for r in contracts.read_changelog(spark, f"{tmp_path}/t").collect()) == [(1, 1), (2, 1)]
