"""Streams in several runs on one checkpoint: nothing twice, nothing lost, bounded state."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.streaming import deltas, ingest


def _at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def _run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_drops_that_come_again_add_nothing(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp, v int"
    drops = [[(1, _at(1), 1), (2, _at(1), 1)], [(1, _at(2), 2), (1, _at(1), 1)], [(1, _at(1), 1), (2, _at(1), 1)]]
    for rows in drops:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            ingest.merge_stream(ingest.drops(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/table", f"{tmp_path}/c").awaitTermination()
    ingest.merge_stream(ingest.drops(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/table", f"{tmp_path}/other").awaitTermination()
    assert sorted((r.zone_id, r.observed_at.day, r.v) for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_dedupe_over_batches_forgets_after_the_delay(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp"
    drops = [[(1, _at(1)), (1, _at(1)), (2, _at(1))], [(1, _at(1)), (3, _at(9))], [(3, _at(9)), (4, _at(9))]]
    sizes = []
    for rows in drops:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = _run(ingest.deduplicated(ingest.drops(spark, f"{tmp_path}/in", frame.schema)), f"{tmp_path}/out", f"{tmp_path}/c")
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.zone_id, r.observed_at.day) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1), (2, 1), (3, 9), (4, 9)]
    assert sizes[-1] == 2


def test_sliding_counts_and_streaks_come_once_over_runs(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp"
    drops = [[(1, _at(1, 5)), (1, _at(2, 7)), (2, _at(2)), (1, _at(4))], [(1, _at(5, 3)), (2, _at(12))], [(3, _at(28))]]
    for rows in drops:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = lambda: ingest.drops(spark, f"{tmp_path}/in", frame.schema)
        _run(ingest.trailing_counts(source(), days=3, delay="1 hour"), f"{tmp_path}/trailing", f"{tmp_path}/c1")
        _run(ingest.streaks(source(), delay="1 hour"), f"{tmp_path}/streaks", f"{tmp_path}/c2")
    trailing = sorted((r.zone_id, r.day.day, r.n) for r in spark.read.parquet(f"{tmp_path}/trailing").collect())
    days = {1: [1, 2, 4, 5], 2: [2, 12]}
    wanted = sorted((zone, d, n) for zone, on in days.items() for d in range(1, 28) if (n := sum(d - 3 < x <= d for x in on)))
    assert trailing == wanted
    streaks = sorted((r.zone_id, r.first_day.day, r.n_days) for r in spark.read.parquet(f"{tmp_path}/streaks").collect())
    assert streaks == [(1, 1, 2), (1, 4, 2), (2, 2, 1), (2, 12, 1)]


def test_deltas_survive_restarts_and_hold_little(spark, tmp_path):
    """Each batch is a run of its own; the levels of a day long past go, and a quiet key keeps one row."""
    schema = "zone_id long, observed_at timestamp, total long"
    rows = [[(zone, _at(day), zone * 100 + day * day) for zone in (1, 2)] for day in range(1, 13)]
    rows += [[(1, _at(day), 100 + day * day)] for day in range(13, 16)]
    sizes = []
    for batch in rows:
        frame = spark.createDataFrame(batch, schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        given = deltas.corrected_deltas(ingest.drops(spark, f"{tmp_path}/in", frame.schema), keep_days=3, idle_days=0)
        with deltas.map_state(spark):
            query = _run(given, f"{tmp_path}/out", f"{tmp_path}/c")
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    got = {(r.zone_id, r.observed_at.day): r.delta for r in deltas.settled(spark.read.schema(given.schema).parquet(f"{tmp_path}/out")).collect()}
    assert got == {(z, d): (z * 100 + 1 if d == 1 else d * d - (d - 1) * (d - 1)) for z in (1, 2) for d in range(1, 13 if z == 2 else 16)}
    # Levels, versions and timers of two keys.
    assert max(sizes) <= 2 * (5 + 1 + 4)


def test_state_keeps_two_versions_of_a_bucket(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp, v int"
    for k in range(6):
        spark.createDataFrame([(1, _at(1 + k), k), (2 + k, _at(1), k)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = ingest.drops(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
        ingest.state_stream(source, f"{tmp_path}/state", f"{tmp_path}/c").awaitTermination()
    held = ingest._versions(spark, f"{tmp_path}/state")
    assert max(len(v) for v in held.values()) <= 2 and sum(map(len, held.values())) >= len(held)
    got = {r.zone_id: r.v for r in ingest.read_state(spark, f"{tmp_path}/state", spark.createDataFrame([], schema).schema).collect()}
    assert got == {1: 5} | {2 + k: k for k in range(6)}
    # A batch that comes again reads what it read before, although newer versions exist.
    bucket = next(b for b, v in held.items() if len(v) == 2)
    assert sorted(held[bucket]) == [4, 5]


@pytest.mark.parametrize("name", ["stream_merge", "stream_dedupe", "stream_trailing", "stream_streaks"])
def test_stream_queries_have_rows(spark, name):
    from driftline.plans import queries, stream_queries

    got = stream_queries.BUILD[name](queries.Model(spark, "/root/testdata/sf0.001"))
    assert got.agg(F.count("*")).first()[0] > 0


class _Store:
    """Map states, a value state and timers in memory; ``calls`` counts the round trips that a state store would have."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls = {}, None, [], 0

    def getMapState(self, name, *_):
        self.maps[name] = held = {}

        def counted(call):
            def run(*args):
                self.calls += 1
                return call(*args)

            return run

        calls = {"getValue": held.get, "updateValue": held.__setitem__, "removeKey": held.__delitem__, "iterator": lambda: iter(list(held.items()))}
        return SimpleNamespace(**{n: counted(c) for n, c in calls.items()})

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):
        self.timers.append(at)

    def chunks(self, key):
        """The chunks of a key, in order; the newest lies with the key."""
        older = [rows for (k, _), (rows,) in sorted(self.maps["older"].items()) if k == key]
        return [np.frombuffer(rows, "int64").reshape(2, -1) for rows in (*older, self.maps["heads"][(key,)][5])]


def _give(run, key, at, level, arrival=0):
    frame = pd.DataFrame({"key": key, "at": at, "level": level, "arrival": arrival})
    return pd.concat(run.handleInputRows((1,), iter([frame]), None))


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_chunks_give_what_single_rows_give(monkeypatch, chunk):
    """Batches in any order, with rows that come again: deltas and state are those of the rows that are kept, however they are cut."""
    monkeypatch.setattr(deltas, "CHUNK", chunk)
    draw = np.random.default_rng(chunk)
    for reach in (4, 40, 10**9):
        store, run = _Store(), deltas.Deltas("k", "v", reach, 10**9)
        run.init(store)
        rows, floor, got, wanted = {}, None, {}, {}
        for step in range(15):
            batch = {int(t): int(v) for t, v in zip(draw.integers(0, 30 + 5 * step, 12), draw.integers(0, 99, 12))}
            # Another key of the bucket has the same times and changes nothing.
            out = _give(run, [7, 8] * len(batch), np.repeat(list(batch), 2), np.repeat(list(batch.values()), 2), step)
            got |= {t: None if d is pd.NA else d for t, d in zip(out["at"][out["k"] == 7], out["delta"][out["k"] == 7])}
            early = [t for t in batch if floor is not None and t < floor]
            wanted |= dict.fromkeys(early)
            rows |= {t: v for t, v in batch.items() if t not in early}
            times = sorted(rows)
            wanted |= {t: rows[t] - (rows[times[i - 1]] if i else 0) for i, t in enumerate(times) if floor is None or i}
            kept = times[max(sum(t < times[-1] - reach for t in times) - 1, 0) :]
            floor = kept[0] if len(kept) < len(times) or floor is not None else None
            rows = {t: rows[t] for t in kept}
            assert max(part.shape[1] for part in store.chunks(7)) <= chunk
            assert dict(np.concatenate(store.chunks(7), axis=1).T.tolist()) == dict(np.concatenate(store.chunks(8), axis=1).T.tolist()) == rows
            assert got == wanted


def test_state_is_called_by_chunks_not_by_rows():
    store, run = _Store(), deltas.Deltas("k", "v", 10**9, 10**9)
    run.init(store)
    for odd in (0, 1):
        out = _give(run, 7, range(odd, 4000, 2), range(odd, 4000, 2), odd)
        assert len(out) == (2000 if odd == 0 else 3999) and store.calls <= 30
    before = store.calls
    _give(run, 7, [4001], [1])
    assert store.calls - before <= 4
    for key in range(100, 200):
        _give(run, key, range(30), range(30))
    assert store.calls - before <= 4 + 100 * 2
    assert len(store.timers) == 1


def test_a_bucket_forgets_its_quiet_keys_alone():
    """A late timer keeps the newest row of keys without rows for ``idle``, and comes again for the rest."""
    store, run = _Store(), deltas.Deltas("k", "v", 10**9, 100)
    run.init(store)
    for key, arrival in ((1, 0), (2, 90)):
        _give(run, key, range(5), range(5), arrival)
    list(run.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 100), None))
    assert [store.chunks(k)[0].shape[1] for k in (1, 2)] == [1, 5] and store.timers == [100, 190]
    assert _give(run, 1, [2, 9], [50, 9], 200)["delta"].tolist() == [pd.NA, 5]
    list(run.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 400), None))
    assert [store.chunks(k)[0].tolist() for k in (1, 2)] == [[[9], [9]], [[4], [4]]] and store.timers == [100, 190] and store.value is None


def test_keys_that_are_null_are_one_key(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp, total long"
    spark.createDataFrame([(None, _at(1), 5), (0, _at(2), 7), (None, _at(3), 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    given = deltas.corrected_deltas(ingest.drops(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema))
    with deltas.map_state(spark):
        _run(given, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r.zone_id, r.observed_at.day, r.delta) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(None, 1, 5), (None, 3, 4), (0, 2, 7)}
