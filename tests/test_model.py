"""The state-change operators on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import checks, flashpoints, geo, history, keys, lookups, reports, series, spine
from driftline.plans import warehouse
from driftline.sources import contracts, pages, staging
from driftline.streaming import deltas, ingest, monitor


def _changes(spark, rows):
    schema = "zone_id long, observed_at timestamp_ntz, control_state int, legion long, swarm long, faceless long"
    return spark.createDataFrame([(z, dt.datetime.fromisoformat(t), s, a, b, c) for z, t, s, a, b, c in rows], schema)


@pytest.fixture
def changes(spark):
    return _changes(spark, [
        (1, "2000-01-01 10:00:00", 1, 5, 0, 0), (1, "2000-01-03 10:00:00", 1, 5, 5, 0), (1, "2000-01-03 12:00:00", 2, 0, 9, 0),
        (1, "2001-01-01 00:00:00", 2, 0, 0, 0), (2, "2000-06-01 00:00:00", 0, 0, 0, 3), (3, "2001-05-01 00:00:00", 3, 0, 0, 7),
    ])


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_spine_deltas_and_captures(changes):
    rows = {(r.zone_id, r.observed_at.isoformat()): r for r in spine.event_spine(changes).collect()}
    last = rows[1, "2000-01-03T12:00:00"]
    assert (last.legion_delta, last.swarm_delta, last.prev_state, last.is_capture) == (-5, 4, 1, True)
    first = rows[2, "2000-06-01T00:00:00"]
    assert first.is_first and first.prev_state is None and not first.is_capture and first.total_delta == 3


def test_checkpoints_boundary_at_midnight(changes):
    got = {(r.zone_id, r.boundary_year, r.swarm) for r in spine.checkpoints(changes).collect()}
    # the row at 2001-01-01 00:00 is not yet in force before that boundary
    assert got == {(1, 2001, 9), (2, 2001, 0)}
    assert checks.one_checkpoint_per_boundary(changes, spine.checkpoints(changes)).count() == 0
    assert checks.one_checkpoint_per_boundary(changes, spine.checkpoints(changes).where("zone_id = 1")).count() == 1


def test_global_daily_is_dense(changes):
    rows = series.global_daily(spine.event_spine(changes)).orderBy("activity_date").collect()
    assert len(rows) == (dt.date(2001, 5, 1) - dt.date(2000, 1, 1)).days + 1
    assert [r.legion for r in rows[:4]] == [5, 5, 0, 0] and rows[-1].faceless == 10


def test_leader_and_magnitude(spark):
    lead = lambda *x: _value(spark, S.leader(*map(F.lit, x)))
    assert lead(2, 5, 5, 1) == 2 and lead(3, 5, 5, 1) == 1 and lead(1, 0, 0, 0) == 0 and lead(1, 1, 4, 2) == 2
    mag = lambda t: _value(spark, S.magnitude(F.lit(t)))
    assert [mag(t) for t in (0, 1, 9, 99, 10**9)] == [0, 3, 9, 17, 63]
    packed = F.lit(2 * 64 + 17)
    assert _value(spark, S.faction_of(packed)) == 2 and _value(spark, S.magnitude_of(packed)) == 17


def test_haversine_and_grid(spark):
    km = lambda *x: _value(spark, S.haversine_km(*map(F.lit, x)))
    assert abs(km(0.0, 0.0, 0.0, 180.0) - 6371.0088 * 3.141592653589793) < 1e-6
    assert abs(km(0.0, 0.0, 0.0, 1.0) - 6371.0088 * 3.141592653589793 / 180) < 1e-9
    assert _value(spark, S.cell_of(F.lit(90.0), F.lit(180.0))) == 179 * 360 + 359
    assert _value(spark, S.cell_of(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_near_pairs_crosses_the_antimeridian(spark):
    rows = [(1, 10.0, 179.95), (2, 10.0, -179.95), (3, 10.0, 170.0), (4, 80.0, 0.0), (5, 80.0, 0.5)]
    points = spark.createDataFrame(rows, "zone_id long, latitude double, longitude double")
    got = {(r.origin, r.zone_id) for r in geo.nearest(points, points, 3, 20.0).collect()}
    assert got == {(1, 2), (2, 1), (4, 5), (5, 4)}


def test_nearest_equals_all_pairs_and_repeated_places_make_few(spark, monkeypatch):
    """Places of many zones, ids that are there twice (at one place, and at two), zones without a place or an id."""
    rows = [(i, 50 + i % 7 / 100, 1.0 + i % 3 / 100) for i in range(120)] + [(5, 50.05, 1.02), (5, 50.05, 1.02), (5, 50.05, 1.02), (5, 50.05, 1.02), (9, 50.0, 1.01), (500, 50.5, 1.0), (501, None, 1.0), (None, 50.0, 1.0)]
    points = spark.createDataFrame(rows, "zone_id long, latitude double, longitude double")
    a, b = (points.select(F.col("zone_id").alias(i), F.col("latitude").alias(f"{s}lat"), F.col("longitude").alias(f"{s}lon")) for i, s in (("origin", "l"), ("zone_id", "r")))
    pairs = a.crossJoin(b).where("origin <> zone_id").withColumn("km", F.round(geo.haversine_km("llat", "llon", "rlat", "rlon"), 6))
    for k, km in ((1, 0.0), (3, 1.5), (4, 5.0)):
        made = []
        monkeypatch.setattr(geo, "near_pairs", lambda *args, near=geo.near_pairs: made.append(near(*args)) or made[-1])
        got = geo.nearest(points, points, k, km)
        monkeypatch.undo()
        w = Window.partitionBy("origin").orderBy("km", "zone_id")
        wanted = pairs.where(F.col("km") <= km).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("origin", "zone_id", "km", "place")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        # 22 places, of each the first k + 1 ids, one of them five times over.
        assert made[0].count() <= 22 * (22 * (k + 1) + 4)


def test_clusters_are_transitive(spark):
    day = dt.date(2000, 1, 1)
    rows = [(day, k, 51.0, 0.3 * k) for k in range(4)] + [(day, 9, 10.0, 10.0)]
    located = spark.createDataFrame(rows, "report_date date, zone_id long, latitude double, longitude double")
    got = {r.zone_id: r.cluster for r in geo.clusters(located, 25.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_replay_equals_state_at_and_step(changes):
    display = spine.display_day(spine.event_spine(changes))
    for day in ("2000-01-02", "2000-12-31", "2001-01-01", "2001-06-01"):
        whole = {r.zone_id: r.packed for r in history.state_at(display, day).collect() if r.packed}
        short = {r.zone_id: r.packed for r in history.replay(history.anchors(display), display, day).collect() if r.packed}
        moved = {r.zone_id: r.packed for r in history.step(history.state_at(display, "2000-01-01"), display, "2000-01-01", day).collect() if r.packed}
        assert whole == short == moved


def test_quantiles_streaks_bins(spark):
    one = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    row = reports.summarize(one, "v").collect()[0]
    assert (row.n, row["median"], row.p90, row["mean"]) == (4, 3.0, 4.0, 2.5)
    assert reports.summarize(one.limit(0), "v").collect()[0].n == 0
    days = spark.createDataFrame([(1, dt.date(2000, 1, d)) for d in (1, 2, 2, 4, 5, 6)], "zone_id int, day date")
    assert reports.longest_streaks(days).collect()[0].longest == 3
    bins = {r.bin: r.n for r in reports.linear_bins(spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (99.0,)], "v double"), "v", 2, 10.0).collect()}
    assert bins == {0: 1, 1: 2}


def test_stable_index_keeps_tombstones(spark):
    old = spark.createDataFrame([(0, 5), (1, 9)], "idx long, zone_id long")
    ids = spark.createDataFrame([(9,), (3,), (7,), (3,)], "zone_id long")
    assert {(r.idx, r.zone_id) for r in keys.stable_index(old, ids).collect()} == {(0, 5), (1, 9), (2, 3), (3, 7)}


def test_merge_is_idempotent(spark, changes, tmp_path):
    rows, root = changes.withColumn("year", F.year("observed_at")), str(tmp_path / "t")
    assert keys.merge_events(spark, rows, root, ["zone_id", "observed_at"]) == {2000: 4, 2001: 2}
    assert keys.merge_events(spark, rows, root, ["zone_id", "observed_at"]) == {2000: 0, 2001: 0}
    fixed = rows.where("zone_id = 3").withColumn("faceless", F.lit(8).cast("long"))
    assert keys.merge_events(spark, fixed, root, ["zone_id", "observed_at"]) == {2001: 0}
    assert spark.read.parquet(root).where("zone_id = 3").collect()[0].faceless == 8
    assert spark.read.parquet(root).count() == 6


def test_upsert_null_never_wins(spark):
    cols = "zone_id int, observed_at timestamp_ntz, v int"
    old = spark.createDataFrame([(1, dt.datetime(2000, 1, 2), 1), (2, None, 2)], cols)
    new = spark.createDataFrame([(1, None, 9), (1, dt.datetime(2000, 1, 1), 8), (2, dt.datetime(2000, 1, 1), 7)], cols)
    assert {r.zone_id: r.v for r in keys.upsert_latest(old, new, "zone_id", "observed_at").collect()} == {1: 1, 2: 7}


def test_plans_refuse_what_is_lost(spark):
    days = lambda d: spark.createDataFrame([(dt.date.fromisoformat(d),)], "activity_date date")
    assert keys.plan_days(days("2001-05-17"), "2001-05-20").count() == 3
    with pytest.raises(ValueError, match="gap"):
        keys.plan_days(days("2001-04-01"), "2001-05-20")
    with pytest.raises(ValueError, match="history"):
        keys.plan_days(days("2001-04-01").limit(0), "2001-05-20")


def test_contracts(spark, tmp_path):
    head = ",".join(contracts.NAMES)
    (tmp_path / "a.csv").write_text(f"{head}\n1,2000-01-01 10:00:00.9999999,,1,5,0,0\n1,2000-01-01 10:00:00.1,,1,5,0,0\n2,,,0,0,0,0\n")
    rows = contracts.read_changelog_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.zone_id, r.observed_at) for r in rows] == [(1, dt.datetime(2000, 1, 1, 10))]
    (tmp_path / "b.csv").write_text(f"{head}\n1,soon,,1,5,0,0\n")
    with pytest.raises(ValueError, match="soon"):
        contracts.read_changelog_csv(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="missing columns: swarm"):
        contracts.conform(spark.createDataFrame([(1,)], "zone_id int"), contracts.T.StructType([contracts.CHANGELOG["zone_id"], contracts.CHANGELOG["swarm"]]))


def test_widths(spark):
    df = spark.createDataFrame([(0, 300)], "a int, b int")
    assert [r["column"] for r in checks.fits(df, {"a": "uint8", "b": "uint8"}).collect()] == ["b"]


def test_simplify_keeps_corners(spark):
    shape = '[[0,0],[1,0.001],[2,0],[2,2]]'
    rings = geo.explode_rings(spark.createDataFrame([("x", "LineString", shape), ("y", "Point", "[1,2]")], "name string, type string, coordinates string"))
    out = geo.simplify_paths(rings).collect()
    assert len(out) == 1 and out[0].ring == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]] and out[0].start == 0


def test_streams_match_batch(spark, changes, tmp_path):
    changes.where("year(observed_at) = 2000").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    changes.where("year(observed_at) > 2000 or zone_id = 2").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    source = ingest.drops(spark, str(tmp_path / "in/*"), changes.schema, 1)
    ingest.merge_stream(source, str(tmp_path / "table"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    query = ingest.streaks(ingest.drops(spark, str(tmp_path / "in/*"), changes.schema)).writeStream.format("memory").queryName("runs").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.zone_id, r.n_days) for r in spark.table("runs").collect() if r.zone_id == 2} == {(2, 1)}
    totals = ingest.drops(spark, str(tmp_path / "in/a"), changes.schema).withColumn("total", F.expr("legion + swarm + faceless"))
    query = ingest.stateful_deltas(totals).writeStream.format("memory").queryName("moves").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.zone_id, r.total, r.total_delta) for r in spine.event_spine(changes).where("year(observed_at) = 2000").collect()}
    assert {(r.zone_id, r.total, r.delta) for r in spark.table("moves").collect()} == batch


def test_registry_pairs_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)


def test_lookup_lines_come_back(spark):
    table = spark.createDataFrame([(1, "a \"b\"", 7), (2, None, None), (None, "lost", 1)], "zone_id long, name string, country long")
    lines = lookups.lookup_json(table, "zone_id", ["name", "country"])
    back = lookups.read_lookup_json(lines, "zone_id", {"name": "string", "country": "long"})
    assert {tuple(r) for r in back.collect()} == {(1, "a \"b\"", 7), (2, None, None)}
    many = spark.createDataFrame([('{"3":["x","1"],"4":["y"]}',), ("no json",), (None,)], "value string")
    assert {tuple(r) for r in lookups.read_lookup_json(many, "k", {"name": "string", "c": "int"}).collect()} == {(3, "x", 1), (4, "y", None)}


def test_search_takes_the_first_in_order(spark):
    areas = spark.createDataFrame([(k, f"Town {k:03}", "Kent" if k % 2 else None) for k in range(100)], "zone_id long, label string, detail string")
    assert [r.zone_id for r in lookups.search_areas(areas, "  KENT ").collect()] == list(range(1, 80, 2))
    assert lookups.search_areas(areas, "", n=5).count() == 5 and lookups.search_areas(areas, "town 099").count() == 1


def test_periods_have_open_ends_and_a_length(spark):
    day = dt.date.fromisoformat
    record = spark.createDataFrame([(day("2000-01-01"),), (day("2000-12-31"),)], "activity_date date")
    named = spark.createDataFrame([("all", None, None), ("late", day("2000-06-01"), None), ("before", None, day("1999-01-01"))], "label string, start date, end date")
    got = {r.label: (r.first_day, r.last_day) for r in lookups.period_bounds(named, record).collect()}
    assert got == {"all": (day("2000-01-01"), day("2000-12-31")), "late": (day("2000-06-01"), day("2000-12-31")), "before": (day("2000-01-01"), day("2000-01-02"))}
    assert lookups.period_bounds(named, record.limit(0)).count() == 0


def test_cells_in_a_box_over_the_antimeridian(spark):
    cells = spark.createDataFrame([(140 * 360 + 359,), (140 * 360 + 0,), (140 * 360 + 180,), (10 * 360 + 0,), (None,)], "cell int")
    got = [r.cell for r in cells.where(series.cell_in_bounds(179.2, 49.5, 180.7, 50.5)).collect()]
    assert sorted(got) == [140 * 360, 140 * 360 + 359]
    assert cells.where(series.cell_in_bounds(-180, -90, 180, 90)).count() == 4


def test_sparse_series_and_net(changes):
    events = spine.event_spine(changes)
    dense, daily = series.global_daily(events), series.daily_activity(events)
    rows = series.sparse_series(dense, daily, "2000-02-01").orderBy("activity_date").collect()
    assert [(str(r.activity_date), r.legion, r.swarm, r.faceless) for r in rows] == [("2000-06-01", 0, 9, 3), ("2001-01-01", 0, 0, 3), ("2001-05-01", 0, 0, 10)]
    assert series.net_since(dense, "1990-01-01", "2000-06-01").collect()[0].net == 7
    assert series.net_since(dense, "2000-06-01", "2000-06-01").count() == 0


def test_impact_series_and_boards(spark):
    day = dt.date.fromisoformat
    resolved = spark.createDataFrame([("a", day("2000-01-01"), day("2000-01-03")), ("b", day("2000-01-01"), day("2000-01-01"))], "flashpoint_id string, run_start date, run_end date")
    effects = spark.createDataFrame([("a", day("2000-01-02"), True, 5, 2), ("a", day("2000-01-02"), False, -1, 1)], "flashpoint_id string, activity_date date, on_the_board boolean, net_delta long, zones_moving long")
    got = {(r.flashpoint_id, str(r.activity_date)): (r.board, r.neighbors, r.moving) for r in flashpoints.impact_series(resolved, effects).collect()}
    assert len(got) == 4 and got["a", "2000-01-02"] == (5, -1, 3) and got["b", "2000-01-01"] == (0, 0, 0)
    members = spark.createDataFrame([("a", 9, True), ("a", 4, True), ("a", 5, False), ("b", 4, False)], "flashpoint_id string, zone_id long, on_the_board boolean")
    index = spark.createDataFrame([(0, 9), (1, 5), (2, 4)], "idx long, zone_id long")
    assert {r.flashpoint_id: r.board for r in flashpoints.board_lists(resolved, members, index).collect()} == {"a": [0, 2], "b": []}


def test_tiles_must_add_up(spark):
    scope = spark.range(5)
    assert checks.tile_totals(spark.createDataFrame([(2,), (3,)], "n_zones long"), scope).count() == 0
    assert checks.tile_totals(spark.createDataFrame([(2,)], "n_zones long"), scope).collect()[0].in_tiles == 2
    assert checks.tile_totals(spark.createDataFrame([], "n_zones long"), scope).count() == 1


def test_warehouse_comes_back(spark, changes, tmp_path):
    from driftline.plans import warehouse

    zones = spark.createDataFrame([(1, 51.0, 1.0), (2, None, None), (3, -89.0, 179.0)], "zone_id long, latitude double, longitude double")
    stats = spark.createDataFrame([(1, dt.date(2000, 1, 3), 4)], "zone_id long, report_date date, launches long")
    label = spark.createDataFrame([(1, "x")], "id int, name string")
    index = spark.createDataFrame([(0, 1), (5000, 2), (5001, 3)], "idx long, zone_id long")
    built = spine.event_spine(changes)
    for _ in range(2):  # written again over itself
        warehouse.write_warehouse(str(tmp_path / "w"), zones, built, index, spine.zone_day(built), stats, label, label)
    back = warehouse.rebuild_warehouse(spark, str(tmp_path / "w"))
    key = lambda r: str(sorted(r.asDict().items(), key=str))
    same = lambda a, b: sorted(map(key, a.collect())) == sorted(map(key, b.select(a.columns).collect()))
    assert same(zones, back["zone"]) and same(stats, back["maz"]) and same(label, back["country"]) and same(built, back["zone_event"])
    assert [(r.zone_id, r.seq) for r in back["zone_event"].orderBy("zone_id", "observed_at").collect()] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0)]
    assert sorted(p.name for p in (tmp_path / "w" / "zone_event").glob("block=*")) == ["block=0", "block=1"]
    assert set(back["zone_day"].columns) == set(spine.zone_day(built).columns)


def test_state_drops_and_lookups(spark, tmp_path):
    head = ",".join(contracts.NAMES)
    (tmp_path / "a.csv").write_text(f"{head}\n1,2000-01-01 10:00:00.9,,1,5,2,1\n2,,,0,0,0,0\n")
    assert {(r.zone_id, r.total) for r in contracts.read_zone_state_csv(spark, str(tmp_path / "a.csv")).collect()} == {(1, 8), (2, 0)}
    (tmp_path / "c.csv").write_text("name,id\nx,7\n")
    kind = contracts.T.StructType([contracts.T.StructField("id", contracts.T.IntegerType()), contracts.T.StructField("name", contracts.T.StringType())])
    assert [tuple(r) for r in contracts.ingest_lookups(spark, str(tmp_path / "c.csv"), str(tmp_path / "c"), kind).collect()] == [(7, "x")]


def test_tops_levels_and_extents(spark, changes):
    stats = spark.createDataFrame([(1, 1, 5, 2), (1, 2, 5, 0), (1, 3, 9, 4), (2, 1, None, 1)], "day int, zone_id long, launches long, players int")
    assert {(r.day, r.place, r.zone_id) for r in reports.daily_top(stats, "day", "launches", "zone_id", 2).collect()} == {(1, 1, 3), (1, 2, 1), (2, 1, 1)}
    assert [r.per_player for r in reports.per_player(stats).orderBy("day", "zone_id").collect()] == [2.5, None, 2.25, None]
    assert tuple(reports.count_equal(stats, "launches", 5).collect()[0]) == (2, 4)
    levels = spark.createDataFrame([(1, dt.date(2000, 1, 1), 3), (1, dt.date(2000, 1, 3), 0), (2, dt.date(2000, 1, 2), 7)], "area int, activity_date date, legion int")
    dense = series.densify_levels(levels, "area", ("legion",)).orderBy("area", "activity_date").collect()
    assert [r.legion for r in dense] == [3, 3, 0, 0, 7, 7]
    zones = spark.createDataFrame([(1, 9, 51.0, 1.0), (2, 9, None, None), (3, 9, -89.0, 179.0)], "zone_id long, c int, latitude double, longitude double")
    assert [tuple(r) for r in geo.area_extent(zones, "c").collect()] == [(9, 1.0, -89.0, 179.0, 51.0)]
    assert {(r.n_zones, r.n_played, r.south, r.west) for r in geo.tile_manifest(zones, changes).collect()} == {(1, 1, 38, -4), (1, 1, -90, 172)}
    assert {(r.zone_id, r.lat_e4, r.lon_e4, r.ever_active) for r in history.map_rows(zones, spine.event_spine(changes)).collect()} == {(1, 510000, 10000, True), (3, -890000, 1790000, True)}


def test_corners_follow_the_rule():
    import numpy as np

    def slow(ring, lo, hi, tolerance):
        """The rule by its definition, on one stretch."""
        far, at = 0.0, None
        for k in range(lo + 1, hi):
            (ax, ay), (bx, by), (px, py) = ring[lo], ring[hi], ring[k]
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)) if size else 0.0
            gap = ((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2) ** 0.5
            if gap > far:
                far, at = gap, k
        return slow(ring, lo, at, tolerance) | {at} | slow(ring, at, hi, tolerance) if at is not None and far > tolerance else set()

    rng = np.random.default_rng(5)
    for n in (2, 3, 10, 200):
        for tolerance in (0.0, 0.05, 0.5):
            ring = rng.random((n, 2)).cumsum(0) % 2
            ring[-1] = ring[0] if n > 3 else ring[-1]
            assert set(geo._corners(ring, tolerance).tolist()) == {0, n - 1} | slow(ring, 0, n - 1, tolerance)


def test_bounding_boxes(spark):
    circles = spark.createDataFrame([("a", 0.0, 179.9, 50.0), ("b", 89.9, 0.0, 50.0), ("c", 10.0, 20.0, 111.32)], "id string, latitude double, longitude double, radius_km double")
    box = {r.id: r for r in geo.bounding_boxes(circles).collect()}
    assert box["a"].west > 179 and box["a"].east < -179 and box["a"].west > box["a"].east
    assert (box["b"].west, box["b"].east, box["b"].north) == (-180.0, 180.0, 90.0)
    assert abs(box["c"].south - 8.95) < 1e-9 and 1.05 < box["c"].east - 20 < 1.08


def test_checks_find_planted_violations(spark):
    frame = spark.createDataFrame
    effects = frame([("a", True, 3), ("b", False, 2)], "flashpoint_id string, on_the_board boolean, n_events int")
    manifest = frame([("a", False), ("b", False), ("c", True)], "flashpoint_id string, changelog_covered boolean")
    assert {r.flashpoint_id for r in checks.coverage_against_evidence(manifest, effects).collect()} == {"a", "c"}
    members = frame([("a", 1, True), ("a", 1, False), ("a", 2, None), ("b", 1, True)], "flashpoint_id string, zone_id int, on_the_board boolean")
    assert {(r.flashpoint_id, r.zone_id) for r in checks.groups_partition_circle(members).collect()} == {("a", 1), ("a", 2)}
    zones = frame([(1, "x"), (1, "x"), (2, None), (3, "y"), (3, "z")], "region_id int, region_name string")
    assert {r.region_id for r in checks.unlabelled_regions(zones).collect()} == {2, 3}
    assert [r.k for r in checks.unique(frame([(1,), (1,), (2,)], "k int"), ["k"]).collect()] == [1]
    daily = frame([("d", 1, -1, 0), ("e", 0, 0, 0)], "activity_date string, legion int, swarm int, faceless int")
    assert [r.activity_date for r in checks.no_negative_totals(daily, daily.where("legion > 5")).collect()] == ["d"]


def test_stream_state_keeps_the_newest(spark, tmp_path):
    schema = "zone_id long, observed_at timestamp, v int"
    first = spark.sql("SELECT id AS zone_id, timestamp'2020-01-02' AS observed_at, 1 AS v FROM range(200)")
    late = spark.sql("SELECT id AS zone_id, timestamp'2020-01-01' AS observed_at, 2 AS v FROM range(5)")
    new = spark.sql("SELECT id AS zone_id, timestamp'2020-01-03' AS observed_at, 3 AS v FROM range(3, 8)")
    root = str(tmp_path / "state")
    for k, part in enumerate((first, late, new)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = ingest.drops(spark, str(tmp_path / "in/*"), first.schema, 1)
        ingest.state_stream(source, root, str(tmp_path / "c")).awaitTermination()
    got = {r.zone_id: r.v for r in ingest.read_state(spark, root, first.schema).collect()}
    assert got == {k: 3 if 3 <= k < 8 else 1 for k in range(200)}
    assert len(list((tmp_path / "state/version=1").glob("bucket=*"))) <= 5


def test_circles_of_any_radius(spark):
    frame = spark.createDataFrame
    dim = frame([(1, 50.0, 0.0), (2, 52.5, 0.0), (3, 60.0, 0.0)], "zone_id long, latitude double, longitude double")
    wide = frame([("w", 50.0, 0.0, 400.0)], "flashpoint_id string, latitude double, longitude double, radius_km double").selectExpr("*", "date'2020-01-01' AS board_start", "date'2020-01-02' AS board_end")
    battles = frame([(2,)], "zone_id long").selectExpr("*", "date'2020-01-01' AS report_date")
    out = {r.zone_id: r.on_the_board for r in flashpoints.flashpoint_zone(wide, battles, dim).collect()}
    assert out == {1: False, 2: True}


def test_the_most_specific_selection_wins(spark, changes):
    events = spine.event_spine(changes).withColumns({"country_id": F.lit(1), "region_id": F.col("zone_id") % 2, "latitude": F.lit(50.5), "longitude": F.lit(1.5)})
    last = lambda selection, **more: tuple(series.history(selection, events, **more).orderBy(F.desc("activity_date")).first())[1:]
    assert last({"zone_id": 1, "country_id": 1}) == (0, 0, 0)
    assert last({"region_id": 1, "country_id": 1}) == (0, 0, 7)
    assert last({}) == last({"country_id": 1}) == last({"circle": (50.5, 1.5, 1.0)}) == last({"box": (1.0, 50.0, 2.0, 51.0)}) == (0, 0, 10)
    assert last({"country_id": 1}, grains={"country_id": series.area_series(events, "country_id")}) == (0, 0, 10)
    assert series.history({"zone_id": 99}, events).where("legion + swarm + faceless <> 0").count() == 0


def test_nothing_is_written_that_does_not_fit(spark, changes, tmp_path):
    display = spine.display_day(spine.event_spine(changes))
    index = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "idx long, zone_id long")
    with pytest.raises(ValueError, match="activity_date is before 2010-01-01"):
        warehouse.write_display(f"{tmp_path}/a", display, index)
    with pytest.raises(ValueError, match="idx is from -1 to 1, not from 0"):
        warehouse.write_display(f"{tmp_path}/a", display, index.withColumn("idx", F.col("idx") - 1), "1970-01-01")
    assert not (tmp_path / "a").exists()
    warehouse.write_display(f"{tmp_path}/a", display, index, "1970-01-01")
    assert {r.idx for r in warehouse.read_display(spark, f"{tmp_path}/a", 2001).collect()} == {0, 2}
    assert warehouse.read_display(spark, f"{tmp_path}/a").count() == display.count()


def test_seeds_and_staging(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,label,day,km\na,"Said ""no"", twice",2024-02-29,48.5\n')
    contract = contracts.T.StructType.fromDDL("id string, label string, day date, km double")
    assert contracts.read_seeds(spark, str(tmp_path / "s.csv"), contract).collect() == [("a", 'Said "no", twice', dt.date(2024, 2, 29), 48.5)]
    (tmp_path / "s.csv").write_text("id,label,day,km\na,b,soon,1\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        contracts.read_seeds(spark, str(tmp_path / "s.csv"), contract).collect()
    raw = spark.range(2).select(*(F.when(F.col("id") == 0, "-3").alias(c) for c in (*staging.REPORTS, "Extra. Column")))
    assert [(r.zone_id, r.is_tournament) for r in staging.stage_reports(raw).orderBy("zone_id").collect()] == [(None, None), (-3, True)]
    with pytest.raises(ValueError, match="missing columns: Zone ID"):
        staging.stage_reports(raw.drop("Zone ID"))


def test_pages_keep_a_row_each(spark):
    html = "<html><title>A &amp;\n b</title><h1>x</h1><p>y<a href='/z'>z</a><a name=q>n</a></html>"
    got = {tuple(r) for r in pages.extract_pages(spark.createDataFrame([(1, html), (2, None), (3, "  ")], "page_id long, html string")).collect()}
    assert got == {(1, "A & b", 1, 1, 1, "ok"), (2, None, 0, 0, 0, "missing"), (3, None, 0, 0, 0, "missing")}


def test_late_rows_correct_their_successors(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day)
    schema = "zone_id long, observed_at timestamp, total long"
    batches = ([(1, at(20), 5), (1, at(22), 9), (2, at(22), 1)], [(1, at(21), 6), (1, at(30), 9), (1, at(31), 10)], [(1, at(20), 3), (1, at(31), 12)])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        given = deltas.corrected_deltas(ingest.drops(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), keep_days=2)
        with deltas.map_state(spark):
            given.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.zone_id, r.observed_at.day): (r.total, r.delta) for r in deltas.settled(spark.read.schema(given.schema).parquet(f"{tmp_path}/out")).collect()}
    # Day 20 comes again when days before 22 are cut, so its new delta is not known.
    assert got == {(1, 20): (3, None), (1, 21): (6, 1), (1, 22): (9, 3), (1, 30): (9, 0), (1, 31): (12, 3), (2, 22): (1, 1)}


def test_stale_streams_raise_an_alert(spark, tmp_path):
    import time

    alerts = []
    listener = monitor.FreshnessListener(dt.timedelta(days=2), lambda name, newest, age: alerts.append((name, newest.date(), age.days > 2)))
    spark.streams.addListener(listener)
    try:
        rows = spark.createDataFrame([(1, dt.datetime(2020, 5, 4, 3)), (1, dt.datetime(2020, 5, 1))], "zone_id long, observed_at timestamp")
        rows.write.parquet(f"{tmp_path}/in")
        counts = ingest.daily_counts(ingest.drops(spark, f"{tmp_path}/in", rows.schema), "zone_id")
        counts.writeStream.queryName("stale").format("memory").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 30
        while not alerts and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert alerts[0] == ("stale", dt.date(2020, 5, 4), True)
