"""Violations planted in the model's tables and found by the registered checks; sets, orders and exports against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import checks, export, geo, idsets, reports, spine
from driftline.plans import model_queries, queries, views

SF = "/root/testdata/sf0.001"
BUILD = queries._BUILD | views.BUILD | model_queries.BUILD


def _broken(spark, **given):
    """A model of the given tables in which some tables are others."""
    kind = type("Broken", (queries.Model,), {name: property(lambda m, make=make: make(queries.Model(m.spark, m.sf_dir))) for name, make in given.items()})
    return kind(spark, SF)


def _one(df, key="report_id"):
    return df.agg(F.min(key)).first()[0]


def test_checks_pass_on_the_given_tables(spark):
    m = queries.Model(spark, SF)
    for name in ("check_tournaments", "check_split", "check_same_keys", "check_launches", "check_spine_coverage", "check_board", "check_codes", "check_impact_run"):
        assert BUILD[name](m).count() == 0, name


def test_a_tournament_that_is_not_flagged(spark):
    def flip(m):
        return m.reports.withColumn("is_tournament", F.col("is_tournament") != (F.col("report_id") == _one(m.reports)))

    assert BUILD["check_tournaments"](_broken(spark, reports=flip)).count() == 1


def test_parts_that_do_not_add_up(spark):
    inside, outside = dt.date(1997, 7, 15), dt.date(1996, 7, 15)

    def short(m):
        first = _one(m.reports)
        bad = F.col("report_id") == first
        return m.reports.withColumn("launches", F.col("launches") + bad.cast("long")).withColumn("report_date", F.when(bad, F.lit(day)).otherwise(F.col("report_date")))

    for day, n in ((outside, 1), (inside, 0)):
        assert BUILD["check_split"](_broken(spark, reports=short)).count() == n


def test_a_key_of_one_table_alone(spark):
    lost = BUILD["check_same_keys"](_broken(spark, stats=lambda m: m.stats.where(F.col("zone_id") != _one(m.stats, "zone_id"))))
    assert lost.where("in_b IS NULL").count() >= 1 and lost.where("in_a IS NULL").count() == 0


@pytest.mark.parametrize("launches", [-1, 2**31])
def test_launches_out_of_range(spark, launches):
    found = BUILD["check_launches"](_broken(spark, stats=lambda m: m.stats.limit(5).withColumn("launches", F.lit(launches).cast("long")))).collect()
    assert [(r.column, r.lo) for r in found] == [("launches", launches)]


def test_impact_outside_its_run(spark):
    def late(m):
        return m.impact.withColumn("activity_date", F.when(F.col("flashpoint_id") == "alpha", F.lit(dt.date(2031, 1, 1))).otherwise(F.col("activity_date"))).distinct()

    m = _broken(spark, impact=late)
    assert {r.flashpoint_id for r in BUILD["check_impact_run"](m).collect()} == ({"alpha"} if queries.Model(spark, SF).impact.where("flashpoint_id = 'alpha'").count() else set())


def test_coverage_is_recomputed_from_the_spine(spark):
    """Effects that speak of events which the spine does not have, and events of the board that effects leave out."""
    plain = queries.Model(spark, SF)
    covered = {r.flashpoint_id for r in BUILD["flashpoint"](plain).where("changelog_covered").collect()}
    assert {r.flashpoint_id for r in BUILD["check_spine_coverage"](_broken(spark, impact=lambda m: m.impact.limit(0))).collect()} == covered
    assert {r.flashpoint_id for r in checks.coverage_against_spine(BUILD["flashpoint"](plain), plain.resolved, plain.members, plain.spine.limit(0)).collect()} == covered


def _boards(spark):
    schema = "flashpoint_id string, run_start date, run_end date, board_start date, board_end date"
    day = lambda month: dt.date(2020, month, 1)
    resolved = spark.createDataFrame([("a", day(1), day(9), day(2), day(3)), ("b", day(4), day(9), day(3), day(5))], schema)
    index = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "idx long, zone_id long")
    members = spark.createDataFrame([("a", 10, True), ("a", 11, True), ("b", 12, True)], "flashpoint_id string, zone_id long, on_the_board boolean")
    battles = spark.createDataFrame([(10, day(2)), (11, day(4)), (12, day(3))], "zone_id long, report_date date")
    return resolved, index, members, battles


def test_boards_lie_in_circle_window_and_run(spark):
    resolved, index, members, battles = _boards(spark)
    boards = spark.createDataFrame([("a", [0, 1, 2, 7]), ("b", [2])], "flashpoint_id string, board array<long>")
    found = checks.board_faults(boards, index, members, resolved, battles).collect()
    assert {(r.flashpoint_id, r.idx, r.problem) for r in found} == {("a", 1, "not on the board"), ("a", 2, "outside the circle"), ("a", 7, "no zone"), ("b", None, "outside the run")}

    class Foreign(queries.Model):
        def boards(self, index):
            return super().boards(index).withColumn("board", F.array(F.lit(10**9).cast("long")))

    assert {r.problem for r in BUILD["check_board"](Foreign(spark, SF)).collect()} == {"no zone"}


@pytest.mark.parametrize("entries, used, faults", [([0, 1, 2], [0, 2], {}), ([0, 2], [2], {1: "gap"}), ([0, 1, 1], [1], {1: "addresses several"}), ([0, 1], [1, 5], {5: "addresses nothing"}), ([0], [-1, None], {-1: "addresses nothing", None: "addresses nothing"}), ([], [0], {0: "addresses nothing"})])
def test_codes_address_entries(spark, entries, used, faults):
    table = lambda codes: spark.createDataFrame([(c,) for c in codes], "code int")
    assert {r.code: r.problem for r in checks.code_faults(table(entries), table(used)).collect()} == faults


def test_a_used_code_without_an_entry(spark):
    found = BUILD["check_codes"](_broken(spark, codes=lambda m: m.codes.unionByName(m.spark.sql("SELECT 99 AS code")))).collect()
    assert [(r.code, r.problem) for r in found] == [(99, "addresses nothing")]


def test_region_labels_follow_the_region_over_a_border(spark):
    """A zone just over a border keeps the label of its region id, and its country's own name."""
    zones = spark.createDataFrame([(1, "a", 7, 1, 50.0, 1.0), (2, "b", 7, 2, 50.0, 1.1), (3, "c", 8, 1, 50.0, 1.2), (4, "d", 9, 1, 50.0, 1.3)], "zone_id long, zone_name string, region_id int, country_id int, latitude double, longitude double")
    regions = spark.createDataFrame([(7, "North"), (8, "South")], "region_id int, region_name string")
    countries = spark.createDataFrame([(1, "Here"), (2, "There")], "country_id int, country_name string")
    got = {r.zone_id: (r.region_name, r.country_name) for r in spine.dim_zone(zones, regions, countries).collect()}
    assert got == {1: ("North", "Here"), 2: ("North", "There"), 3: ("South", "Here"), 4: (None, "Here")}


def test_sets_merge_in_any_split(spark):
    rng = random.Random(4)
    edge = [0, 1, -1, 32768, 32769, -32768, -32769, 10**12]
    rows = [(dt.date(2020, 1, 1 + rng.randrange(9)), rng.choice(edge + list(range(-50, 70_000, 997)))) for _ in range(400)] + [(dt.date(2020, 1, 1), None)]
    table = spark.createDataFrame(rows, "activity_date date, zone_id long")
    parts = [idsets.id_sets(table.where(F.pmod(F.xxhash64("zone_id"), F.lit(3)) == k), ["activity_date"]) for k in range(3)]
    merged = idsets.merge_sets(*parts, by=["activity_date"])
    held = {}
    for day, zone in rows:
        if zone is not None:
            held.setdefault(day, set()).add(zone)
    assert {(r.activity_date, r.zone_id) for r in idsets.members(merged).collect()} == {(d, z) for d, zones in held.items() for z in zones}
    assert {r.activity_date: r.n for r in idsets.sizes(merged, ["activity_date"]).collect()} == {d: len(z) for d, z in held.items()}
    running, seen, wanted = idsets.running_sets(merged, "activity_date"), set(), {}
    for day in sorted(held):
        new = held[day] - seen
        seen |= new
        if new:
            wanted[day] = (len(new), len(seen))
        assert {r.zone_id for r in idsets.members(idsets.sets_on(running, "activity_date", str(day))).collect()} == seen if day.day in (1, 5, 9) else True
    assert {r.activity_date: (r.n_new, r.n_claimed) for r in idsets.claimed_counts(running).collect()} == wanted
    assert idsets.members(idsets.sets_on(running, "activity_date", "2019-12-31")).count() == 0


def test_clusters_come_larger_first_then_as_they_appeared(spark):
    day = dt.date(2020, 1, 1)
    places = {1: (50.0, 1.0), 2: (60.0, 1.0), 3: (60.0, 1.1), 4: (10.0, 1.0), 5: (60.05, 1.0)}
    battles = spark.createDataFrame([(100 - z if z < 4 else 50 + z, day, z, *places[z]) for z in places], "report_id long, report_date date, zone_id long, latitude double, longitude double")
    members = geo.clusters(battles)
    got = {r.zone_id: (r.place, r.n_zones) for r in geo.cluster_order(members, geo.cluster_sizes(members, battles), battles).collect()}
    # Zone 4 reported before zone 1.
    assert got == {2: (1, 3), 3: (1, 3), 5: (1, 3), 4: (2, 1), 1: (3, 1)}


def test_board_entries_and_their_days(spark):
    battles = spark.createDataFrame([(1, dt.date(2020, 1, 2), 1), (1, dt.date(2020, 1, 2), 1), (2, dt.date(2020, 3, 1), 2)], "zone_id long, report_date date, country_id int")
    assert tuple(reports.maz_range(battles).first()) == (2, dt.date(2020, 1, 2), dt.date(2020, 3, 1))
    assert {tuple(r)[:2] for r in reports.maz_range(battles, ["country_id"]).collect()} == {(1, 1), (2, 1)}
    assert tuple(reports.maz_range(battles.limit(0)).first()) == (0, None, None)


def test_series_come_back_from_json(spark):
    rows = [(a, dt.date(2020, 1, d), d * 10, None if d == 2 else d, 2**40) for a in (1, 2) for d in (3, 1, 2)]
    table = spark.createDataFrame(rows, "area int, activity_date date, legion long, swarm long, faceless long")
    lines = export.series_json(table, ["area"])
    first = json.loads(lines.where("area = 1").first().series)
    assert first == {"day": ["2020-01-01", "2020-01-02", "2020-01-03"], "legion": [10, 20, 30], "swarm": [1, None, 3], "faceless": [2**40] * 3}
    assert sorted(map(tuple, export.read_series(lines).collect()), key=str) == sorted(rows, key=str)
    assert export.read_series(export.series_json(table.limit(0), ["area"])).collect() == []


def test_a_manifest_without_days_is_refused(spark, tmp_path):
    m = queries.Model(spark, SF)
    with pytest.raises(ValueError, match="first holds 1 nulls"):
        export.write_manifest(export.manifest(m.dim, m.spine.limit(0)), f"{tmp_path}/a")
    with pytest.raises(ValueError, match="zones holds 1 nulls"):
        export.write_manifest(export.manifest(m.dim.limit(0), m.spine), f"{tmp_path}/a")
    assert not (tmp_path / "a").exists()
    export.write_manifest(export.manifest(m.dim, m.spine), f"{tmp_path}/a")
    assert export.read_manifest(spark, f"{tmp_path}/a").first().scope.zones == m.dim.count()


def test_files_out_of_order_are_found(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3), (1, 5), (1, 4), (2, 1), (2, 2)], "shard int, k int").coalesce(1)
    rows.write.partitionBy("shard").parquet(f"{tmp_path}/t")
    assert [tuple(r) for r in export.out_of_order(spark, f"{tmp_path}/t", "shard", ["k"]).collect()] == [(1, 3, 4)]
