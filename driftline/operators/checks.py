"""Data-quality checks: each returns the rows that violate it, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.guards import WIDTHS



def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return out.unpivot([], cols, "column", "n_nulls").where("n_nulls > 0")


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def relationship(child: DataFrame, key: str, parent: DataFrame, severity: str = "error") -> DataFrame:
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key), key, "left_anti").withColumn("severity", F.lit(severity))


def fits(df: DataFrame, widths: dict[str, str]) -> DataFrame:
    """Columns whose extremes do not fit their declared width."""
    cols = list(widths)
    ends = df.agg(*(F.min(c).cast("long").alias(f"{c}_lo") for c in cols), *(F.max(c).cast("long").alias(f"{c}_hi") for c in cols))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"), F.lit(WIDTHS[w][0]).cast("long").alias("least"), F.lit(WIDTHS[w][1]).cast("long").alias("most")) for c, w in widths.items()))
    return ends.select(F.explode(rows).alias("r")).select("r.*").where("lo < least OR hi > most")


def no_negative_totals(*series: DataFrame) -> DataFrame:
    cols = ("legion", "swarm", "faceless")
    bad = [s.where(" OR ".join(f"{c} < 0" for c in cols)).select("activity_date", *cols) for s in series]
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def one_checkpoint_per_boundary(events: DataFrame, found: DataFrame) -> DataFrame:
    """Boundaries that a zone should have and has not exactly once, missing ones included."""
    last = events.agg(F.max(F.year("observed_at")).alias("last"))
    first = events.groupBy("zone_id").agg((F.min(F.year("observed_at")) + 1).alias("first")).join(F.broadcast(last)).where("first <= last")
    expected = first.select("zone_id", F.explode(F.sequence("first", "last")).alias("boundary_year"))
    seen = found.groupBy("zone_id", "boundary_year").agg(F.count("*").alias("n"))
    return expected.join(seen, ["zone_id", "boundary_year"], "full_outer").na.fill(0, ["n"]).where("n <> 1")


def orphans(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Zones with changes and no row in the dimension: they must survive its join, without a country."""
    return events.select("zone_id").distinct().join(dim.select("zone_id"), "zone_id", "left_anti")


def unresolved_anchors(flashpoints: DataFrame, dim: DataFrame, members: DataFrame) -> DataFrame:
    """Incidents whose anchor is unknown or unplaced, or whose circle is empty."""
    sizes = members.groupBy("flashpoint_id").agg(F.count("*").alias("n"))
    both = flashpoints.join(dim.select(F.col("zone_id").alias("anchor_zone_id"), "latitude"), "anchor_zone_id", "left").join(sizes, "flashpoint_id", "left")
    return both.select("flashpoint_id", F.when(F.col("latitude").isNull(), "anchor").when(F.coalesce("n", F.lit(0)) == 0, "circle").alias("problem")).where("problem IS NOT NULL")


def tournament_ids(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("is_tournament") != (F.col("zone_id") < 0))


def impact_outside_run(resolved: DataFrame, effects: DataFrame) -> DataFrame:
    rows = effects.join(resolved.select("flashpoint_id", "run_start", "run_end"), "flashpoint_id", "left")
    return rows.where("run_start IS NULL OR activity_date < run_start OR activity_date > run_end").select("flashpoint_id", "activity_date")


def split_shortfall(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Reports whose parts do not add up, outside the window in which that is known to happen."""
    return reports.where((F.col("launches") != F.col("launch_1") + F.col("launch_2") + F.col("launch_3")) & ~F.col("report_date").between(start, end))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    left, right = a.select(*keys).withColumn("in_a", F.lit(True)), b.select(*keys).withColumn("in_b", F.lit(True))
    return left.join(right, keys, "full_outer").where("in_a IS NULL OR in_b IS NULL")


def freshness(df: DataFrame, ts: str, now: str, warn_days: int = 2, error_days: int = 7) -> DataFrame:
    age = F.datediff(F.lit(now).cast("date"), F.to_date(F.max(ts)))
    return df.agg(age.alias("age_days")).withColumn("status", F.when(F.col("age_days") > error_days, "error").when(F.col("age_days") > warn_days, "warn").otherwise("pass"))


def years_present(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).select(F.year(ts).alias("year")).distinct()


def tile_totals(tiles: DataFrame, scope: DataFrame, rows: str = "n_zones") -> DataFrame:
    """One row if the rows of all tiles do not add up to the scope's."""
    both = tiles.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("in_tiles")).join(F.broadcast(scope.agg(F.count("*").alias("in_scope"))))
    return both.where("in_tiles <> in_scope")


def coverage_against_evidence(manifest: DataFrame, effects: DataFrame) -> DataFrame:
    """Incidents whose coverage flag differs from whether any event of a board zone lies in their run."""
    seen = effects.where("on_the_board AND n_events > 0").select("flashpoint_id").distinct().withColumn("seen", F.lit(True))
    both = manifest.join(seen, "flashpoint_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return both.where(~F.col("changelog_covered").eqNullSafe(F.col("seen"))).select("flashpoint_id", "changelog_covered", "seen")


def groups_partition_circle(members: DataFrame) -> DataFrame:
    """Zones that are in a circle more than once, or in no group of it."""
    found = members.groupBy("flashpoint_id", "zone_id").agg(F.count("*").alias("n"), F.count("on_the_board").alias("n_grouped"))
    return found.where("n <> 1 OR n_grouped <> n")


def unlabelled_regions(zones: DataFrame) -> DataFrame:
    """Region ids without a label, or with several."""
    found = zones.where("region_id IS NOT NULL").groupBy("region_id").agg(F.count("*").alias("n_zones"), F.count_distinct("region_name").alias("n_labels"))
    return found.where("n_labels <> 1")


def coverage_against_spine(manifest: DataFrame, resolved: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Incidents whose coverage flag differs from the spine itself: whether any event of a zone on their board lies in their run."""
    runs = resolved.select("flashpoint_id", "run_start", "run_end")
    board = members.where("on_the_board").select("flashpoint_id", "zone_id").join(F.broadcast(runs), "flashpoint_id")  # the curated list
    inside = events.select("zone_id", "activity_date").join(board, "zone_id").where("activity_date BETWEEN run_start AND run_end")
    seen = inside.select("flashpoint_id").distinct().withColumn("seen", F.lit(True))
    both = manifest.select("flashpoint_id", "changelog_covered").join(seen, "flashpoint_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return both.where(~F.col("changelog_covered").eqNullSafe(F.col("seen")))


def board_faults(boards: DataFrame, index: DataFrame, members: DataFrame, resolved: DataFrame, battles: DataFrame) -> DataFrame:
    """(flashpoint_id, idx, problem) of what is wrong with board lists: an index of no zone, a zone outside the circle, or one without a
    report in the board window; the window itself has to lie in the run (idx is null there)."""
    listed = boards.select("flashpoint_id", F.explode("board").alias("idx")).join(index, "idx", "left")
    circle = members.select("flashpoint_id", "zone_id").distinct().withColumn("inside", F.lit(True))
    days = resolved.select("flashpoint_id", "board_start", "board_end")
    fought = battles.select("zone_id", "report_date").join(F.broadcast(days)).where("report_date BETWEEN board_start AND board_end")  # the curated list
    fought = fought.select("flashpoint_id", "zone_id").distinct().withColumn("fought", F.lit(True))
    rows = listed.join(circle, ["flashpoint_id", "zone_id"], "left").join(fought, ["flashpoint_id", "zone_id"], "left")
    problem = F.when(F.col("zone_id").isNull(), "no zone").when(F.col("inside").isNull(), "outside the circle").when(F.col("fought").isNull(), "not on the board")
    wide = resolved.where("board_start < run_start OR board_end > run_end").select("flashpoint_id", F.lit(None).cast("long").alias("idx"), F.lit("outside the run").alias("problem"))
    return rows.select("flashpoint_id", "idx", problem.alias("problem")).where("problem IS NOT NULL").unionByName(wide)


def code_faults(entries: DataFrame, used: DataFrame) -> DataFrame:
    """(code, problem): codes that are used and address no entry, address several, or leave a gap below them. ``used`` has a column ``code``."""
    held = entries.groupBy("code").agg(F.count("*").alias("n"))
    span = entries.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("top"))
    every = span.where("top >= 0").select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("code"))
    asked = used.select(F.col("code").cast("int").alias("code")).distinct().withColumn("used", F.lit(True))
    rows = held.join(every.withColumn("below", F.lit(True)), "code", "full_outer").join(asked, "code", "full_outer")
    problem = F.when(F.col("n").isNull() & F.col("used"), "addresses nothing").when(F.col("n").isNull(), "gap").when(F.col("n") > 1, "addresses several").when(F.col("code").isNull() | (F.col("code") < 0), "no code")
    return rows.select("code", problem.alias("problem")).where("problem IS NOT NULL")
