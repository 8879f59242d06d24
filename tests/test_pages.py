"""Extraction of records from pages: paths, implied ends, ordered elements, cells beside blocks, typed rejects, sorted links."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.plans import page_queries
from driftline.sources import extract, pages, staging
from driftline.sources.extract import Beside, Listed, Ordered, Reject, Value, read_page

BAR = '<div class="progress wide"><div style="width:1%">1 666</div></div>'
STATS = '<div class="row"><div class="col-md-5"><b>Total Launches:</b> 1 024</div>\n<div class="col-md-7"><table><tr><td class="Legion right">1 000<td class="Swarm">24</table></div></div><div class="row"><div class="col-md-5">Bots Killed:<i>7</i></div></div>'
PLAYERS = '<div class="col-sm-6 x"><div class="table-responsive"><table><thead><tr><th>Name<tbody><tr><td>A &amp; B<tr><td>C</table></div></div>'
HEAD = "<h1> Old Town <br> North / Atlantis<br/>#-12 </h1>"
PAGE = "<html><title>x</title><script>document.write('<h1>no</h1>')</script>{head}<p>Fought on <strong>8/7/2026</strong>{bars}{stats}{players}"


def _page(head=HEAD, bars=BAR * 6, stats=STATS, players=PLAYERS):
    return PAGE.format(head=head, bars=bars, stats=stats, players=players)


def test_a_report_page():
    row = read_page(_page(), pages.REPORT)
    # Dates are month-first: the other reading would be a date as well.
    assert row["Date"] == dt.date(2026, 8, 7)
    assert (row["Zone Name"], row["Region"], row["Country"], row["Zone ID"]) == ("Old Town", "North", "Atlantis", -12)
    assert [row[b] for b in pages.BARS] == [1666] * 6
    assert dict(row["stats"]) == {"Total Launches": 1024, "Legion Total Launches": 1000, "Swarm Total Launches": 24, "Bots Killed": 7}
    assert row["players"] == ["A & B", "C"]


@pytest.mark.parametrize(
    "html, kind, name",
    [
        (None, "no page", ""),
        (" \n", "no page", ""),
        (_page(head=""), "missing", "Zone Name"),
        (_page(head="<h1>/</h1>"), "missing", "Zone Name"),
        (_page(head="<h1>A<br>B / C</h1>"), "missing", "Zone ID"),
        (_page(head="<h1>A<br>B / C<br>#x</h1>"), "value", "Zone ID"),
        (_page().replace("8/7/2026", "13/7/2026"), "value", "Date"),
        (_page(bars=BAR * 5), "count", "div.progress"),
        (_page(bars=BAR * 7), "count", "div.progress"),
        (_page(bars=BAR * 5 + BAR.replace("1 666", "many")), "value", "Faceless Ending Bots"),
        (_page(stats='<div class="col-md-5">Launches:</div>'), "missing", "stats"),
        (_page(players=""), "missing", "players"),
        ("<<<>><a href=", "missing", "Zone Name"),
    ],
)
def test_typed_rejects(html, kind, name):
    with pytest.raises(Reject) as wrong:
        read_page(html, pages.REPORT)
    assert wrong.value.args[:2] == (kind, name)


def test_paths_and_implied_ends():
    spec = (Listed("direct", "ul > li"), Listed("deep", "div.a p"), Listed("ids", "p[id]", attribute="id"), Value("none", "h6", required=False))
    html = '<div class="b a"><p id=1>one<p>two<ul><li>x<ul><li>y</ul><li>z</ul><section><p id="3">three</section></div><p id=4>out<br>side'
    row = read_page(html, spec)
    assert row == {"direct": ["x y", "y", "z"], "deep": ["one", "two", "three"], "ids": ["1", "3", "4"], "none": None}


def test_cells_belong_to_the_next_sibling_alone():
    spec = (Beside("s", "dt", "dd", "i"),)
    html = "<dl><dt>a:<b>1</b></dt><dd><i class=x>5</i></dd><dt>b<b>2</b></dt></dl><dl><dt>c<b>3</b></dt><dd><i class=x>7</i><i>8</i></dd></dl>"
    assert dict(read_page(html, spec)["s"]) == {"a": 1, "x a": 5, "b": 2, "c": 3, "x c": 7}
    assert read_page("<p>x</p>", (Ordered((), "div"), Listed("p", "p"))) == {"p": ["x"]}


CUT = "<title>A &amp;&lt;&#65; R&amp</title><nav><ul><li><a href='/x?a=1&copy=2'>b &quot</a></ul></nav><article><h1>x&ltd &ampx; &am</h1><p>&amp;lt; &copy y&#66</article>"


def test_references_end_with_a_semicolon():
    row = read_page(CUT, pages.ARTICLE)
    assert (row["title"], row["heading"], row["labels"], row["paragraphs"]) == ("A &<A R&amp", "x&ltd &ampx; &am", ["b &quot"], ["&lt; &copy y&#66"])
    assert row["links"] == ["/x?a=1&copy=2"]


def test_counted_pages_keep_cut_references(spark):
    got = pages.extract_pages(spark.createDataFrame([(1, CUT), (2, " ")], "page_id long, html string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "A &<A R&amp", 1, 1, 1, "ok"), (2, None, 0, 0, 0, "missing")]


ODD = {
    "a\u00a0b": "a\u00a0b", "\u3000a\u3000b\u3000": "a\u3000b", "a\x0bb\x1c\x85": "a\x0bb\x1c\x85", " a\t\n\x0c b\r\n": "a b", "a\u00a0<b>b</b>\u2028": "a\u00a0 b \u2028",
    "1 <3 &amp": "1 <3 &amp", "a b<": "a b<", "a <b c": "a <b c", "a<i>b</i> <!-- c": "a b <!-- c", "a <? b": "a <? b", "a </ b": "a </ b", "<i": "<i",
}


def test_counted_pages_keep_odd_characters_and_unfinished_tags_of_titles(spark):
    rows = [(i, f"<title>{title}</title><script>if (a<1) b</script><h1>x</h1><p><a href='/'>y</a>") for i, title in enumerate(ODD)] + [(97, "\x0c"), (98, "\u00a0"), (99, "\r\n")]
    table = spark.createDataFrame(rows, "page_id long, html string")
    got = [tuple(r) for r in pages.extract_pages(table).orderBy("page_id").collect()]
    assert got == [(i, title, 1, 1, 1, "ok") for i, title in enumerate(ODD.values())] + [(97, "", 0, 0, 0, "ok"), (98, "", 0, 0, 0, "ok"), (99, None, 0, 0, 0, "missing")]
    with duckdb.connect() as con:
        con.register("pages", table.toArrow())
        assert con.execute(page_queries.ORACLE["page_reports"] + " ORDER BY page_id").fetchall() == got


def test_parts_and_numbers_take_blanks_of_any_width():
    row = read_page(_page(head="<h1>\u00a0Old Town\u3000<br>North / Atlantis<br>\u00a0<br># 7</h1>", bars=BAR.replace("1 666", "\u00a01\u00a0666") * 6, stats=STATS.replace(" 1 024", "&nbsp;<i>1&nbsp;024</i>")), pages.REPORT)
    assert (row["Zone Name"], row["Region"], row["Zone ID"], row["Swarm Ending Bots"], dict(row["stats"])["Total Launches"]) == ("Old Town", "North", 7, 1666, 1024)


def test_rejects_are_counted_and_have_no_row(spark):
    rows = [(1, _page()), (2, None), (3, _page(players="")), (4, _page(players="")), (5, _page(stats=""))]
    read = extract.extract(spark.createDataFrame(rows, "report_id long, html string"), pages.REPORT, "report_id")
    assert [r.report_id for r in extract.accepted(read).orderBy("report_id").collect()] == [1, 5]
    assert {tuple(r) for r in extract.reject_counts(read).collect()} == {("no page", "", 1), ("missing", "players", 2)}
    raw = pages.extract_reports(spark.createDataFrame(rows, "report_id long, html string"))
    staged = {r.battle_report_number: r for r in staging.stage_reports(raw).collect()}
    assert staged[1].is_tournament and staged[1].total_launches == 1024 and staged[1].legion_total_launches == 1000 and staged[5].bots_killed is None
    assert extract.extract(spark.createDataFrame([], "page_id long, html string"), pages.ARTICLE).collect() == []


def test_pages_rendered_from_reports_are_read_back(spark):
    rows = [(k, -k if k == 18 else k, dt.date(2020, 1, 1 + k % 28), 1234 * k, k, 0, 1235 * k, 1 + k % 3, f"Zone ({k})", "Süd", "Land") for k in range(13, 39)]
    reports = spark.createDataFrame(rows, "report_id long, zone_id long, report_date date, launch_1 long, launch_2 long, launch_3 long, launches long, players long, zone_name string, region_name string, country_name string")
    got = {r["Battle Report Number"]: r for r in pages.extract_reports(pages.render_reports(reports)).collect()}
    assert sorted(got) == [k for k in range(13, 39) if k % 13 > 4]
    for k, row in got.items():
        assert row["Legion Total Launches"] == 1234 * k and row["Bots Launched"] == 8645 * k
        assert row["Date"] == rows[k - 13][2] and row["players"] == ",".join(f"Player & {i}" for i in range(1, 2 + k % 3))


def test_link_numbers_are_sorted_and_distinct(spark):
    html = "<a href='/x/reports/20'>a</a><a href=/reports/3>b</a><a href='/reports/20'>c</a><a href='/reports/4/map'>d</a><a href='/reports/'>e</a><a name=reports>f</a>"
    index = spark.createDataFrame([(1, html)], "day int, html string")
    assert pages.report_numbers(index, "day").first().numbers == [3, 20]
    empty = spark.createDataFrame([(1, html), (2, "<a href='/reports/x'>none</a>")], "day int, html string")
    with pytest.raises(Exception, match="no links to /reports/"):
        pages.report_numbers(empty, "day").collect()


def test_queries_have_rejects_of_every_kind(spark):
    from driftline.plans import page_queries, queries

    m = queries.Model(spark, "/root/testdata/sf0.001")
    counted = {(r.reject, r.reject_field): r.n for r in page_queries.BUILD["report_rejects"](m).collect()}
    assert len(counted) == len(pages.BROKEN) and min(counted.values()) > 0
    assert page_queries.BUILD["report_fields"](m).where(F.col("bots_killed").isNotNull()).count() == 0
