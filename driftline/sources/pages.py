"""What the given pages and report pages hold, as specs, and report pages made from reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import Beside, Listed, Ordered, Value, accepted, extract, link_numbers

#: The parts of a given page: its title, heading, navigation, paragraphs and notice.
ARTICLE = (
    Value("title", "title", required=False),
    Value("heading", "article > h1", required=False),
    Listed("links", "a[href]", attribute="href"),
    Listed("labels", "nav > ul > li > a"),
    Listed("paragraphs", "article > p"),
    Value("notice", "div.ad", required=False),
)
_COUNTED = (Value("title", "title", required=False), Listed("links", "a[href]", attribute="href"), *(Listed(tag, tag) for tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p")))

#: The bars of a report page, in the order in which it shows them.
BARS = tuple(f"{faction} {when} Bots" for when in ("Starting", "Ending") for faction in ("Swarm", "Legion", "Faceless"))
REPORT = (
    Value("Zone Name", "h1", part=0, blanks=("", "/")),
    Value("Region", "h1", "before /", part=1),
    Value("Country", "h1", "after /", part=1),
    Value("Zone ID", "h1", "id", part=2),
    Value("Date", "strong", "day"),
    Ordered(BARS, "div.progress"),
    Beside("stats", "div.col-md-5", "div.col-md-7", "td"),
    Listed("players", "div.col-sm-6 > div.table-responsive > table > tbody > tr > td", required=True),
)
INDEX = (Listed("links", "a[href]", attribute="href"),)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Title and counts of each page, with a status; missing pages and rejects keep their row."""
    read = extract(pages, _COUNTED)
    size = lambda *names: F.coalesce(sum((F.size(n) for n in names[1:]), F.size(names[0])), F.lit(0)).cast("int")
    status = F.when(F.col("reject").isNull(), "ok").when(F.col("reject") == "no page", "missing").otherwise(F.concat(F.lit("rejected: "), "reject"))
    title = F.when(status == "ok", F.coalesce("title", F.lit("")))
    counted = lambda *names: F.when(status == "ok", size(*names)).otherwise(0)
    return read.select("page_id", title.alias("title"), counted("links").alias("n_links"), counted("h1", "h2", "h3", "h4", "h5", "h6").alias("n_headings"), counted("p").alias("n_paragraphs"), status.alias("status"))


def extract_reports(pages: DataFrame, number: str = "report_id", html_col: str = "html") -> DataFrame:
    """Report pages as raw reports: one column per statistic, under the page's own names, and one row per page that has a report."""
    from .staging import REPORTS

    read = accepted(extract(pages, REPORT, number, html_col))
    own = {"Battle Report Number": F.col(number), "Total Active Players": F.col("stats")["Total Active Players"]}
    columns = [own.get(name, F.col(f"`{name}`") if name in read.columns else F.col("stats")[name]).alias(name) for name in REPORTS]
    return read.select(*columns, F.array_join("players", ",").alias("players"))


def report_numbers(index: DataFrame, by: str, html_col: str = "html", mark: str = "/reports/") -> DataFrame:
    """The distinct report numbers that each index page links to, in order; a page without any is an error."""
    return extract(index, INDEX, by, html_col).select(by, link_numbers("links", mark).alias("numbers"))


def _spaced(number: Column) -> Column:
    return F.regexp_replace(F.format_number(number, 0), ",", " ")


#: Report pages that are made unreadable, by the remainder of their number by 13.
BROKEN = {0: "no page", 1: "blank heading", 2: "five bars", 3: "no players", 4: "a word for a number"}


def render_reports(reports: DataFrame) -> DataFrame:
    """(report_id, html): a page for each report with its zone's names, some of them broken as ``BROKEN`` says."""
    kind = F.col("report_id") % 13
    legion, swarm, faceless = (F.col(f"launch_{k}") for k in (1, 2, 3))
    bars = [F.concat(F.lit('<div class="progress"><div class="progress-bar" style="width: 9%">'), _spaced(x * k + 1000), F.lit("</div></div>")) for k, x in ((1, swarm), (2, legion), (3, faceless), (4, swarm), (5, legion))]
    last = F.concat(F.lit("<div class='progress'>"), _spaced(faceless * 6 + 1000), F.lit("</div>"))

    def stat(label: str, total: Column, split: bool) -> Column:
        cells = [F.concat(F.lit(f'<td class="{n} text-right">'), _spaced(x), F.lit("</td>")) for n, x in (("Legion", legion), ("Swarm", swarm), ("Faceless", faceless))]
        table = [F.lit('<div class="col-md-7"><table><tr>'), *cells, F.lit("</tr></table></div>")] if split else []
        return F.concat(F.lit(f'<div class="row"><div class="col-md-5 stat"><b>{label}:</b> '), total, F.lit("</div>"), *table, F.lit("</div>"))

    heading = F.concat(F.lit("<h1> "), "zone_name", F.lit("<br/>"), "region_name", F.lit(" / "), "country_name", F.lit("<br>#"), F.col("zone_id").cast("string"), F.lit("</h1>"))
    players = F.transform(F.sequence(F.lit(1), F.col("players").cast("int")), lambda k: F.concat(F.lit("<tr><td>Player &amp; "), k.cast("string")))
    table = F.concat(F.lit('<div class="row col-sm-6"><div class="table-responsive"><table><thead><tr><th>who<tbody>'), F.when(kind == 3, "").otherwise(F.array_join(players, "")), F.lit("</table></div></div>"))
    launches = F.when(kind == 4, F.lit("n/a")).otherwise(_spaced(F.col("launches")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Report</title><script>if (a<b) document.write('<h1>no</h1>')</script></head><body>"), F.when(kind == 1, F.lit("<h1>/</h1>")).otherwise(heading),
        F.lit("<p>Fought on <strong>"), F.date_format("report_date", "M/d/yyyy"), F.lit("</strong>"), *bars, F.when(kind == 2, "").otherwise(last),
        stat("Total Launches", launches, True), stat("Total Active Players", _spaced(F.col("players")), False), stat("Bots Launched", _spaced(F.col("launches") * 7), True), table, F.lit("</body></html>"),
    )
    return reports.select("report_id", F.when(kind != 0, html).alias("html"))


def render_index(reports: DataFrame) -> DataFrame:
    """(report_date, html): the day's page of links to reports, some of them twice, with links that lead elsewhere."""
    links = F.array_sort(F.collect_list("report_id"))
    lines = F.transform(links, lambda n: F.concat(F.lit("<li><a class=x href='https://example.org/reports/"), n.cast("string"), F.lit("'>report</a> <a href=\"/reports/"), n.cast("string"), F.lit('/map">map</a>')))
    html = F.concat(F.lit('<a href="/about">About</a><ul>'), F.array_join(F.reverse(lines), ""), lines[0], F.lit("</ul>"))
    return reports.groupBy("report_date").agg(html.alias("html"))
