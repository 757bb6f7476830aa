"""Operators on inputs of their own: HTML, orbits, model stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import orbit, times
from ..functions.text import WORTHLESS_INSIDE
from ..operators import aggregates, sequences, tables
from ..schemas import EVENT, SEGMENT
from .registry import Tables, query

EVENT_FIELDS = EVENT.replace(" int", ": int").replace(" string", ": string")

# A published element set.
TLE = ("1 25544U 98067A   24001.50000000  .00016717  00000-0  30270-3 0  9993", "2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.49815508000013")
CREW_PAGE = """<table class="wikitable"><tr><th>No.</th><th>Patch</th><th>Crew</th><th>Up</th><th>Flight</th><th>Down</th><th>Flight</th><th>Days</th></tr>
<tr><td>1</td><td><img src="//img/1.png"></td><td><span class="flagicon"><img alt="United States"></span><a>A. Alpha</a><br><span class="flagicon"><img alt="Russia"></span><a>B. Beta</a></td><td>2 November 2000<br>09:21[1][2]</td><td>TM-31</td><td>21 March 2001<br>07:33:10</td><td>STS-102</td><td>141</td></tr>
<tr><td><span class="flagicon"><img alt="Japan"></span><a>C. Gamma</a></td><td>8 March 2001<br>11:42</td><td>STS-102</td></tr>
<tr><td>note</td><td>x</td></tr></table><table class="wikitable"><tr><th>last</th></tr><tr><td>9</td></tr></table>"""
WALKS_PAGE = """<table class="wikitable"><tr><th>#</th></tr>
<tr><td>1.</td><td>Exp 42<small>EVA 3</small></td><td><a>A. Alpha</a><a>B. Beta</a></td><td>1 January 2015<br>00:00</td><td>1 January 2015<br>06:30</td><td>6 h 30 min</td></tr>
<tr><td colspan="6">Installed <a href="/wiki/Cable">cables</a><sup class="reference">[3]</sup></td></tr>
<tr><td>2.</td><td>Exp 70<small>EVA 1</small></td><td><a>TBD</a></td><td><a>D. Delta</a></td><td>TBD</td><td>TBD</td><td>TBD</td></tr>
<tr><td colspan="6">Planned</td></tr></table>"""


@query(
    "article_text",
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS x FROM pages),
    b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(x, '<(?:p|h2|h3|li)(?:\s[^>]*)?>', chr(1), 'g'), '</(?:p|h2|h3|li)>', chr(2), 'g'), chr(1))[2:] AS l FROM a),
    c AS (SELECT page_id, list_transform(l, lambda t: regexp_replace(replace(replace(replace(replace(regexp_replace(split_part(t, chr(2), 1), '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS l FROM b)
    SELECT page_id, array_to_string(list_filter(l, lambda t: t <> ''), chr(10)) AS content FROM c WHERE len(list_filter(l, lambda t: t <> '')) > 0""",
)
def article_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tables.article_text(F.col("html")).alias("content")).where("content <> ''")


@query("page_tables", "SELECT page_id, 0 AS table_no, unnest(range(1, 1 + page_id % 4))::INT AS row_no, 2 AS n_cells FROM pages")
def page_tables(t: Tables) -> DataFrame:
    """Rows of the tables of all pages, each of which gets a table behind its own text, and one of another class that does not count."""
    rows = F.repeat(F.lit("<tr><td>a <b>b</b></td><td>c"), (F.col("page_id") % 4).cast("int"))
    html = F.concat("html", F.lit('<table class="plain"><tr><th>x</th></tr><tr><td>y</td></tr></table><table class="sortable wikitable"><tr><th>h</th></tr>'), rows, F.lit("</table>"))
    return tables.scan_tables(t.pages.select("page_id", html.alias("html"))).select("page_id", "table_no", "row_no", F.size("cells").alias("n_cells"))


def _crew_pages(t: Tables) -> DataFrame:
    """Pages of tables of crews made of the customers, twenty a page: rows of eight cells, of three (a flag first), and of two that say nothing; then a table that ends the page."""
    key = F.col("c_custkey")
    text = key.cast("string")
    person = F.concat(F.lit('<span class="flagicon"><img alt="'), "n_name", F.lit('"></span><a>'), "c_name", F.lit("</a>"))
    day = lambda n: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (key % 9000 + n).cast("int")), "d MMMM yyyy")
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    whole = F.concat(F.lit("<tr>"), cell(text), cell(F.lit('<img src="//img/'), text, F.lit('.png">')), cell(person), cell(day(0), F.lit("<br>09:21[1][2]")), cell(F.lit("TM-"), text), cell(day(120), F.lit("<br>07:33:10")), cell(F.lit("STS-"), text), cell((key % 300).cast("string")), F.lit("</tr>"))
    short = F.concat(F.lit("<tr>"), cell(person), cell(day(7), F.lit("<br>11:42")), cell(F.lit("STS-"), text), F.lit("</tr>"))
    note = F.lit("<tr><td>note</td><td>x</td></tr>")
    row = F.when(key % 10 == 9, note).when(key % 3 == 0, short).otherwise(whole)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.floor(key / 20).alias("page"), F.struct(key.alias("k"), row.alias("row")).alias("x"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head, tail = '<table class="wikitable"><tr><th>No.</th></tr>', '</table><table class="wikitable"><tr><th>last</th></tr><tr><td>9</td></tr></table>'
    return pages.select("page", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["row"]), "\n"), F.lit(tail)).alias("html"))


@query("html_tables", "SELECT c_custkey // 20 AS page, 0 AS table_no, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey)::INT AS row_no, CASE WHEN c_custkey % 10 = 9 THEN 2 WHEN c_custkey % 3 = 0 THEN 3 ELSE 8 END AS n_cells FROM customer")
def html_tables(t: Tables) -> DataFrame:
    return tables.scan_tables(_crew_pages(t), drop_last=True).select("page", "table_no", "row_no", F.size("cells").alias("n_cells"))


@query(
    "crew_dispatch",
    """WITH c AS (SELECT *, DATE '2000-01-01' + (c_custkey % 9000)::INT AS d, c_custkey % 3 = 0 AS short FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9)
    SELECT c_name AS name, n_name AS nationality, CASE WHEN short THEN strftime(d + 7, '%Y-%m-%dT11:42:00Z') ELSE strftime(d, '%Y-%m-%dT09:21:00Z') END AS "arrivalDate", CASE WHEN short THEN 'STS-' ELSE 'TM-' END || c_custkey AS "arrivalFlight",
      CASE WHEN NOT short THEN strftime(d + 120, '%Y-%m-%dT07:33:00Z') END AS "departureDate", CASE WHEN NOT short THEN 'STS-' || c_custkey END AS "departureFlight", CASE WHEN NOT short THEN (c_custkey % 300)::VARCHAR END AS "durationDays" FROM c""",
)
def crew_dispatch(t: Tables) -> DataFrame:
    good, _ = tables.crew_rows(tables.scan_tables(_crew_pages(t), drop_last=True))
    return tables.crew_stays(good, ["page", "row_no"])


@query(
    "spacewalk_rows",
    """SELECT s_suppkey::VARCHAR AS number, 'Exp ' || s_nationkey || 'EVA ' || s_suppkey AS mission, s_suppkey::INT AS "missionEvaNum", 2 AS n_crew, strftime(DATE '2014-06-01' + (s_suppkey * 37 % 3000)::INT, '%Y-%m-%dT10:30:00Z') AS "startTime", (s_suppkey % 8) || ' h' AS duration,
      'Installed <a target="_blank" href="https://en.wikipedia.org/wiki/N' || s_suppkey || '">it</a>' AS description FROM supplier WHERE s_suppkey % 5 <> 0 AND DATE '2014-06-01' + (s_suppkey * 37 % 3000)::INT >= DATE '2015-01-01'""",
)
def spacewalk_rows(t: Tables) -> DataFrame:
    """Spacewalks made of the suppliers, ten a page, each of two rows; every fifth is planned, and early ones are before 2015."""
    n = F.col("s_suppkey").cast("string")
    day = F.date_format(F.date_add(F.lit("2014-06-01").cast("date"), (F.col("s_suppkey") * 37 % 3000).cast("int")), "d MMMM yyyy")
    end = F.when(F.col("s_suppkey") % 5 == 0, "TBD").otherwise(F.concat(day, F.lit("<br>16:30")))
    row = F.concat(F.lit("<tr><td>"), n, F.lit(".</td><td>Exp "), F.col("s_nationkey").cast("string"), F.lit("<small>EVA "), n, F.lit("</small></td><td><a>"), "s_name", F.lit("</a><a>B. Beta</a></td><td>"), day, F.lit("<br>10:30</td><td>"), end, F.lit("</td><td>"), (F.col("s_suppkey") % 8).cast("string"), F.lit(' h</td></tr>\n<tr><td colspan="6">Installed <a href="/wiki/N'), n, F.lit('">it</a><sup class="reference">[3]</sup></td></tr>'))
    rows = t.supplier.select(F.floor(F.col("s_suppkey") / 10).alias("page"), F.struct(F.col("s_suppkey").alias("k"), row.alias("row")).alias("x")).groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    pages = rows.select("page", F.concat(F.lit('<table class="wikitable"><tr><th>#</th></tr>\n'), F.array_join(F.transform("x", lambda r: r["row"]), "\n"), F.lit("</table>")).alias("html"))
    found = tables.spacewalks(tables.scan_tables(pages), ["page"])
    return found.select("number", "mission", "missionEvaNum", F.size("crew").alias("n_crew"), times.iso_z(F.col("startTime")).alias("startTime"), "duration", "description")


@query(
    "expedition_fields",
    """SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN strftime(DATE '2000-11-02' + (page_id % 5000)::INT, '%Y-%m-%d') END AS start, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'later ' || page_id ELSE strftime(DATE '2001-03-21' + (page_id % 5000)::INT, '%Y-%m-%d') END AS "end" FROM pages""",
)
def expedition_fields(t: Tables) -> DataFrame:
    """Pages with a box behind their own text: launch or start, landing or end, or neither."""
    n = F.col("page_id")
    day = lambda first: F.date_format(F.date_add(F.lit(first).cast("date"), (n % 5000).cast("int")), "MMMM d, yyyy")
    row = lambda label, text: F.concat(F.lit(f"<tr><th scope='row'>{label}</th><td><span>"), text, F.lit("</span></td></tr>"))
    begins = F.when(n % 4 == 0, row("Launch date", day("2000-11-02"))).when(n % 4 != 1, row("Start", day("2000-11-02"))).otherwise("")
    ends = F.when(n % 3 == 1, row("Landing date", F.concat(F.lit("later "), n.cast("string")))).when(n % 3 == 2, row("<b>End</b>", day("2001-03-21"))).otherwise("")
    box = F.concat("html", F.lit("<table>"), begins, ends, F.lit("</table>"))
    return tables.expedition_fields(t.pages.select("page_id", box.alias("html")))


def element_sets(days: DataFrame, each: int = 7) -> DataFrame:
    """Element sets (epoch, tle_line1, tle_line2) at noon of every so many days that there are, made of the published one."""
    chosen = days.select(F.date_trunc("day", "t").alias("t")).where(F.pmod(F.unix_date(F.col("t").cast("date")), F.lit(each)) == 0).distinct()
    epoch = F.concat(F.date_format("t", "yy"), F.lpad(F.dayofyear("t").cast("string"), 3, "0"), F.lit(".50000000"))
    return chosen.select((F.col("t") + F.expr("INTERVAL 12 HOURS")).alias("epoch"), F.concat(F.lit(TLE[0][:18]), epoch, F.lit(TLE[0][32:])).alias("tle_line1"), F.lit(TLE[1]).alias("tle_line2"))


@query("orbit_track", None)
def orbit_track(t: Tables) -> DataFrame:
    """The tracks around each day of the events, by the element set nearest to it."""
    days = t.events.select(F.date_trunc("day", F.col("ts")).cast("timestamp").alias("t")).distinct()
    found = orbit.track(orbit.nearest_elements(days, element_sets(days)))
    return found.select(F.date_format("t", "yyyy-MM-dd").alias("date"), "i", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), F.round("height_km", 2).alias("height_km"), "part")


@query(
    "nearest_elements",
    """WITH e AS (SELECT o_orderdate::TIMESTAMP AS t, min(o_orderkey::VARCHAR) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT DISTINCT l_shipdate::TIMESTAMP AS t FROM lineitem),
    x AS (SELECT b.t, e.t AS et, k FROM b ASOF LEFT JOIN e ON b.t >= e.t), y AS (SELECT b.t, e.t AS et, k FROM b ASOF LEFT JOIN e ON b.t <= e.t)
    SELECT strftime(x.t, '%Y-%m-%d') AS date, CASE WHEN y.et IS NULL OR x.t - x.et <= y.et - x.t THEN coalesce(x.k, y.k) ELSE y.k END AS element FROM x JOIN y USING (t)""",
)
def nearest_elements(t: Tables) -> DataFrame:
    """The shipping days with the urgent order nearest to each, as an element set; days beyond all orders have the last."""
    bases = t.lineitem.select(F.col("l_shipdate").cast("timestamp").alias("t")).distinct()
    elements = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("timestamp").alias("epoch"), F.col("o_orderkey").cast("string").alias("tle_line1"), F.lit("2").alias("tle_line2"))
    return orbit.nearest_elements(bases, elements).select(F.date_format("t", "yyyy-MM-dd").alias("date"), F.col("tle_line1").alias("element"))


VOICED_SQL = "WITH x AS (SELECT user_id AS file, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type IN ('view', 'click') AND user_id % 3 = 0 OR event_type = 'view' AS s FROM events), y AS (SELECT file, n, n - lag(n) OVER (PARTITION BY file ORDER BY n) AS g FROM x WHERE s), z AS (SELECT file, n, sum(CASE WHEN g IS NULL OR g > 11 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n) AS session FROM y), e AS (SELECT user_id AS file, count(*) AS last FROM events GROUP BY 1) SELECT file::VARCHAR AS file, session::BIGINT AS session, (min(n) * 20)::INT AS start_ms, min(n)::INT AS start_frame, least(max(n) + 10, any_value(last))::INT AS end_frame, count(*) AS n_speech FROM z JOIN e USING (file) GROUP BY file, session"


def voiced_rows(t: Tables) -> DataFrame:
    """Events as the frames of their users' files, some of them voiced."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select(F.col("user_id").cast("string").alias("file"), n.alias("frame_no"), ((F.col("event_type").isin("view", "click") & (F.col("user_id") % 3 == 0)) | (F.col("event_type") == "view")).alias("is_speech"))


@query("voiced_frames", VOICED_SQL)
def voiced_frames(t: Tables) -> DataFrame:
    return sequences.voiced_sessions(voiced_rows(t))


@query("summaries", "SELECT conv_id, turn, trim(split_part(text, '. ', 1)) AS summary FROM conversations")
def summaries(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", models.apply(F.col("text"), models.first_sentences).alias("summary"))


@query(
    "usable_utterances",
    "SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 0 AND (turn + conv_id) % 9 <> 0 AND NOT (" + " OR ".join(f"contains(' ' || text, '{p}')" for p in WORTHLESS_INSIDE) + ")",
)
def usable_utterances(t: Tables) -> DataFrame:
    """Turns as utterances, some without segments, some that begin with a phrase that models make of noise."""
    phrases = F.array(*map(F.lit, WORTHLESS_INSIDE))
    noise = F.get(phrases, F.pmod(F.col("conv_id"), F.lit(len(WORTHLESS_INSIDE))).cast("int"))
    said = F.when((F.col("turn") + F.col("conv_id")) % 9 == 0, noise).otherwise(F.concat(F.lit(" "), "text"))
    one = F.struct(said.alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    segments = F.when(F.col("turn") % 5 == 0, F.array().cast(f"array<{SEGMENT}>")).otherwise(F.array(one))
    return models.usable(t.conversations.withColumn("segments", segments)).select("conv_id", "turn")


@query("event_index", "SELECT conv_id, 0 AS n_events, true AS read FROM conversations GROUP BY conv_id")
def event_index(t: Tables) -> DataFrame:
    """Each conversation's prompt given to the event indexer's stand-in, whose answer is read as JSON."""
    rows = t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("timestamp"), "text")
    told = rows.groupBy("conv_id").agg(aggregates.prompt(F.array().cast("array<string>"), F.array_sort(F.collect_list(F.struct("turn", "timestamp", "text"))), "Events of a day", "As JSON:").alias("prompt"))
    answer = models.safe_json(models.apply(F.col("prompt"), models.empty_index), f"events array<struct<{EVENT_FIELDS}>>")
    return told.select("conv_id", answer.alias("x")).select("conv_id", F.coalesce(F.size("x.events"), F.lit(0)).alias("n_events"), F.col("x").isNotNull().alias("read"))


@query(
    "track_parts",
    """WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ((event_id * 37) % 360 - 180)::DOUBLE AS lng FROM events),
    y AS (SELECT *, abs(lng - lag(lng) OVER (PARTITION BY user_id ORDER BY i)) AS step FROM x), z AS (SELECT *, abs(step - lag(step) OVER (PARTITION BY user_id ORDER BY i)) > 100 AS hit FROM y),
    f AS (SELECT user_id, min(i) AS first FROM z WHERE hit GROUP BY user_id) SELECT event_id, CASE WHEN i >= first THEN 2 ELSE 1 END AS part FROM z LEFT JOIN f USING (user_id)""",
)
def track_parts(t: Tables) -> DataFrame:
    """Events of a user as the points of a track that jumps."""
    lng = (F.col("event_id") * 37 % 360 - 180).cast("double")
    points = t.events.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i"), lng.alias("lng"))
    return sequences.split_track(points, ["user_id"]).select("event_id", "part")
