"""Text, names, times and geometry on the document, conversation and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..operators import aggregates, joins, sequences
from ..sources import pipe
from . import dayview
from .registry import Tables, query

SPACES = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> ''))"
LANGUAGES = [("en", "English"), ("de", "German"), ("fr", "French")]


def _words(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source", text.word_count(F.col("text")).cast("long").alias("words"))


@query("word_stats_lang", f"SELECT lang, sum({WORDS})::BIGINT AS words FROM documents GROUP BY lang ORDER BY words DESC, lang")
def word_stats_lang(t: Tables) -> DataFrame:
    return _words(t).groupBy("lang").agg(F.sum("words").alias("words")).orderBy(F.desc("words"), "lang")


@query("word_stats_source", f"SELECT source, sum({WORDS})::BIGINT AS words FROM documents GROUP BY source")
def word_stats_source(t: Tables) -> DataFrame:
    return _words(t).groupBy("source").agg(F.sum("words").alias("words"))


@query("word_totals", f"WITH w AS (SELECT lang, source, {WORDS} AS words FROM documents) SELECT lang, source, sum(words)::BIGINT AS words FROM w GROUP BY GROUPING SETS ((lang), (source), ())")
def word_totals(t: Tables) -> DataFrame:
    return aggregates.sums_by(_words(t), "words", "lang", "source").select("lang", "source", "words")


@query("formatted_totals", f"SELECT lang, format('{{:,}}', sum({WORDS})::BIGINT) AS total, replace('words of ' || lang, ' ', '%20') AS label FROM documents GROUP BY lang")
def formatted_totals(t: Tables) -> DataFrame:
    sums = _words(t).groupBy("lang").agg(F.sum("words").alias("n"))
    return sums.select("lang", text.thousands(F.col("n")).alias("total"), text.spaces_encoded(F.concat(F.lit("words of "), "lang")).alias("label"))


@query("language_name_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS language FROM documents")
def language_name_lookup(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame(LANGUAGES, "lang string, language string")
    return joins.lookup(t.documents.select("doc_id", "lang"), names, "lang", "language").select("doc_id", "language")


@query(
    "text_rollup",
    """SELECT conv_id, string_agg(replace(trim(text), '|', ' '), ' ' ORDER BY turn) AS text, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id""",
)
def text_rollup(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("text", text.scrub(F.col("text")))
    return aggregates.rolled_text(rows, ["conv_id"], "text", ["turn"], first_turn=F.min("turn"), last_turn=F.max("turn"))


def _listed(phrases: list[str]) -> str:
    return ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)


#: SQL for said without white space at its ends.
STRIP = "trim(said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"
# every few rows say one of the phrases
SAID = f"[{_listed(text.WORTHLESS)}]"
INSIDE = f"[{_listed(text.WORTHLESS_INSIDE)}]"


def _phrase(phrases: list[str], n: Column) -> Column:
    return F.array(*map(F.lit, phrases))[(n % len(phrases)).cast("int")]


@query("blocklist_exact", f"SELECT conv_id, turn FROM (SELECT *, CASE WHEN (conv_id + turn) % 3 = 0 THEN {SAID}[1 + conv_id % {len(text.WORTHLESS)}] ELSE text END AS said FROM conversations) WHERE NOT coalesce(said IN ({_listed(text.WORTHLESS)}), false)")
def blocklist_exact(t: Tables) -> DataFrame:
    said = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, _phrase(text.WORTHLESS, F.col("conv_id"))).otherwise(F.col("text"))
    return t.conversations.withColumn("said", said).where(~F.coalesce(F.col("said").isin(*text.WORTHLESS), F.lit(False))).select("conv_id", "turn")


@query("blocklist_contains", f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || {INSIDE}[1 + doc_id % {len(text.WORTHLESS_INSIDE)}] ELSE text END AS said FROM documents) WHERE len(list_filter({INSIDE}, lambda p: contains(said, p))) = 0")
def blocklist_contains(t: Tables) -> DataFrame:
    said = F.when(F.col("doc_id") % 4 == 1, F.concat("text", _phrase(text.WORTHLESS_INSIDE, F.col("doc_id")))).otherwise(F.col("text"))
    return t.documents.withColumn("said", said).where(~text.contains_any(F.col("said"), text.WORTHLESS_INSIDE)).select("doc_id")


@query("title_filter", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'small'))")
def title_filter(t: Tables) -> DataFrame:
    return t.part.where(text.title_kept(F.col("p_name"), ["ring", "bolt"], ["red", "small"])).select("p_partkey", "p_name")


@query(
    "audit_forall",
    """WITH x AS (SELECT conv_id, list(role ORDER BY turn) AS roles, min(length(text)) AS shortest FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_transform(list_filter(roles, lambda r: r <> 'system'), lambda r, i: i || ':' || r), ' ') AS numbered FROM x WHERE len(list_filter(roles, lambda r: r = 'system')) = 0 AND shortest >= 20""",
)
def audit_forall(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = t.conversations.groupBy("conv_id").agg(ordered.alias("turns"), F.min(F.length("text")).alias("shortest"))
    kept = rows.where(F.forall("turns", lambda x: x["role"] != "system") & (F.col("shortest") >= 20))
    numbered = F.transform(F.filter("turns", lambda x: x["role"] != "system"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x["role"]))
    return kept.select("conv_id", F.array_join(numbered, " ").alias("numbered"))


CHUNKS = """WITH RECURSIVE c AS (SELECT conv_id, turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    r AS (SELECT conv_id, turn, text, k, CASE WHEN n > 1000 THEN 1 ELSE 0 END AS chunk, n AS total FROM c WHERE k = 1
          UNION ALL SELECT c.conv_id, c.turn, c.text, c.k, CASE WHEN r.total + c.n > 1000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.total + c.n > 1000 THEN c.n ELSE r.total + c.n END
          FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)"""


@query("greedy_chunks", CHUNKS + " SELECT conv_id, turn, chunk::INT AS chunk FROM r")
def greedy_chunks(t: Tables) -> DataFrame:
    return sequences.chunked(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 1000).select("conv_id", "turn", "chunk")


@query("chunk_rollup", CHUNKS + " SELECT conv_id, chunk::INT AS chunk, string_agg(text, '. ' ORDER BY turn) AS summary, min(turn) AS start_time, max(turn) AS end_time FROM r GROUP BY conv_id, chunk")
def chunk_rollup(t: Tables) -> DataFrame:
    rows = sequences.chunked(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 1000)
    return aggregates.roll_up_chunks(rows, ["conv_id", "chunk"], "text", "turn", ["turn"])


@query(
    "pair_rows",
    """WITH x AS (SELECT *, lag(role) OVER w AS before, lag(turn) OVER w AS open_turn FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, open_turn FROM x WHERE role = 'assistant' AND before = 'user'""",
)
def pair_rows(t: Tables) -> DataFrame:
    role = F.col("role")
    return sequences.pair_rows(t.conversations, ["conv_id"], ["turn"], role == "user", role == "assistant", ["turn"]).select("conv_id", "turn", "open_turn")


@query(
    "utterance_rows",
    f"""WITH x AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS wall, CASE WHEN (conv_id + turn) % 5 = 0 THEN {SAID}[1 + conv_id % {len(text.WORTHLESS)}] WHEN turn % 2 = 1 THEN ' ' || text || ' | x' || chr(10) ELSE text END AS said FROM conversations)
    SELECT strftime((wall AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%H:%M:%S') AS utteranceTime, conv_id || '_SG_' || (turn % 4) || '.aac' AS filename, turn || '.0' AS start, (turn + 1) || '.5' AS "end",
      coalesce(nullif(role, 'user'), 'en') AS language, replace({STRIP}, '|', ' ') || CASE WHEN turn % 2 = 0 THEN ' and more' ELSE '' END AS text, '' AS "textOriginalLang"
    FROM x WHERE NOT (said IN ({_listed(text.WORTHLESS)}) AND turn % 2 = 1)""",
)
def utterance_rows(t: Tables) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    odd = F.col("turn") % 2 == 1
    said = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, _phrase(text.WORTHLESS, F.col("conv_id"))).when(odd, F.concat(F.lit(" "), "text", F.lit(" | x\n"))).otherwise(F.col("text"))
    segment = lambda words, start, end: F.struct(words.alias("text"), start.cast("double").alias("start"), end.cast("double").alias("end"))
    one, two = segment(said, F.col("turn"), F.col("turn") + 1.5), segment(F.lit("and more "), F.col("turn") + 1, F.col("turn") + 1.5)
    raw = t.conversations.select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utteranceTime"), F.concat(F.col("conv_id").cast("string"), F.lit("_SG_"), (F.col("turn") % 4).cast("string"), F.lit(".json")).alias("filename"),
        F.nullif("role", F.lit("user")).alias("language"), F.when(odd, F.array(one)).otherwise(F.array(one, two)).alias("segments"), F.lit(None).cast("array<struct<text: string, start: double, end: double>>").alias("origLangSegments"),
    )
    return dayview.transcript_rows(raw).drop("utterance_ts_utc")


@query("pipe_roundtrip", "SELECT doc_id::VARCHAR AS id, lang, replace(replace(" + STRIP.replace("said", "text") + ", '|', ' '), chr(10), ' ') AS text, 3 AS fields FROM documents")
def pipe_roundtrip(t: Tables) -> DataFrame:
    flat = t.documents.select(F.col("doc_id").cast("string").alias("id"), "lang", F.replace(text.scrub(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text"))
    lines = flat.select(pipe.line(*flat.columns).alias("value"))
    good, _ = pipe.parse(lines, ["id", "lang", "text"])
    return good.withColumn("fields", F.lit(3))


@query("json_props", """SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS INT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_props(t: Tables) -> DataFrame:
    read = F.from_json("props", "k int, missing string")
    return t.events.select("event_id", F.coalesce(read["k"], F.lit(0)).alias("k"), F.coalesce(read["missing"], F.lit("none")).alias("missing"))


@query("tz_repair", """SELECT event_id, strftime(((ts::TIMESTAMP) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%H:%M:%S') AS utc FROM events""")
def tz_repair(t: Tables) -> DataFrame:
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select("event_id", times.utc_time_of_day(shown).alias("utc"))


@query(
    "parse_ladder",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'day ' || o_orderkey END AS date FROM orders""",
)
def parse_ladder(t: Tables) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM. d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.concat(F.lit("day "), F.col("o_orderkey").cast("string")))
    return t.orders.select("o_orderkey", times.month_name_date(shown).alias("date"))


@query("compact_time", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS taken FROM events""")
def compact_time(t: Tables) -> DataFrame:
    clock = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "HHmm")).otherwise(F.date_format("ts", "HHmmss"))
    return t.events.select("event_id", times.compact_time(F.date_format("ts", "yyyyMMdd"), clock).alias("taken"))


@query("iso_duration", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) WHEN 1 THEN minute(ts) * 60 WHEN 2 THEN 0 ELSE NULL END::INT AS seconds FROM events""")
def iso_duration(t: Tables) -> DataFrame:
    part = lambda f, unit: F.concat(f("ts").cast("string"), F.lit(unit))
    shown = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("PT"), part(F.hour, "H"), part(F.minute, "M"), part(F.second, "S")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("PT"), part(F.minute, "M")))
        .when(F.col("event_id") % 4 == 2, F.lit("P0D"))
        .otherwise(F.lit("P1DT2H"))
    )
    return t.events.select("event_id", times.iso_duration_seconds(shown).alias("seconds"))


@query("hms_seconds", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds, strftime(ts, '%H:%M:%S') AS normal FROM events")
def hms_seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.hms_seconds(F.date_format("ts", "H:m:s")).alias("seconds"), times.hms_normal(F.date_format("ts", "H:m:s")).alias("normal"))


@query(
    "filename_parse",
    """WITH x AS (SELECT event_id, '1_SYNC_SG' || (event_id % 13) || '_' || strftime(ts, '%Y-%m-%d_%H_%M_%S') || '_by_x' AS name, strftime(ts, '%Y-%m-%dT%H%M%S') || '-' || event_type || '_SG_' || (event_id % 13) || '.json' AS file FROM events)
    SELECT event_id, regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2}_\\d{2}_\\d{2}_\\d{2})', 1) AS date_time, right((event_id % 13)::VARCHAR, 1) AS channel, (event_id % 13)::INT AS file_channel, strptime(file[1:17], '%Y-%m-%dT%H%M%S')::VARCHAR AS file_time FROM x""",
)
def filename_parse(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 13).cast("string")
    name = F.concat(F.lit("1_SYNC_SG"), n, F.lit("_"), F.date_format("ts", "yyyy-MM-dd_HH_mm_ss"), F.lit("_by_x"))
    file = text.file_name(F.col("ts"), F.concat("event_type", F.lit("_SG_"), n), ".json")
    read = text.recording_name(name)
    return t.events.select("event_id", read["date_time"].alias("date_time"), read["channel"].alias("channel"), text.channel_of(file).alias("file_channel"), F.date_format(text.file_time(file), "yyyy-MM-dd HH:mm:ss").alias("file_time"))


@query(
    "archive_names",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 3 <> 2""",
)
def archive_names(t: Tables) -> DataFrame:
    pattern = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M-d-yy")).otherwise(F.date_format("o_orderdate", "MM-dd-yy"))
    names = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.concat(pattern, F.lit("_archive"), F.when(F.col("o_orderkey") % 3 == 2, F.lit(".txt")).otherwise(F.lit(".ZIP"))).alias("name"))
    zips = names.where(F.endswith(F.lower("name"), F.lit(".zip")))
    read = F.regexp_replace(times.archive_date(F.col("name")), "^20(?=[6-9])", "19")
    return zips.select("o_orderkey", read.alias("date"))


@query(
    "playback_clock",
    """WITH x AS (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT * 1000 + 500 + event_id * 7919 AS ms FROM events)
    SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM x""",
)
def playback_clock(t: Tables) -> DataFrame:
    start = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(".5"))
    return t.events.select("event_id", times.playback_clock(start, F.lit(1000), F.lit(1000) + F.col("event_id") * 7919).alias("clock"))


@query("clock_seed", "SELECT event_id, strftime(ts - INTERVAL 5 SECOND, '%H:%M:%S') AS seed FROM events")
def clock_seed(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.clock_seed(F.col("ts")).alias("seed"))


@query("valid_hms", "SELECT event_id, (event_id % 30) < 24 AND event_id % 7 <> 0 AS valid FROM events")
def valid_hms(t: Tables) -> DataFrame:
    shown = F.concat((F.col("event_id") % 30).cast("string"), F.when(F.col("event_id") % 7 == 0, F.lit(":10")).otherwise(F.lit(":10:59x")))
    return t.events.select("event_id", times.is_hms(shown).alias("valid"))


@query(
    "iso_prefix_filter",
    """SELECT o_orderkey, 'lake/' || strftime(o_orderdate, '%Y/%m/%d') || '/_transcript.csv' AS path, nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, '') AS original FROM orders WHERE starts_with(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '1996-0')""",
)
def iso_prefix_filter(t: Tables) -> DataFrame:
    shown = times.iso_z(F.col("o_orderdate"))
    blank = F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.col("o_orderstatus"))
    return t.orders.where(F.startswith(shown, F.lit("1996-0"))).select("o_orderkey", text.path_of_day("lake", F.date_format("o_orderdate", "yyyy-MM-dd"), "_transcript.csv").alias("path"), F.nullif(blank, F.lit("")).alias("original"))


@query(
    "prompt_assembly",
    """WITH x AS (SELECT conv_id, string_agg(turn || ' - ' || text || chr(10), '' ORDER BY turn) AS said, min(text) AS blog FROM conversations GROUP BY conv_id)
    SELECT conv_id, 'Index the day.' || chr(10) || chr(10) || 'Blog Contents:' || chr(10) || blog || chr(10) || chr(10) || 'Transcript:' || chr(10) || said || chr(10) || 'Answer in JSON.' AS prompt FROM x""",
)
def prompt_assembly(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("timestamp"), "text"))).alias("lines"), F.min("text").alias("blog"))
    return rows.select("conv_id", aggregates.prompt(F.array("blog"), F.col("lines"), "Index the day.", "Answer in JSON.").alias("prompt"))


SUN = """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), j AS (SELECT d, epoch_us(d::TIMESTAMP) / 86400e6::DOUBLE + 2440587.5::DOUBLE AS jd FROM d),
    n AS (SELECT *, jd - 2451545.0::DOUBLE AS n FROM j),
    a AS (SELECT *, (280.460::DOUBLE + 0.9856474::DOUBLE * n) % 360.0::DOUBLE AS l, radians((357.528::DOUBLE + 0.9856003::DOUBLE * n) % 360.0::DOUBLE) AS g, n / 36525.0::DOUBLE AS c FROM n),
    e AS (SELECT *, radians(l + 1.915::DOUBLE * sin(g) + 0.02::DOUBLE * sin(g * 2)) AS lam,
      radians(23.43929111::DOUBLE - c * (46.836769::DOUBLE / 3600 - c * (0.0001831::DOUBLE / 3600 + c * (0.00200340::DOUBLE / 3600 - c * (0.576e-6::DOUBLE / 3600 - c * 4.34e-8::DOUBLE / 3600))))) AS tilt FROM a),
    p AS (SELECT *, degrees(atan(cos(tilt) * tan(lam))) AS ra0, degrees(asin(sin(tilt) * sin(lam))) AS dec FROM e),
    q AS (SELECT *, ra0 + (floor(degrees(lam) / 90) * 90 - floor(ra0 / 90) * 90) AS ra, (18.697374558::DOUBLE + 24.06570982441908::DOUBLE * n) % 24.0::DOUBLE AS gst FROM p),
    v AS (SELECT *, unnest(range(0, 1441)) AS i FROM q),
    w AS (SELECT d, dec, i + 2 AS pos, i / 2.0::DOUBLE - 360.0::DOUBLE AS lng, degrees(atan(-cos(radians(gst * 15 + (i / 2.0::DOUBLE - 360.0::DOUBLE) - ra)) / tan(radians(dec)))) AS lat FROM v),
    z AS (SELECT d, pos, lng, lat FROM w UNION ALL SELECT d, p, edge, CASE WHEN dec < 0 THEN 90.0 ELSE -90.0 END FROM q, (VALUES (1, -360.0), (1443, 360.0), (1444, -360.0)) corner(p, edge))
    SELECT strftime(d, '%Y-%m-%d') AS date, (1444 - pos)::INT AS pos, round(lng, 6)::DOUBLE AS lng, round(lat, 6)::DOUBLE AS lat FROM z"""


@query("terminator_polygon", SUN)
def terminator_polygon(t: Tables) -> DataFrame:
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    rings = days.select("day", F.posexplode(geo.terminator_ring(F.col("day"))).alias("pos", "v"))
    return rings.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "pos", F.round("v.lng", 6).alias("lng"), F.round("v.lat", 6).alias("lat"))


@query(
    "mercator_extent",
    """WITH x AS (SELECT event_id, (event_id * 37 % 360 - 180)::DOUBLE AS lon, (event_id * 17 % 160 - 80)::DOUBLE AS lat FROM events)
    SELECT event_id, round(lon * (pi() / 180 * 6378137.0), 2) AS x, round(ln(tan(pi() / 4 + lat * (pi() / 360))) * 6378137.0, 2) + 0.0 AS y, lon >= -60 AND lon <= 60 AND lat >= -30 AND lat <= 30 AS inside FROM x""",
)
def mercator_extent(t: Tables) -> DataFrame:
    lon, lat = (F.col("event_id") * 37 % 360 - 180).cast("double"), (F.col("event_id") * 17 % 160 - 80).cast("double")
    return t.events.select("event_id", F.round(geo.mercator_x(lon), 2).alias("x"), (F.round(geo.mercator_y(lat), 2) + F.lit(0.0)).alias("y"), geo.in_extent(lon, lat, -60, -30, 60, 30).alias("inside"))
