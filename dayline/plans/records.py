"""Files written and read back, the archive's own records, and what is known of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import sequences
from ..sources import documents, files, pipe, zips
from . import dayview
from .registry import Tables, query


@query("json_documents", "SELECT conv_id, turn, role, text FROM conversations")
def json_documents(t: Tables) -> DataFrame:
    """One JSON array for each conversation, written in order and read back as documents."""
    path = files.scratch(t.spark, "documents")
    files.write_array(t.conversations.select("conv_id", "turn", "role", "text"), path, "conv_id", ["turn"])
    return files.read_documents(t.spark, path, "turn long, role string, text string, conv_id long").select("conv_id", "turn", "role", "text")


@query("day_partitions", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def day_partitions(t: Tables) -> DataFrame:
    """Events below their days, written once whole and once more in part; the days there are, and their rows."""
    path = files.scratch(t.spark, "days")
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id")
    files.write_days(rows, path)
    files.write_days(rows.where("event_id % 2 = 0").unionByName(rows.where("event_id % 2 = 1")), path)
    back = t.spark.read.json(path)
    return files.available_days(back.select("year", "month", "day")).join(back.groupBy("date").agg(F.count(F.lit(1)).alias("n")), "date")


@query("month_elements", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z')) AS first_epoch FROM orders GROUP BY 1")
def month_elements(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "months")
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderdate").cast("timestamp").alias("epoch"), F.col("o_orderkey").cast("string").alias("tle_line1"))
    files.write_months(rows, path, "month")
    back = t.spark.read.schema("epoch string, tle_line1 string, month string").json(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first_epoch"))


@query("recording_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events")
def recording_days(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "recordings")
    rows = t.events.select(times.iso_z(F.col("ts")).alias("startTime"), F.col("event_id").cast("string").alias("videoId"), F.lit("9").alias("duration"), F.col("event_type").alias("title"))
    pipe.write(rows, path, pipe.RECORDINGS)
    return pipe.recording_days(t.spark, path)


@query("pipe_files", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role FROM conversations")
def pipe_files(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "lines")
    pipe.write(t.conversations.withColumn("part", F.col("conv_id") % 4), path, ["conv_id", "turn", "role"], ["part"], ["conv_id", "turn"])
    return pipe.read(t.spark, path, ["conv_id", "turn", "role"])[0].select("conv_id", "turn", "role")


@query("tracked_lines", "SELECT DISTINCT source AS value FROM documents WHERE source <> 'src0' UNION SELECT DISTINCT lang FROM documents")
def tracked_lines(t: Tables) -> DataFrame:
    """A set of lines read from files, with lines added and others taken out."""
    path = files.scratch(t.spark, "status")
    t.documents.select(F.concat(F.lit(" "), "source", F.lit(" ")).alias("value")).write.text(path)
    known = files.line_set(t.spark, path)
    drop = known.where("value = 'src0'")
    return files.track(known, add=t.documents.select(F.col("lang").alias("value")), drop=drop)


@query("empty_manifest", """WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders), p AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1)
    SELECT date, coalesce(n, 0)::INT AS n_images, first AS first_image FROM d LEFT JOIN p USING (date)""")
def empty_manifest(t: Tables) -> DataFrame:
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("ID"))
    whole = files.manifest(rows.select("date").distinct(), rows.where("ID % 50 = 0"))
    return whole.select("date", F.size("images").alias("n_images"), F.get("images", F.lit(0))["ID"].alias("first_image"))


@query(
    "photo_manifest",
    """WITH r AS (SELECT 'ISS' || lpad((user_id % 70)::VARCHAR, 3, '0') AS mission, 'E' AS roll, (event_id // 3)::VARCHAR AS frame, strftime(ts, '%Y%m%d') AS pdate, strftime(ts, '%H%M%S') AS ptime,
        CASE event_id % 3 WHEN 0 THEN '/p/large/x' WHEN 1 THEN '/p/small/x' ELSE '/p/raw/x' END AS directory, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_id || '.JPG' END AS filename, event_id FROM events),
      g AS (SELECT *, directory || '/' || filename AS url FROM r WHERE filename <> '' AND directory <> '/p/raw/x')
    SELECT concat_ws('-', mission, roll, frame) AS "ID", strftime(strptime(arg_min(pdate || ptime, event_id), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') AS "dateTaken",
      max(url) FILTER (WHERE directory = '/p/small/x') AS "smallUrl", max(url) FILTER (WHERE directory = '/p/large/x') AS "largeUrl"
    FROM g GROUP BY mission, roll, frame HAVING "smallUrl" IS NOT NULL AND "largeUrl" IS NOT NULL""",
)
def photo_manifest(t: Tables) -> DataFrame:
    n = F.col("event_id")
    where = F.when(n % 3 == 0, "/p/large/x").when(n % 3 == 1, "/p/small/x").otherwise("/p/raw/x")
    records = t.events.select(
        F.concat(F.lit("ISS"), F.lpad((F.col("user_id") % 70).cast("string"), 3, "0")).alias("mission"), F.lit("E").alias("roll"), F.floor(n / 3).cast("string").alias("frame"), F.date_format("ts", "yyyyMMdd").alias("pdate"), F.date_format("ts", "HHmmss").alias("ptime"),
        where.alias("directory"), F.when(n % 11 == 0, "").otherwise(F.concat(n.cast("string"), F.lit(".JPG"))).alias("filename"), "event_id",
    )
    return dayview.photo_manifest(records, ["event_id"])


@query(
    "cell_text",
    """SELECT event_id, strftime(ts, '%H:%M') || ' and ' || event_id || ' ' AS bare, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS day_time, CASE WHEN event_id % 2 = 0 THEN 'https://img/' || event_id ELSE '/img/' || event_id END AS url, event_id % 3 <> 0 AS number,
      'see <a target="_blank" class="x" href="https://en.wikipedia.org/wiki/N' || event_id || '">it</a>' AS description, event_id % 3 AS channel, event_id % 5 <> 0 AS given FROM events""",
)
def cell_text(t: Tables) -> DataFrame:
    """What is done to the cells of scraped tables, on cells made of event numbers."""
    n = F.col("event_id").cast("string")
    notes = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" and "), n, F.lit(" [1][22]"))
    html = F.concat(F.lit('see <a class="x" href="/wiki/N'), n, F.lit('">it</a><sup class="a reference"><a href="#">[2]</a></sup>'))
    return t.events.select(
        "event_id", text.without_notes(notes).alias("bare"), times.iso_z(times.day_month_year(F.date_format("ts", "d MMMM yyyyHH:mm"))).alias("day_time"),
        text.absolute_url(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("//img/"), n)).otherwise(F.concat(F.lit("/img/"), n))).alias("url"), text.is_number(F.when(F.col("event_id") % 3 != 0, n).otherwise(F.concat(n, F.lit("a")))).alias("number"),
        text.description_html(html).alias("description"), text.channel_of(F.concat(n, F.lit("_SG_"), (F.col("event_id") % 3).cast("string"), F.lit(".aac"))).cast("long").alias("channel"), text.all_given(F.lit("x"), F.when(F.col("event_id") % 10 == 0, F.lit("")).when(F.col("event_id") % 5 != 0, n)).alias("given"),
    )


@query("since_2015", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate >= DATE '1990-01-01'")
def since(t: Tables) -> DataFrame:
    return t.orders.where(times.since(F.col("o_orderdate").cast("timestamp"), "1995-06-01")).select("o_orderkey")


@query("checked_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-02-28') END AS day FROM orders")
def checked_days(t: Tables) -> DataFrame:
    """Order days as text, of which some are no days: a thirtieth of February, a thirteenth month."""
    wrong = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-02-28")).when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-13-dd"))
    day = times.checked_day(F.when(F.col("o_orderkey") % 5 == 0, wrong).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t.orders.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query(
    "channel_forms",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id::INT END AS channel, CASE WHEN event_id % 3 = 1 THEN user_id::VARCHAR ELSE 'unknown' END AS counted, CASE WHEN event_id % 3 <> 0 THEN user_id::INT ELSE -1 END AS strict FROM events""",
)
def channel_forms(t: Tables) -> DataFrame:
    """The three readings of a file name's channel, on names with a number before the group, without one, and without a channel."""
    user = F.col("user_id").cast("string")
    name = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("2019-01-29T020513-1_SG_"), user, F.lit("_IA.aac"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit("x_SG_"), user, F.lit(".aac"))).otherwise(F.concat(F.lit("none_"), user, F.lit(".aac")))
    strict = F.when(F.col("event_id") % 3 != 0, text.channel_or_error(name)).otherwise(-1)
    return t.events.select("event_id", text.channel_of(name).alias("channel"), text.channel_or_unknown(name).alias("counted"), strict.alias("strict"))


@query(
    "day_view",
    """WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events),
      e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) FILTER (WHERE event_type = 'view') AS n_transcripts, count(*) FILTER (WHERE event_type = 'click') AS n_images, count(*) FILTER (WHERE event_type = 'purchase') AS n_recordings,
        min(event_id) FILTER (WHERE event_type = 'view') AS first_transcript FROM events GROUP BY 1),
      c AS (SELECT date, count(*) AS n_crew FROM d JOIN nation ON CAST(date AS DATE) >= DATE '2024-01-01' + (n_nationkey::INT) AND CAST(date AS DATE) <= DATE '2024-01-10' + (2 * n_nationkey)::INT GROUP BY 1),
      x AS (SELECT date, min(r_regionkey) AS expedition FROM d JOIN region ON strftime(DATE '2024-01-01' + (6 * r_regionkey)::INT, '%Y-%m-%d') <= date AND strftime(DATE '2024-01-07' + (6 * r_regionkey)::INT, '%Y-%m-%d') >= date GROUP BY 1)
    SELECT date, n_transcripts::INT AS n_transcripts, first_transcript, n_images::INT AS n_images, n_recordings::INT AS n_recordings, 0 AS n_spacewalks, coalesce(n_crew, 0)::INT AS n_crew, expedition::INT AS expedition
    FROM d JOIN e USING (date) LEFT JOIN c USING (date) LEFT JOIN x USING (date)""",
)
def day_view(t: Tables) -> DataFrame:
    """Each day of the events with what they, the nations (as crew) and the regions (as expeditions) have for it."""
    dated = t.events.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    kind = lambda name: dated.where(F.col("event_type") == name).select("date", "event_id")
    recordings = dated.where("event_type = 'purchase'").select(times.iso_z(F.col("ts")).alias("startTime"), F.col("event_id").cast("string").alias("videoId"))
    first = F.lit("2024-01-01").cast("date")
    crew = t.nation.select(F.col("n_name").alias("name"), F.date_add(first, F.col("n_nationkey").cast("int")).cast("timestamp").alias("arrivalDate"), F.date_add(first, (9 + 2 * F.col("n_nationkey")).cast("int")).cast("timestamp").alias("departureDate"))
    day = lambda n: F.date_format(F.date_add(first, (6 * F.col("r_regionkey") + n).cast("int")), "yyyy-MM-dd")
    terms = t.region.select(F.col("r_regionkey").cast("int").alias("expedition"), day(0).alias("start"), day(6).alias("end"))
    walks = t.events.where("event_id < 0").select(F.col("ts").alias("startTime"), "event_id")
    view = dayview.day_view(dated.select("date").distinct(), transcripts=kind("view"), images=kind("click"), recordings=recordings, spacewalks=walks, crew=crew, expeditions=terms)
    sizes = [F.size(c).alias(f"n_{c}") for c in ("transcripts", "images", "recordings", "spacewalks", "crew")]
    return view.select("date", *sizes, F.get("transcripts", F.lit(0))["event_id"].alias("first_transcript"), F.col("expedition.expedition").alias("expedition"))


@query("file_collisions", "SELECT event_id, 'f' || (event_id % 7) || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.wav' AS target FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1 AS n FROM events)")
def file_collisions(t: Tables) -> DataFrame:
    named = t.events.select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"), F.lit(".wav")).alias("name"))
    return sequences.collision_names(named, "name", ["event_id"]).select("event_id", "target")


@query(
    "free_names",
    """WITH x AS (SELECT event_id, 'u' || (user_id % 5) || CASE WHEN event_id % 4 = 0 THEN '_' || (event_id % 97) ELSE '' END || '.wav' AS name FROM events),
    y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS i FROM x), n AS (SELECT DISTINCT name FROM x),
    k AS (SELECT name, unnest(range(1, 2 * (max(i) + 100))) AS k FROM y GROUP BY name),
    f AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS i FROM k WHERE replace(name, '.wav', '_' || k || '.wav') NOT IN (SELECT name FROM n))
    SELECT event_id, CASE WHEN y.i = 0 THEN y.name ELSE replace(y.name, '.wav', '_' || k || '.wav') END AS target FROM y LEFT JOIN f ON f.name = y.name AND f.i = y.i""",
)
def free_names(t: Tables) -> DataFrame:
    """Names of which many are asked for by many, and some are numbered already."""
    number = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("_"), (F.col("event_id") % 97).cast("string"))).otherwise("")
    named = t.events.select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"), number, F.lit(".wav")).alias("name"))
    return sequences.collision_names(named, "name", ["event_id"]).select("event_id", "target")


@query("utterance_documents", "SELECT conv_id, turn, role, text, conv_id % 20 AS day FROM conversations")
def utterance_documents(t: Tables) -> DataFrame:
    """Each turn as a document of its own below its day, all of one role and day under one name; added in two jobs, and read back."""
    path = files.scratch(t.spark, "utterances")
    day = F.col("conv_id") % 20
    rows = t.conversations.select("conv_id", "turn", "role", "text", F.concat("role", F.lit(".json")).alias("file"), day.alias("day"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).cast("timestamp").alias("at"))
    for part in (0, 1):
        documents.write_documents(rows.where(F.col("turn") % 2 == part), path, name="file", at="at", order=["conv_id", "turn"])
    back = files.few_tasks(t.spark.read.schema("conv_id long, turn long, role string, text string, day long").option("multiLine", True).option("recursiveFileLookup", True).json(path))
    return back.select("conv_id", "turn", "role", "text", "day")


@query("archive_members", "SELECT 'd' || doc_id || '.txt' AS name, sha256(text) AS text_sha256, strlen(text) AS size FROM documents")
def archive_members(t: Tables) -> DataFrame:
    """Documents as members of zip archives, two at least and of some 64 MB of text each, read back one by one from the archives' directories."""
    path = files.scratch(t.spark, "archives")
    named = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    files.stored(zips.write_archives(zips.dealt(named, "name", "text"), path, "name", "text"), "written")
    found = zips.contents(zips.index(t.spark, path))
    return found.select("name", F.sha2("content", 256).alias("text_sha256"), "size")


@query(
    "damaged_days",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, dayofmonth(ts) % 7 AS k, event_type, event_id FROM events)
    SELECT date, CASE WHEN any_value(k) = 5 THEN 0 ELSE count(*) FILTER (WHERE event_type = 'view' AND event_id % 13 <> 0) END::INT AS n_transcripts,
      CASE WHEN any_value(k) IN (3, 5) THEN 0 ELSE count(*) FILTER (WHERE event_type = 'click') END::INT AS n_images, 0 AS n_crew,
      count(*) FILTER (WHERE event_type = 'view' AND event_id % 13 = 0) + CASE WHEN any_value(k) = 5 THEN 1 ELSE 0 END AS n_quarantined FROM e GROUP BY date""",
)
def damaged_days(t: Tables) -> DataFrame:
    """The day view from files: some days' images are missing, some are cut off and empty their days, some lines have a field too many, and there is no crew at all."""
    root = files.scratch(t.spark, "damaged")
    dated = t.events.withColumns({"date": F.date_format("ts", "yyyy-MM-dd"), "k": F.dayofmonth("ts") % 7, "n": F.col("event_id").cast("string")})
    views = dated.where("event_type = 'view'").select("date", F.date_format("ts", "HH:mm:ss").alias("utteranceTime"), F.concat("n", F.lit(".aac")).alias("filename"), F.lit("0").alias("start"), F.lit("1").alias("end"), F.lit("en").alias("language"), F.concat(F.lit("said "), "n").alias("text"), F.when(F.col("event_id") % 13 == 0, "one|more").alias("textOriginalLang"))
    pipe.write(views, f"{root}/transcripts", pipe.TRANSCRIPT, ["date"])
    images = dated.where("event_type = 'click'").groupBy("date", "k").agg(F.to_json(F.collect_list(F.struct(F.col("n").alias("ID")))).alias("value"))
    every = dated.select("date", "k").distinct().join(images, ["date", "k"], "left").where("k <> 3")
    cut = F.coalesce("value", F.lit("[]"))
    every.select("date", F.when(F.col("k") == 5, F.substr(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut).alias("value")).write.partitionBy("date").text(f"{root}/images")
    view, bad = dayview.day_view_of_files(t.spark, root, dated.select("date").distinct())
    bad = bad.groupBy(F.col("scope").alias("date")).agg(F.count(F.lit(1)).alias("n_quarantined"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("transcripts", "images", "crew")]
    return view.select("date", *sizes).join(bad, "date", "left").fillna(0, ["n_quarantined"])


@query(
    "kept_manifest",
    """WITH r AS (SELECT 'ISS' || lpad((user_id % 70)::VARCHAR, 3, '0') AS mission, 'E' AS roll, (event_id // 3 % 40)::VARCHAR AS frame, strftime(ts, '%Y%m%d') AS pdate, strftime(ts, '%H%M%S') AS ptime,
        CASE event_id % 3 WHEN 0 THEN '/p/large/x' WHEN 1 THEN '/p/small/x' ELSE '/p/raw/x' END AS directory, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_id || '.JPG' END AS filename, event_id FROM events),
      g AS (SELECT *, directory || '/' || filename AS url FROM r WHERE filename <> '' AND directory <> '/p/raw/x')
    SELECT concat_ws('-', mission, roll, frame) AS "ID", strftime(strptime(pdate || arg_min(ptime, event_id), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') AS "dateTaken",
      arg_max(url, event_id) FILTER (WHERE directory = '/p/small/x') AS "smallUrl", arg_max(url, event_id) FILTER (WHERE directory = '/p/large/x') AS "largeUrl"
    FROM g GROUP BY mission, roll, frame, pdate HAVING "smallUrl" IS NOT NULL AND "largeUrl" IS NOT NULL""",
)
def kept_manifest(t: Tables) -> DataFrame:
    """The photo manifest from three batches that come in no order, each merged into the days that it has photos of."""
    n = F.col("event_id")
    where = F.when(n % 3 == 0, "/p/large/x").when(n % 3 == 1, "/p/small/x").otherwise("/p/raw/x")
    records = dayview.given_photos(t.events.select(
        F.concat(F.lit("ISS"), F.lpad((F.col("user_id") % 70).cast("string"), 3, "0")).alias("mission"), F.lit("E").alias("roll"), (F.floor(n / 3) % 40).cast("string").alias("frame"), F.date_format("ts", "yyyyMMdd").alias("pdate"), F.date_format("ts", "HHmmss").alias("ptime"),
        where.alias("directory"), F.when(n % 11 == 0, "").otherwise(F.concat(n.cast("string"), F.lit(".JPG"))).alias("filename"), "event_id",
    ))
    photos = dayview.kept_photos(t.spark, files.scratch(t.spark, "kept"), ["event_id"])
    for number, part in enumerate((2, 0, 1)):
        photos.merge(records.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), number)
    return dayview.photos_of(photos.table(records))
