"""Sources, sinks, tables, orbits and streams."""

import io
import json
import math
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline import models, schemas
from dayline.functions import orbit
from dayline.operators import sequences, tables
from dayline.plans import dayview, fixtures
from dayline.sources import files, pipe


def test_pipe(spark, tmp_path):
    rows = spark.createDataFrame([("2024", "01", "02", "b|x", None), ("2024", "01", "02", "a", '"q"')], "year string, month string, day string, t string, o string")
    pipe.write(rows.withColumn("t", F.replace("t", F.lit("|"), F.lit(" "))), str(tmp_path / "p"), ["t", "o"], ["year", "month", "day"], ["t"])
    good, bad = pipe.read(spark, str(tmp_path / "p"), ["t", "o"])
    assert sorted((r["t"], r["o"]) for r in good.collect()) == [("a", '"q"'), ("b x", "")]
    assert bad.count() == 0
    lines = spark.createDataFrame([("1|2|3",), ("1|2",), ("1|2|3|4",), ("",)], "value string")
    good, bad = pipe.parse(lines, ["a", "b", "c"])
    assert (good.count(), bad.count()) == (1, 2)
    assert pipe.parse(lines, ["a", "b", "c"], at_least=True)[0].count() == 2


def test_json_and_days(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", 2, None), ("2024-01-02", 1, "x"), ("2024-01-03", 3, "y")], "date string, n int, s string")
    files.write_array(rows, str(tmp_path / "a"), "date", ["n"])
    text = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "a").rglob("part-*.txt")}
    assert text == {"date=2024-01-02": [{"n": 1, "s": "x"}, {"n": 2, "s": None}], "date=2024-01-03": [{"n": 3, "s": "y"}]}
    files.write_days(rows, str(tmp_path / "d"))
    files.write_days(rows.where("n = 3").withColumn("n", F.lit(9)), str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d"))
    assert sorted(r["n"] for r in back.collect()) == [1, 2, 9]
    assert sorted(r["date"] for r in files.available_days(back.select("year", "month", "day")).collect()) == ["2024-01-02", "2024-01-03"]
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_tracking(spark, tmp_path):
    (tmp_path / "t").write_text("a\n b \n\na\n")
    known = files.line_set(spark, str(tmp_path / "t"))
    more = spark.createDataFrame([("c",)], "value string")
    assert sorted(r[0] for r in files.track(known, add=more, drop=known.where("value = 'a'")).collect()) == ["b", "c"]


def test_archives(spark, tmp_path):
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        loud = [int(8000 * math.sin(i / 3)) for i in range(160)]
        w.writeframes(struct.pack("<490h", *([0] * 160 + loud + [0] * 170)))
    for name, member in (("1-8-24_x.ZIP", "1_SYNC_SG4_2024-01-08_02_09_04_by_x.wav"), ("01-09-24_x.zip", "1_SG12_2024-01-08_13_56_41_by_x.wav")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, sound.getvalue())
            z.writestr("notes.txt", "x")
    zips = files.archives(spark, str(tmp_path))
    assert [r["date"] for r in zips.collect()] == ["2024-01-09", "2024-01-08"]
    found = files.members(spark, str(tmp_path))
    assert [(r["date_time"], r["channel"]) for r in found.collect()] == [("2024-01-08_02_09_04", "4")]
    frames = files.wav_frames(found)
    assert [(r["frame_no"], r["is_speech"]) for r in frames.orderBy("frame_no").collect()] == [(1, False), (2, True), (3, False)]
    assert sequences.voiced_sessions(frames).first()["start_ms"] == 40


def test_tables(spark):
    pages = spark.createDataFrame([("c", fixtures.CREW_PAGE)], "page string, html string")
    good, bad = tables.crew_rows(tables.scan_tables(pages, drop_last=True))
    assert bad.count() == 1
    stays = {r["name"]: r for r in tables.crew_stays(good, ["row_no"]).collect()}
    assert stays["A. Alpha"]["arrivalDate"] == "2000-11-02T09:21:00Z"
    assert stays["B. Beta"]["nationality"] == "Russia"
    assert stays["B. Beta"]["departureDate"] == "2001-03-21T07:33:00Z"
    assert stays["C. Gamma"]["arrivalFlight"] == "STS-102"
    walks = spark.createDataFrame([("w", fixtures.WALKS_PAGE)], "page string, html string")
    rows = tables.spacewalks(tables.scan_tables(walks), ["page"]).collect()
    assert [(r["number"], r["missionEvaNum"], len(r["crew"])) for r in rows] == [("1", 3, 2)]
    assert 'target="_blank"' in rows[0]["description"]
    assert "reference" not in rows[0]["description"]


def test_expedition_fields(spark):
    page = "<table><tr><th>Launch</th><td><span>May 5, 2023</span></td></tr><tr><th scope='row'>Landing date</th><td>later</td></tr></table>"
    row = tables.expedition_fields(spark.createDataFrame([(1, page)], "n int, html string")).first()
    assert (row["start"], row["end"]) == ("2023-05-05", "later")


def test_article(spark):
    page = "<p>no</p><article><h2>A</h2><p>b <b>c</b></p><ul><li>d</li></ul><div>no</div></article><article><p>no</p></article>"
    df = spark.createDataFrame([(page,), (None,), ("<p>x",)], "html string")
    assert [r[0] for r in df.select(tables.article_text(F.col("html"))).collect()] == ["A\nb c\nd", "", ""]


def test_sgp4():
    o = orbit.Orbit("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667")
    published = [[7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250], [-7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425]]
    assert np.allclose(o.state(np.array([0.0, 360.0])), published, atol=1e-6)
    assert orbit.orbit("x", "y") is None


def test_track(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00", *fixtures.TLE)], "t string, tle_line1 string, tle_line2 string").withColumn("t", F.to_timestamp("t"))
    rows = orbit.track(df).collect()
    assert len(rows) == 580
    assert all(400 < r["height_km"] < 440 and 26000 < r["speed_kmh"] < 29000 and abs(r["lat"]) < 52.5 for r in rows)


def test_track_of_two_element_sets(spark):
    """Element sets at one time are tracks of their own, and each time takes the nearest; 121 points an hour to both sides, ends included."""
    other = (fixtures.TLE[0], fixtures.TLE[1].replace("208.9163", "028.9163"))
    df = spark.createDataFrame([("2024-01-01 12:00:00", *fixtures.TLE), ("2024-01-01 12:00:00", *other)], "t string, tle_line1 string, tle_line2 string").withColumn("t", F.to_timestamp("t"))
    both = orbit.track(df).collect()
    alone = [orbit.track(df.where(F.col("tle_line2") == x[1])).collect() for x in (fixtures.TLE, other)]
    key = lambda r: (r["tle_line2"], r["i"])
    assert sorted(both, key=key) == sorted(alone[0] + alone[1], key=key)
    assert [r["i"] for r in orbit.track(df.limit(1), start=-3600, end=3600, step=60).orderBy("i").collect()] == list(range(-3600, 3601, 60))
    elements = spark.createDataFrame([("2023-12-31 00:00:00", "a", "1"), ("2024-01-02 00:00:00", "b", "1"), ("2024-01-05 00:00:00", "c", "1"), ("2024-03-01 00:00:00", "d", "1")], "epoch string, tle_line1 string, tle_line2 string").withColumn("epoch", F.to_timestamp("epoch"))
    bases = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",), ("2024-02-05 00:00:00",), ("2024-04-30 00:00:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    found = orbit.nearest_elements(bases, elements).orderBy("t").collect()
    assert [r["tle_line1"] for r in found] == ["a", "b", "d", "d"]


def test_noise_floor(spark):
    """Speech stands out of quiet and of loud noise alike; what can't be read has no frames."""
    rng = np.random.default_rng(1)
    quiet, loud = rng.normal(0, 30, 160 * 500), rng.normal(0, 900, 160 * 500)
    for at in (100, 300):
        quiet[160 * at : 160 * (at + 20)] += 400 * np.sin(np.arange(160 * 20) / 3)
        loud[160 * at : 160 * (at + 20)] += 9000 * np.sin(np.arange(160 * 20) / 3)

    def sound(x, width=2):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(8000)
            w.writeframes(x.clip(-32000, 32000).astype("<i2").tobytes())
        return out.getvalue()

    rows = [("quiet", sound(quiet)), ("loud", sound(loud)), ("both", sound(np.concatenate([quiet, loud]))), ("no", b"no sound"), ("null", None), ("none", sound(quiet[:100])), ("bytes", sound(quiet, 1))]
    got = files.wav_frames(spark.createDataFrame(rows, "name string, content binary")).where("is_speech").collect()
    found = {}
    for r in got:
        found.setdefault(r["file"], []).append(r["frame_no"])
    expected = [*range(101, 121), *range(301, 321)]
    assert sorted(found["quiet"]) == sorted(found["loud"]) == expected
    assert set(expected) | {n + 500 for n in expected} <= set(found["both"])
    assert len(found["both"]) < 100
    assert set(found) == {"quiet", "loud", "both"}


def test_transcribe_and_index(spark):
    """A model is made once in each worker and answers with the fields of its schema; answers that are no JSON are empty."""
    sounds = spark.createDataFrame([("a", b"xx"), ("b", b""), ("c", None)], "name string, content binary")
    make = lambda: lambda content: {"size": len(content or b""), "text": "said"}
    assert sorted(tuple(r) for r in models.transcribe(sounds, make, "size int, text string").collect()) == [("a", 2, "said"), ("b", 0, "said"), ("c", 0, "said")]
    df = spark.createDataFrame([("x",), ("",), (None,)], "text string")
    answers = df.select(models.safe_json(models.apply(F.col("text"), models.empty_index), "events array<string>").alias("x"))
    assert [r["x"]["events"] for r in answers.collect()] == [None] * 3
    assert df.limit(0).select(models.apply(F.col("text"), models.empty_index)).count() == 0


def test_models(spark):
    df = spark.createDataFrame([("One. Two",), (None,)], "text string")
    assert [r[0] for r in df.select(models.apply(F.col("text"), models.first_sentences)).collect()] == ["One", ""]
    assert df.select(models.safe_json(F.lit("no"), "events array<string>").alias("x")).first()["x"]["events"] is None


@pytest.fixture(scope="module")
def utterances(spark):
    rows = [
        (None, [(" Hello | there ", 0.5, 1.0), ("again", 1.0, 2.5)], None, "a.json", "d", "2023-07-01T20:00:00Z"),
        ("ru", [("Thank you.", 0.0, 1.0)], None, "b.json", "d", "2023-07-01T20:00:01Z"),
        ("ru", [("yes", 0.0, 1.0)], [("da", 0.0, 1.0)], "c.json", "d", "2023-07-01T20:00:02Z"),
    ]
    seg = schemas.SEGMENT
    return spark.createDataFrame(rows, f"language string, segments array<{seg}>, origLangSegments array<{seg}>, filename string, descriptor string, utteranceTime string")


def test_transcript_rows(utterances):
    got = [tuple(r)[:7] for r in dayview.transcript_rows(utterances).orderBy("filename").collect()]
    assert got == [("01:00:00", "a.aac", "0.5", "2.5", "en", "Hello   there again", ""), ("01:00:02", "c.aac", "0.0", "1.0", "ru", "yes", "da")]


def test_day_view(spark, utterances):
    days = spark.createDataFrame([("2023-07-01",), ("2023-07-02",)], "date string")
    transcripts = dayview.transcript_rows(utterances).withColumn("date", F.lit("2023-07-01"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    crew = spark.createDataFrame([("A", None, "2023-07-02 10:00:00")], "name string, a string, d string").select("name", F.to_timestamp("a").alias("arrivalDate"), F.to_timestamp("d").alias("departureDate"))
    terms = spark.createDataFrame([(68, "2023-01-01", "2023-07-01"), (69, "2023-07-01", None), (70, "2023-07-01", "2023-12-01")], "expedition int, start string, end string")
    view = dayview.day_view(days, transcripts=transcripts, images=none("date string, ID string"), recordings=none(schemas.RECORDING), spacewalks=none(schemas.SPACEWALK), crew=crew, expeditions=terms)
    rows = {r["date"]: r for r in view.collect()}
    assert [len(rows["2023-07-01"][c]) for c in ("transcripts", "images", "crew")] == [2, 0, 1]
    assert (rows["2023-07-01"]["expedition"]["expedition"], rows["2023-07-02"]["expedition"]["expedition"]) == (68, 70)


def test_photos(spark):
    rows = [("m", "r", "1", "20231101", "123456", "x/large/y", "a.jpg", 1), ("m", "r", "1", "20231101", "123456", "x/small/y", "b.jpg", 2), ("m", "r", "2", "20231101", "1234", "x/large/y", "c.jpg", 3), ("m", "r", "1", "20231101", "123456", "x/large/y", "d.jpg", 4)]
    df = spark.createDataFrame(rows, "mission string, roll string, frame string, pdate string, ptime string, directory string, filename string, pos int")
    assert [tuple(r) for r in dayview.photo_manifest(df, ["pos"]).collect()] == [("m-r-1", "2023-11-01T12:34:56Z", "x/small/y/b.jpg", "x/large/y/d.jpg")]


def test_streams(spark, tmp_path, utterances):
    from dayline.streaming import sessions

    inbox = tmp_path / "in" / "year=2023" / "month=07" / "day=01"
    inbox.mkdir(parents=True)
    for i, line in enumerate(utterances.toJSON().collect()):
        (inbox / f"{i}.json").write_text(line)
    for _ in range(2):
        sessions.ingest_utterances(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["filename"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.aac", "c.aac"]

    frames = [("f", f"2024-01-01 00:00:{n * 20 / 1000:06.3f}", n in (1, 12, 24)) for n in range(1, 40)] + [("f", "2024-01-01 01:00:00.000", True)]
    df = spark.createDataFrame(frames, "file string, ts string, is_speech boolean").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = sessions.voiced_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "frames")))
    q = stream.writeStream.format("memory").queryName("voiced").outputMode("append").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_speech"] for r in spark.table("voiced").collect()) == [1, 2]
    assert sessions.clock(spark, "00:00:00", 0).isStreaming


def test_scan_in_small_parts(spark):
    """However many pages a batch has, a task gives out rows whenever it has read some characters, and they are those of each page by itself."""
    body = "".join(f"<tr><td>{i}</td><td>{'x' * 2000}</td></tr>" for i in range(20))
    pages = spark.range(0, 200, 1, 1).selectExpr("id AS page", "'2024-01-01' AS day", "timestamp_seconds(id) AS at", f"""concat('<table class="wikitable"><tr><th>', id, '</th></tr>', IF(id % 3 = 0, '', '{body}'), '</table>') AS html""")
    rows = tables.scan_tables(pages).selectExpr("page", "day", "at", "row_no", "size(cells) AS n").collect()
    assert len(rows) == 133 * 20
    assert {(r["page"], r["n"], r["day"], r["at"].timestamp() == r["page"]) for r in rows} == {(i, 2, "2024-01-01", True) for i in range(200) if i % 3}
    sizes = tables.scan_tables(pages).mapInArrow(lambda batches: (b.select(["row_no"]) for b in batches), "row_no int").count()
    assert sizes == len(rows)
    assert tables.GIVEN <= 1 << 20
    assert tables.page_rows(None) == []


def test_article_in_small_parts(spark):
    pages = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('<article><p>', repeat('y', 1000), id, '</p></article>') AS html")
    got = pages.select("id", tables.article_text(F.col("html")).alias("t")).collect()
    assert all(r["t"] == "y" * 1000 + str(r["id"]) for r in got)
    assert len(got) == 3000
