"""Text and time expressions on one value each."""

import pytest
from pyspark.sql import functions as F

from dayline.functions import geo, text, times


@pytest.fixture(scope="module")
def one(spark):
    def value(f, *args):
        df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} {'string' if a is None or isinstance(a, str) else 'long'}" for i, a in enumerate(args)))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]

    return value


@pytest.mark.parametrize(("shown", "utc"), [("2023-03-12T02:30:00Z", "08:30:00"), ("2023-11-05T01:30:00Z", "06:30:00"), ("2023-07-01T20:00:00Z", "01:00:00"), ("bad", None)])
def test_zone(one, shown, utc):
    assert one(times.utc_time_of_day, shown) == utc


@pytest.mark.parametrize(("shown", "n"), [("PT3H2M1S", 10921), ("PT45M", 2700), ("PT59S", 59), ("P0D", 0), ("P1DT2H", None), ("PT", None), (None, None)])
def test_duration(one, shown, n):
    assert one(times.iso_duration_seconds, shown) == n


@pytest.mark.parametrize(("shown", "day"), [("Sept. 5, 2023", "2023-09-05"), ("May 5, 2023", "2023-05-05"), ("Nov, 21, 2011", "2011-11-21"), ("September 5, 2023", "2023-09-05"), ("soon", "soon")])
def test_month_names(one, shown, day):
    assert one(times.month_name_date, shown) == day


@pytest.mark.parametrize(("d", "t", "out"), [("20231101", "123456", "2023-11-01T12:34:56Z"), ("20231101", "1234", "20231101"), ("20231101", "", "20231101")])
def test_compact(one, d, t, out):
    assert one(times.compact_time, d, t) == out


@pytest.mark.parametrize(("shown", "ok"), [("23:59:59", True), ("24:00:00", False), ("1:2:3", True), ("aa:00:00", False), ("12:00", False), ("12x:00:00", True), ("", False)])
def test_hms(one, shown, ok):
    assert one(times.is_hms, shown) is ok


def test_clock(one):
    assert one(times.playback_clock, "23:59:59.5", 1000, 3000) == "24:00:01.500"
    assert one(times.playback_clock, "00:00:01", 0, 250) == "00:00:01.250"


@pytest.mark.parametrize(("name", "day"), [("1-9-23_a.zip", "2023-01-09"), ("01-09-23_a.zip", "2023-01-09"), ("x.zip", None)])
def test_archive(one, name, day):
    assert one(times.archive_date, name) == day


@pytest.mark.parametrize(
    ("name", "found"),
    [("1_SYNC_SG4_2024-01-08_02_09_04_by_x", ("2024-01-08_02_09_04", "4")), ("1_1_SG4_DUP_2024-07-02_13_56_41_by_x", ("2024-07-02_13_56_41", "4")), ("1_SG12_2024-07-02_13_56_41_by_x", ("2024-07-02_13_56_41", "2")), ("other", None)],
)
def test_recording(one, name, found):
    got = one(text.recording_name, name)
    assert (tuple(got) if got else None) == found


def test_text(one):
    assert one(text.word_count, "a b  c") == 3
    assert one(text.word_count, "") == 0
    assert one(text.channel_of, "x_SG_12.json") == 12
    assert one(text.channel_of, "x") is None
    assert one(lambda c: text.title_kept(c, text.TITLE_INCLUDE, text.TITLE_EXCLUDE), "Mission recap") is True
    assert one(lambda c: text.title_kept(c, text.TITLE_INCLUDE, text.TITLE_EXCLUDE), "ISS Update") is False
    assert one(text.without_notes, "a[1][2] 07:33:10") == "a 07:33"
    assert one(text.absolute_url, "//x/y") == "https://x/y"
    assert one(times.leading_int, "12x") == 12
    assert one(text.descriptor_of, "2024-01-08T020904-view_SG_1_2.json") == "view_SG_1"
    out = one(text.description_html, '<a href="/wiki/X">x</a><sup class="reference">[1]</sup>')
    assert out == '<a target="_blank" href="https://en.wikipedia.org/wiki/X">x</a>'


def test_terminator(spark):
    for day, north in (("2024-06-21", True), ("2024-12-21", False)):
        ring = spark.sql(f"SELECT DATE'{day}' AS d").select(geo.terminator_ring(F.col("d")).alias("r")).first()["r"]
        assert len(ring) == 1444
        assert ring[0] == ring[-1]
        assert ring[0]["lat"] == (-90.0 if north else 90.0)


def test_white_space_at_ends(spark):
    df = spark.createDataFrame([("\u00a0\n a|b\t\r\n",), (" \u3000",), (None,)], "t string")
    assert [r[0] for r in df.select(text.scrub(F.col("t"))).collect()] == ["a b", "", None]
