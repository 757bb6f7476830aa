"""Manifests kept up to date batch by batch, and days whose files are missing or damaged."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayline import schemas
from dayline.operators import kept
from dayline.plans import dayview
from dayline.sources import days, pipe


def photo_records(rng, n):
    rows = []
    for i in range(n):
        day, frame = rng.choice(["20240101", "20240102", "20240103", "20240131"]), rng.randint(0, 20)
        rows.append((f"M{day}", "E", str(frame), day, f"{rng.randint(0, 235959):06d}", rng.choice(["x/large/y", "x/small/y", "x/raw/y"]), rng.choice(["", f"{i}.jpg", f"{i}.jpg"]), i))
    return rows


PHOTO = "mission string, roll string, frame string, pdate string, ptime string, directory string, filename string, pos int"


def test_batches_out_of_order_equal_all_at_once(spark, tmp_path):
    """Three batches in no order, one of them again, give the manifest over all; only folders of touched days are read."""
    rng = random.Random(3)
    rows = photo_records(rng, 300)
    df = spark.createDataFrame(rows, PHOTO)
    whole = Counter(tuple(r) for r in dayview.photo_manifest(df, ["pos"]).collect())
    assert len(whole) > 20
    photos = dayview.kept_photos(spark, str(tmp_path / "kept"), ["pos"])
    given = dayview.given_photos(df)
    last_day = given.where("pdate = '20240131'")
    photos.merge(given.where("pos % 3 = 2"), 0)
    photos.merge(given.where("pos % 3 = 0 AND pdate <> '20240131'"), 1)
    read = []
    inner = photos._read
    photos._read = lambda held, schema: read.append({(r["part"], r["batch"]) for r in held}) or inner(held, schema)
    touched = photos.merge(last_day.where("pos % 3 = 0"), 2)
    assert read[0] == {("20240131", 0)}
    assert {r["pdate"] for r in touched.select("pdate").collect()} == {"20240131"}
    photos._read = inner
    photos.merge(given.where("pos % 3 = 1"), 3)
    photos.merge(given.where("pos % 3 = 1"), 3)  # run again under its number
    photos.merge(given.where("pos % 3 = 1"), 4)  # rows that come again
    photos.merge(given.limit(0), 5)
    assert Counter(tuple(r) for r in dayview.photos_of(photos.table(given)).collect()) == whole


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 3, None), ("b", None, 7)], "k string, at int, v int")
    store = kept.Kept(spark, str(tmp_path / "kept"), keys=["k"], part="k", order=["at"], values={"first": ("first", F.col("v"), None), "last": ("last", F.col("v"), F.col("v") > 5)})
    store.merge(rows, 0)
    seen = lambda: sorted((r["k"] or "", r["first"], r["last"]) for r in store.table(rows).collect())
    before = seen()
    assert before == [("", None, None), ("a", 5, 6), ("b", 7, 7)]
    state = store._merged(store._partial(spark.createDataFrame([("a", 0, 9)], rows.schema))).withColumn("folder", F.lit("61"))
    state.write.partitionBy("folder").parquet(str(tmp_path / "kept" / "state" / "1"))  # written, never committed
    assert seen() == before
    store.merge(spark.createDataFrame([("a", 3, 8)], rows.schema), 1)
    assert seen() == [("", None, None), ("a", 5, 8), ("b", 7, 7)]
    assert kept.Kept(spark, str(tmp_path / "none"), keys=["k"], part="k", order=["at"], values=store.values).table(rows).count() == 0


@pytest.mark.parametrize(("path", "scope"), [("file:/x/date=2024-01-02/part-0", "2024-01-02"), ("/a/2024/01/02/_t_2024-01-03.csv", "2024-01-03"), ("/a/2024/2024-07.json", "2024-07"), ("/a/crew.json", ""), ("/2023-01-01/x/date=2024-05-06/part-00000-1234-99.txt", "2024-05-06")])
def test_scopes(spark, path, scope):
    assert spark.createDataFrame([(path,)], "p string").select(days.scope_of(F.col("p"))).first()[0] == scope


def test_damaged_sources(spark, tmp_path):
    """A missing source is empty, a damaged one empties its days, a bad line goes alone; all of it stands in the quarantine."""
    root = tmp_path / "day"

    def put(place, text):
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_text(text)

    image = lambda n: json.dumps([{"ID": n, "dateTaken": None}])
    for day in ("01", "02", "03"):
        put(f"transcripts/2024/01/{day}/transcript_2024-01-{day}.csv", "12:00:00|a.aac|0|1|en|hello|\n12:00:01|b.aac|0\n\n12:00:02|c.aac|0|1|en|there|\n")
    put("images/2024/01/images-manifest_2024-01-01.json", image("one"))
    put("images/2024/01/images-manifest_2024-01-02.json", image("two")[:-1])
    put("recordings/all.csv", "2024-01-01T10:00:00Z|v1|9|t\n2024-01-02T10:00:00Z|v2|9|t\n")
    put("expeditions/expeditions.json", json.dumps([{"expedition": 70, "start": "2023-09-27", "end": "later"}, {"expedition": 71, "start": None, "end": "2024-02-01"}]))
    dates = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",), ("2024-01-09",)], "date string")
    view, bad = dayview.day_view_of_files(spark, str(root), dates)
    rows = {r["date"]: r for r in view.collect()}
    count = lambda d: [len(rows[d][c]) for c in ("transcripts", "images", "recordings", "spacewalks", "crew")]
    assert count("2024-01-01") == [2, 1, 1, 0, 0]
    assert count("2024-01-02") == [0, 0, 0, 0, 0]
    assert count("2024-01-03") == [2, 0, 0, 0, 0]
    assert count("2024-01-09") == [0, 0, 0, 0, 0]
    assert [rows[d]["expedition"] and rows[d]["expedition"]["expedition"] for d in sorted(rows)] == [70, None, 70, 70]
    assert Counter((r["source"], r["scope"], r["whole"]) for r in bad.collect()) == Counter([("transcripts", "2024-01-01", False), ("transcripts", "2024-01-02", False), ("transcripts", "2024-01-03", False), ("images", "2024-01-02", True)])
    put("crew/crew.json", '{"name": "no array"}')
    assert {len(r["transcripts"]) for r in dayview.day_view_of_files(spark, str(root), dates)[0].collect()} == {0}
    loaded = days.load(spark, str(tmp_path / "nowhere"), json={"images": schemas.IMAGE}, lines={"transcripts": pipe.TRANSCRIPT})
    assert [x.count() for x in (*loaded.tables.values(), loaded.quarantine)] == [0, 0, 0]
