"""Streams that are stopped, killed and run again, against one pass over all of it."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline.operators import sequences
from dayline.sources import files
from dayline.streaming import ingest, playback, voiced

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frames_of(rng):
    """Files with sessions of all kinds: silence of 10, 11 and more, an end inside the kept silence, none at all."""
    files = {"ten": {1, 12}, "eleven": {1, 13}, "end": {29, 30}, "kept": {20}, "none": set(), "all": set(range(1, 31))}
    files |= {f"r{i}": {n for n in range(1, 31) if rng.random() < 0.15} for i in range(12)}
    return [(f, n, n in speech) for f, speech in files.items() for n in range(1, 31)]


def plain(spark, rows):
    got = sequences.voiced_sessions(spark.createDataFrame(rows, "file string, frame_no int, is_speech boolean"))
    return Counter(tuple(r) for r in got.collect())


def test_sessions_restarted_in_disorder(spark, tmp_path):
    """Frames come in any order and twice, in four files of which two wait for a restart; some files have end marks, others end by the watermark."""
    rng = random.Random(6)
    rows = frames_of(rng)
    marked = {f for f, _, _ in rows if f[0] in "ter"}
    coming = [*rows, *rng.sample(rows, 60), *[(f, 30, None) for f in sorted(marked)]]
    rng.shuffle(coming)
    schema = "file string, frame_no int, is_speech boolean"

    def write(part, n):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame_no").cast("long") * 20))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    def run(full):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            found = voiced.voiced_sessions(stream, late="2 seconds", idle_ms=1000)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

    fourth = len(coming) // 4
    for n in range(2):
        full = write(coming[n * fourth : (n + 1) * fourth], n)
    run(full)
    early = Counter(tuple(r) for r in spark.read.schema(voiced.SESSION).parquet(str(tmp_path / "out")).collect())
    for n in range(2, 4):
        write(coming[n * fourth : (n + 1) * fourth if n < 3 else None], n)
    # frames of another file, an hour later, move the watermark
    late = spark.createDataFrame([("later", 1, False)], schema).withColumn("ts", F.timestamp_millis(F.lit(1_700_003_600_000)))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(full)
    got = Counter(tuple(r) for r in spark.read.schema(voiced.SESSION).parquet(str(tmp_path / "out")).collect())
    assert not early - got
    assert got == plain(spark, rows)


@pytest.mark.parametrize("by_mark", [True, False])
def test_line_in_any_order(by_mark):
    """A file's frames in any split give the sessions of the file in order; missing frames are silent once it is over."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 60)
        speech = [rng.random() < rng.choice([0.05, 0.2, 0.6]) for _ in range(n)]
        lost = {i for i in range(n - 1) if not speech[i] and rng.random() < 0.1} if not by_mark else set()
        expected, first, last, count = [], None, None, 0
        for no in range(1, n + 1):
            if speech[no - 1]:
                if count and no - last > 11:
                    expected.append((len(expected) + 1, first * 20, first, last + 10, count))
                    count = 0
                first = first if count else no
                last, count = no, count + 1
        if count:
            expected.append((len(expected) + 1, first * 20, first, min(last + 10, n), count))
        coming = [(i + 1, int(s)) for i, s in enumerate(speech) if i not in lost] + ([(n, -1)] if by_mark else [])
        rng.shuffle(coming)
        state, out, at = None, [], 0
        while at < len(coming):
            size = rng.randint(1, 20)
            line = voiced.Line(state, 20, 10)
            out += line.add(np.array([c[0] for c in coming[at : at + size]]), np.array([c[1] for c in coming[at : at + size]]))
            state, at = line.state(), at + size
        line = voiced.Line(state, 20, 10)
        out += line.close()
        assert [tuple(map(int, x)) for x in out] == expected
        assert voiced.Line(line.state(), 20, 10).add(np.array([1]), np.array([1])) == []


def document(name, text, when="2023-07-01T12:00:00Z"):
    return {"segments": [{"text": text, "start": 0.0, "end": 1.0}], "filename": name, "descriptor": "d", "utteranceTime": when, "language": "en"}


def test_ingest_killed_between_output_and_status(spark, tmp_path):
    """A batch that dies after its rows are written is run again: each row is there once, and the states are right."""
    inbox = tmp_path / "in" / "2023"
    inbox.mkdir(parents=True)
    for i in range(6):
        (inbox / f"{i}.json").write_text(json.dumps([document(f"{i}.json", f"word {i}"), document(f"{i}x.json", "Thank you.")]))
    (inbox / "bad.json").write_text('[{"segments": [{"text": "a"')
    (inbox / "empty.json").write_text("[]")
    args = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def die(batch):
        if batch == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.ingest(*args, files_per_batch=3, between=die)
    states = lambda: Counter(r["state"] for r in ingest.status(*args[:3]).collect())
    assert states()["in progress"] == 3
    assert states()["waiting"] >= 1
    assert ingest.ingested(spark, args[2]).count() <= 3
    for _ in range(2):
        ingest.ingest(*args, files_per_batch=3)
    told = {r["file"].rsplit("/", 1)[1]: r for r in ingest.status(*args[:3]).collect()}
    assert {k: (r["state"], r["n_rows"]) for k, r in told.items() if k != "empty.json"} == {f"{i}.json": ("done", 2) for i in range(6)} | {"bad.json": ("skipped", 0)}
    assert "not a document" in told["bad.json"]["reason"]
    assert Counter(r["text"] for r in ingest.ingested(spark, args[2]).collect()) == Counter(f"word {i}" for i in range(6))
    (inbox / "later.json").write_text(json.dumps(document("later.json", "more")))
    assert states()["waiting"] >= 1
    ingest.ingest(*args)
    assert ingest.ingested(spark, args[2]).where("text = 'more'").count() == 1


def test_playback_of_a_stream_and_of_a_table(spark, tmp_path):
    """The clock's moments as a stream give what a plain search gives, across hours and days without items."""
    rng = random.Random(8)
    said = sorted((rng.randint(0, 3 * 86400), i) for i in range(60)) + [(None, 99)]
    sets = [(0, "a"), (90_000, "b"), (90_000, "c"), (200_000, "d")]
    moments = [(i, rng.randint(-3000, 3 * 86400 + 3000)) for i in range(150)] + [(900, None), (901, 45_000), (902, 45_000), (903, said[5][0])]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) + 1_700_000_000))
    items = at(spark.createDataFrame(said, "t long, n long"), "t").withColumn("at", F.lit("clash"))
    elements = at(spark.createDataFrame(sets, "epoch long, line string"), "epoch")
    ticks = at(spark.createDataFrame(moments, "id long, at long"), "at").withColumn("hour_of", F.lit("clash"))
    hours = playback.hours_between(spark, "2023-11-14 20:00:00", "2023-11-18 00:00:00")
    sources = {"latest_of": {"said": (items.drop("at"), "t")}, "nearest_to": {"elements": (elements, "epoch")}}
    ticks.write.parquet(str(tmp_path / "in"))
    stream = playback.playing(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), hours, **sources)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    expected = Counter()
    for i, m in moments:
        before = [x for x in said if m is not None and x[0] is not None and x[0] <= m]
        near = min(((abs(e - m), e, s) for e, s in sets), default=None) if m is not None else None
        expected[i, max(before)[1] if before else None, near[2] if near else None] += 1
    for df in (spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), playback.playing(ticks, hours, **sources)):
        assert df.columns == [*ticks.columns, "said", "elements"]
        assert Counter((r["id"], r["said"] and r["said"]["n"], r["elements"] and r["elements"]["line"]) for r in df.collect()) == expected
    shown = spark.createDataFrame([("00:00:05.250",), ("25:00:00",), (None,)], "clock string")
    assert [str(r["at"]) for r in playback.on_day(shown, "2024-01-01").collect()] == ["2024-01-01 00:00:05.250000", "2024-01-02 01:00:00", "None"]


def test_ingest_batches_by_bytes(spark, tmp_path):
    """Batches follow the bytes of an inbox and not its number of files: 60 small files, one to a folder, are two batches or one, and all are taken."""
    texts = [json.dumps([document(f"{i}.json", f"word {i}")]) for i in range(60)]
    size = sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, value string")
    files.write_each(docs, str(tmp_path / "in"), "k")
    for n, part in ((size * 2 // 3, 2), (size * 2, 1)):
        out = str(tmp_path / f"out{part}")
        ingest.ingest(spark, str(tmp_path / "in"), out, str(tmp_path / f"state{part}"), bytes_per_batch=n)
        told = ingest.status(spark, str(tmp_path / "in"), out).collect()
        assert Counter(r["state"] for r in told) == {"done": 60}
        assert len({r["batch"] for r in told}) == part
        assert sorted(r["text"] for r in ingest.ingested(spark, out).collect()) == sorted(f"word {i}" for i in range(60))


def test_dense_hours_are_cut(spark):
    """However many items an hour has, a row that a moment meets has few; items of one moment are one."""
    items = spark.range(4000).selectExpr("timestamp_micros(1699999200000000 + id * 1800000) AS t", "id AS n")
    items = items.unionByName(items.selectExpr("t", "n + 10000 AS n"))
    hours = playback.hours_between(spark, "2023-11-14 21:00:00", "2023-11-15 02:00:00")
    plan, rows = playback.by_slot(items.where("n < 10000"), "t", hours)
    assert rows.selectExpr("max(size(items))").first()[0] <= 2 * playback.EACH
    assert plan.count() == 6
    ticks = spark.range(300).selectExpr("id", "timestamp_micros(1699999200000000 + id * 25000003) AS at")
    got = playback.playing(ticks, hours, latest_of={"last": (items, "t")}, nearest_to={"near": (items, "t")}).collect()
    assert len(got) == 300
    for r in got:
        at = r["id"] * 25_000_003
        assert r["last"]["n"] == 10_000 + min(3999, at // 1_800_000)
        assert r["near"]["n"] == min(range(4000), key=lambda n: abs(n * 1_800_000 - at))


def test_streamed_sessions_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """No task writes half of the frames."""
    from dayline.plans import streams
    from dayline.plans.registry import Tables

    monkeypatch.setattr(streams.files, "scratch", lambda spark, name: str(tmp_path / name))
    spark.range(2000).selectExpr("id AS event_id", "id % 40 AS user_id", "IF(id % 3 = 0, 'view', 'click') AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert streams.streamed_sessions(Tables(spark, str(tmp_path))).count() >= 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(list((tmp_path / "frames" / "in").glob("*.parquet"))) > 2
