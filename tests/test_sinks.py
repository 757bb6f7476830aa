"""Documents under free names, failed writes, and members of archives."""

import io
import json
import random
import zipfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dayline.operators import scans, sequences
from dayline.sources import documents, files, zips


def plain_names(asked, taken=()):
    """First askers have their names, then each other counts on from 1 to the first name that nobody has."""
    had, out, later = set(asked) | set(taken), [], []
    seen = set(taken)
    for n, name in enumerate(asked):
        if name in seen:
            later.append(n)
        else:
            seen.add(name)
        out.append(name)
    for n in later:
        stem, dot, suffix = asked[n].rpartition(".")
        k = 1
        while (new := f"{stem}_{k}{dot}{suffix}") in had:
            k += 1
        had.add(new)
        out[n] = new
    return out


@pytest.mark.parametrize("most", [scans.MOST, 30])
def test_free_names(spark, most):
    rng = random.Random(2)
    asked = [f"{rng.choice('ab')}{rng.choice(['', '', '', '_1', '_2', '_7', '_1_1', '_01', '_x'])}.wav" for _ in range(400)]
    taken = ["a_3.wav", "b.wav", "b_1.wav", "a_2_4.wav"]
    df = spark.createDataFrame(list(enumerate(asked)), "n long, name string").withColumns({"pos": F.lit("p"), "kind": F.lit(1), "chosen": F.lit(2), "target": F.lit("old")}).repartition(3)
    for known in ((), taken):
        held = spark.createDataFrame([(x,) for x in known], "name string") if known else None
        got = sequences.collision_names(df, "name", ["n"], taken=held, most=most)
        assert got.columns == df.columns
        names = [r["target"] for r in got.orderBy("n").collect()]
        assert names == plain_names(asked, known)
        assert len(set(names)) == len(names)


def test_three_names(spark):
    def names(*asked):
        return [r["target"] for r in sequences.collision_names(spark.createDataFrame(list(enumerate(asked)), "n int, name string"), "name", ["n"]).orderBy("n").collect()]

    assert names("a.wav", "a.wav", "a_1.wav") == ["a.wav", "a_2.wav", "a_1.wav"]
    assert names("x", "x", ".y", ".y", "z.a.b", "z.a.b", None) == ["x", "x_1", ".y", ".y_1", "z.a.b", "z.a_1.b", None]
    assert names() == []


def rows_of(spark, n):
    df = spark.range(n).selectExpr("id", "concat('f', id % 3, '.json') AS file", "IF(id % 10 = 9, NULL, timestamp_seconds(1700000000 + (id % 4) * 86400)) AS at", "IF(id % 5 = 0, NULL, concat('t', id)) AS text", "'x' AS folder", "'y' AS whole")
    return df.repartition(4)


def test_documents(spark, tmp_path):
    """Each row is one document, in two jobs that add to each other; nulls come back as null."""
    path = str(tmp_path / "docs")
    rows = rows_of(spark, 60)
    documents.write_documents(rows.where("id < 40"), path, name="file", at="at", order=["id"])
    documents.write_documents(rows.where("id >= 40"), "file://" + path, name="file", at="at", order=["id"])
    documents.write_documents(rows.limit(0), path, name="file", at="at", order=["id"])
    found = [(p, json.loads(p.read_text())) for p in Path(path).rglob("*.json")]
    assert sorted(d["id"] for _, d in found) == list(range(60))
    assert all(d["text"] == (None if d["id"] % 5 == 0 else f"t{d['id']}") and d["folder"] == "x" for _, d in found)
    assert {str(p.parent.relative_to(path)) for p, _ in found} == {"0000/00/00", "2023/11/14", "2023/11/15", "2023/11/16", "2023/11/17"}
    assert not (Path(path) / "_temporary").exists()
    assert documents.documents_in(spark, path).count() == 60


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """A task that fails takes back what it moved, and the job what its finished tasks moved; earlier documents stay."""
    path = str(tmp_path / "docs")
    documents.write_documents(rows_of(spark, 5), path, name="file", at="at", order=["id"])
    before = {p.relative_to(path) for p in Path(path).rglob("*") if p.is_file()}
    bad = spark.range(40).selectExpr("'2024/01/01' AS folder", "IF(id = 35, NULL, concat('n', id)) AS name", "'{}' AS value").repartitionByRange(4, "name")
    with pytest.raises(Exception, match="has no place"):
        bad.write.format("day_documents").mode("append").option("path", path).save()
    assert {p.relative_to(path) for p in Path(path).rglob("*") if p.is_file()} == before


def test_an_aborted_job_takes_back_what_no_message_tells(tmp_path):
    """Tasks that were killed after their moves, or go on after the job's end, leave nothing."""
    from pyspark.sql import Row

    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "old").write_text("{}")
    row = lambda name: Row(folder="2024", name=name, value="{}")
    writer = documents.DocumentWriter(str(tmp_path))
    done = writer.write(iter([row("a"), row("b")]))
    writer.write(iter([row("c")]))  # its message is lost
    kept = lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}

    def ends_meanwhile():
        yield row("d")
        writer.abort([done, None])
        assert kept() == {"2024/old"}
        yield row("e")

    with pytest.raises(OSError):
        writer.write(ends_meanwhile())
    with pytest.raises(RuntimeError, match="aborted"):
        writer.write(iter([row("f")]))
    assert kept() == {"2024/old"} and not (tmp_path / "_temporary").exists()


def test_members_spread_over_tasks(spark, tmp_path):
    """One archive of 1,000 members is read by all tasks, member by member; damaged members and archives say so."""
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {f"m{i}.txt": b"" if i == 5 else f"text {i} ".encode() * (i % 50 + 1) for i in range(1000)}
    with zipfile.ZipFile(folder / "one.ZIP", "w") as z:
        for n, (name, text) in enumerate(texts.items()):
            z.writestr(name, text, compress_type=zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED)
        z.writestr("folder/", "")
    (folder / "no.zip").write_bytes(b"this is no archive")
    (folder / "other.txt").write_bytes(b"x")
    raw = bytearray((folder / "one.ZIP").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        i = z.getinfo("m9.txt")
    raw[i.header_offset + 30 + len("m9.txt") + 3] ^= 255
    (folder / "one.ZIP").write_bytes(bytes(raw))
    found = zips.index(spark, str(folder))
    assert found.where("name IS NULL").count() == 1
    got = zips.contents(found.withColumn("extra", F.lit(1)), 8)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    said = {r["name"]: r for r in rows}
    assert {n: bytes(said[n]["content"]) for n in texts if n != "m9.txt"} == {n: t for n, t in texts.items() if n != "m9.txt"}
    assert said["m9.txt"]["content"] is None
    assert said["m9.txt"]["error"]
    assert said[None]["error"]
    assert len(rows) == 1001
    tasks = Counter(r["task"] for r in rows)
    assert len(tasks) == 8
    assert max(tasks.values()) < 250
    assert zips.contents(found.limit(0)).count() == 0


def test_arrays_of_many_keys(spark, tmp_path):
    """Files are moved by tasks below the folders that Spark takes for partitions, whatever is in a key, and what was there goes; their folders are listed, and the files read, by few tasks."""
    path = str(tmp_path / "arrays")
    keys = ["a", "b c", "2024-01-01", "x/y=z", "50%", "q:*?[]{}^'\"#\\", None, "ä"]
    rows = spark.createDataFrame([(k, n) for k in keys for n in (2, 1)], "k string, n long")
    files.write_array(rows.withColumn("k", F.lit("old")), path, "k", ["n"])
    files.write_array(rows, path, "k", ["n"])
    got = files.read_documents(spark, path, "n long, k string").select("k", "n").collect()
    assert Counter(map(tuple, got)) == Counter((k, n) for k in keys for n in (2, 1))
    assert len([p for p in Path(path).rglob("*") if p.is_file()]) == len(keys)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with files.many_folders(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
    assert files.few_tasks(spark.range(0, 1000, 1, 1000)).rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism


def test_archives_grow_in_number(spark):
    """Archives are two, or as many as their bytes need."""
    rows = spark.range(1000).selectExpr("concat('d', id) AS name", "repeat('x', 100) AS text")
    assert zips.dealt(rows, "name", "text").rdd.getNumPartitions() == 2
    assert zips.dealt(rows.limit(0), "name", "text").rdd.getNumPartitions() == 2
    assert zips.dealt(rows, "name", "text", archive_bytes=10_000).rdd.getNumPartitions() == 10
