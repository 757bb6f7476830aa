"""Sessions, chunks, pairs and tracks."""

from pyspark.sql import functions as F

from dayline.operators import aggregates, sequences


def test_voiced_sessions(spark):
    def frames(file, speech, n):
        return [(file, i, i in speech) for i in range(1, n + 1)]

    rows = frames("ten", {1, 12}, 30) + frames("eleven", {1, 13}, 30) + frames("end", {29, 30}, 30) + frames("none", set(), 5)
    got = sequences.voiced_sessions(spark.createDataFrame(rows, "file string, frame_no int, is_speech boolean"))
    assert sorted((r["file"], r["start_ms"], r["end_frame"]) for r in got.collect()) == [("eleven", 20, 11), ("eleven", 260, 23), ("end", 580, 30), ("ten", 20, 22)]


def test_greedy_chunks(spark):
    def chunks(*sizes):
        df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "k int, pos int, text string")
        return [r["chunk"] for r in sequences.chunked(df, ["k"], ["pos"], "text").orderBy("pos").collect()]

    assert chunks(600, 400) == [0, 0]
    assert chunks(600, 401) == [0, 1]
    assert chunks(1001, 10, 5) == [1, 2, 2]


def test_pair_rows(spark):
    rows = [(1, "d"), (2, "x"), (3, "x"), (4, "d"), (5, "d"), (6, "x")]
    df = spark.createDataFrame(rows, "pos int, kind string").withColumn("k", F.lit(1))
    got = sequences.pair_rows(df, ["k"], ["pos"], F.col("kind") == "d", F.col("kind") == "x", ["pos"])
    assert sorted((r["pos"], r["open_pos"]) for r in got.collect()) == [(2, 1), (6, 5)]


def test_collisions(spark):
    df = spark.createDataFrame([(1, "a.wav"), (2, "a.wav"), (3, "b.wav"), (4, "a.wav")], "pos int, name string")
    assert [r["target"] for r in sequences.collision_names(df, "name", ["pos"]).orderBy("pos").collect()] == ["a.wav", "a_1.wav", "b.wav", "a_2.wav"]


def test_split_track(spark):
    def parts(*lng):
        df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(lng)], "k int, i int, lng double")
        return [r["part"] for r in sequences.split_track(df, ["k"]).orderBy("i").collect()]

    assert parts(160, 170, 180, -170, -160, 100) == [1, 1, 1, 2, 2, 2]
    assert parts(179, -179, -177, -175) == [1, 1, 2, 2]  # a wrap in the first step shows at the next
    assert parts(-3, -1, 1, 3) == [1, 1, 1, 1]


def test_pivot_and_first(spark):
    rows = [("a", "large", "u1", 1), ("a", "small", "s1", 2), ("a", "large", "u2", 3), ("b", "small", "s2", 4)]
    df = spark.createDataFrame(rows, "id string, size string, url string, pos int")
    got = {r["id"]: (r["large"], r["small"], r["url"]) for r in aggregates.pivot_last(df, ["id"], "size", ["large", "small"], "url", ["pos"], ["url"]).collect()}
    assert got == {"a": ("u2", "s1", "u1"), "b": (None, "s2", "s2")}
    people = spark.createDataFrame([("x", None, "", 1), ("x", "d", "f", 2), ("x", "e", "g", 3)], "name string, a string, b string, pos int")
    assert tuple(aggregates.first_given(people, ["name"], ["a", "b"], ["pos"]).first()) == ("x", "d", "f")


def test_aggregates_of_nulls_and_ties(spark):
    rows = [(None, 1, "a", 5), (None, 2, None, 6), ("k", None, "n", 1), ("k", 1, "", 2), ("k", 1, "", 2), ("k", 3, "z", 3)]
    df = spark.createDataFrame(rows, "k string, pos int, text string, o0 int")
    got = {r["k"]: r for r in aggregates.rolled_text(df, ["k"], "text", ["pos", "o0"], "+", n=F.count(F.lit(1))).collect()}
    assert {k: (r["text"], r["n"]) for k, r in got.items()} == {None: ("a", 2), "k": ("n+++z", 4)}
    chunks = aggregates.roll_up_chunks(df, ["k"], "text", "o0", ["pos", "o0"]).collect()
    assert {r["k"]: (r["summary"], r["start_time"], r["end_time"]) for r in chunks} == {None: ("a", 5, 6), "k": ("n. . . z", 1, 3)}
    for f in (lambda d: aggregates.rolled_text(d, ["k"], "text", ["pos"]), lambda d: aggregates.pivot_last(d, ["k"], "text", ["a"], "o0", ["pos"]), lambda d: aggregates.first_given(d, ["k"], ["text"], ["pos"])):
        assert f(df.limit(0)).count() == 0
