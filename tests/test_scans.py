"""Joins over a segment tree, and scans of hot keys in slices, against plain computations; null keys and times, ties, repeated rows, empty tables and clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline.operators import joins, scans, sequences

def clash(*but):
    """Columns of names that the operators use on the way."""
    return {c: F.lit("x") for c in ("bucket", "asked", "part", "made", "own", "_at", "at_", "length", "closing", "known") if c not in but}


def stamp(c):
    return F.timestamp_micros(F.col(c)).alias(c)


def spans(rng, n, high):
    out = []
    for i in range(n):
        a = rng.randint(-high // 4, high)
        out.append((i, None if i % 17 == 0 else a, None if i % 13 == 0 else a + rng.choice([-3, 0, 1, 5, high // 50, high])))
    return out


def covers(points, intervals):
    return [(p, i) for p in points for i in intervals if p[1] is not None and i[2] is not None and (i[1] is None or i[1] <= p[1]) and i[2] >= p[1]]


@pytest.mark.parametrize("high", [1, 900, 10**15])
def test_covering(spark, high):
    rng = random.Random(high)
    points = [(i, rng.randint(0, high)) for i in range(80)] + [(5, None), (6, 0), (6, 0), (7, high)]
    intervals = [*spans(rng, 120, high), (900, -(10**15), 2 * 10**15), (900, -(10**15), 2 * 10**15), (901, None, None), (902, None, 0)]
    left = spark.createDataFrame(points, "p long, at long").select("p", stamp("at")).withColumns(clash())
    right = spark.createDataFrame(intervals, "i long, start long, end long").select("i", stamp("start"), stamp("end")).withColumns({"dealt": F.lit(1), "node": F.lit(2), "kept": F.lit(3)})
    expected = covers(points, intervals)
    got = joins.covering(left, right, "at", "start", "end")
    assert got.columns == left.columns + right.columns
    assert Counter((r["p"], r["i"]) for r in got.collect()) == Counter((p[0], i[0]) for p, i in expected)
    first = joins.first_covering(left.withColumns({"time": F.lit(1), "node_": F.lit(1)}).drop("node"), right.drop("node"), "at", "start", "end", "i")
    least = {}
    for p, i in expected:
        least[p] = min(least.get(p, i[0]), i[0])
    assert Counter((r["p"], r["i"]) for r in first.collect()) == Counter((p[0], least[p]) for p in points if p in least)
    for f in (lambda a, b: joins.covering(a, b, "at", "start", "end"), lambda a, b: joins.first_covering(a, b.drop("node", "kept"), "at", "start", "end", "i")):
        assert f(left.limit(0), right).count() == f(left, right.limit(0)).count() == 0


def test_days_before_1970(spark):
    points = spark.sql("SELECT DATE'1965-03-01' AS date UNION ALL SELECT DATE'1965-03-02' UNION ALL SELECT NULL")
    stays = spark.sql("SELECT 'a' AS name, CAST(NULL AS TIMESTAMP) AS arrivalDate, TIMESTAMP'1965-03-01 00:00:00' AS departureDate UNION ALL SELECT 'b', TIMESTAMP'1965-03-01 00:00:01', TIMESTAMP'1965-03-01 23:00:00' UNION ALL SELECT 'c', TIMESTAMP'1965-03-01 00:00:01', TIMESTAMP'1965-03-02 00:00:00'")
    assert sorted((str(r["date"]), r["name"]) for r in joins.onboard(points, stays).collect()) == [("1965-03-01", "a"), ("1965-03-02", "c")]


def test_nodes_of_many_intervals(spark):
    """An interval over all time is a few nodes; 10^5 intervals of one day meet the day's points without a pair, each time asks one node a level."""
    day = 86_400_000_000
    points = spark.range(5000).selectExpr("id", f"timestamp_micros({3 * day} + id * 17000000) AS at")
    narrow = spark.range(100_000).selectExpr("id + 10 AS n", f"timestamp_micros({3 * day} + id * 800000) AS start", f"timestamp_micros({3 * day} + id * 800000 + 4000000000) AS end")
    every = narrow.unionByName(spark.sql("SELECT 200000L AS n, CAST(NULL AS TIMESTAMP) AS start, TIMESTAMP'2100-01-01' AS end"))
    tree = joins._Tree(points, "at")
    assert every.where("n = 200000").select(F.size(tree.of_intervals("start", "end"))).first()[0] <= 6 * tree.levels
    assert every.select(F.max(F.size(tree.of_intervals("start", "end")))).first()[0] <= 6 * tree.levels
    got = joins.first_covering(points, every, "at", "start", "end", "n")
    wide = got.select("id", "n").collect()
    assert len(wide) == 5000
    for r in wide:
        at = r["id"] * 17_000_000
        k = max(0, -(-(at - 4_000_000_000) // 800_000))
        assert r["n"] == (k + 10 if k < 100_000 and k * 800_000 <= at else 200_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


EVENTS = [(k, t, n) for n, (k, t) in enumerate([(k, (n * 37) % 400) for n in range(900) for k in ([1] * (n % 3 > 0) + [2] * (n % 50 == 0) + [None] * (n % 90 == 0))])] + [(3, None, 5000), (1, None, 5001), (1, 50, 5002)]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "k long, t long, n long").withColumn("v", F.when(F.col("n") % 11 == 0, F.col("n"))).withColumns(clash())
    return df.repartition(4)


def keyed(rows):
    out = {}
    for k, t, n in rows:
        out.setdefault(k, []).append((t is not None, t or 0, n))
    return {k: [(t if given else None, n) for given, t, n in sorted(x)] for k, x in out.items()}


@pytest.mark.parametrize("most", [scans.MOST, 40])
def test_carried_sessions_and_pairs(spark, events, most):
    """Whole keys and keys in slices of 40 rows give what one pass gives."""
    carried, sessions, pairs = Counter(), Counter(), Counter()
    for k, rows in keyed(EVENTS).items():
        last, session, before, opened = None, 0, None, None
        for at, (t, n) in enumerate(rows):
            last = n if n % 11 == 0 else last
            carried[k, n, last] += 1
            session += at == 0 or before is None or t is None or t - before > 3
            sessions[k, n, session] += 1
            before = t
            if n % 5 == 0:
                if opened is not None:
                    pairs[k, n, opened] += 1
                opened = None
            if n % 7 == 0:
                opened = n
    got = sequences.carried(events, ["k"], ["t", "n"], "v", "last", most=most)
    assert got.columns == [*events.columns, "last"]
    assert Counter((r["k"], r["n"], r["last"]) for r in got.collect()) == carried
    got = sequences.gap_sessions(events, ["k"], F.col("t"), ["t", "n"], 3, most=most)
    assert got.columns == [*events.columns, "session"]
    assert Counter((r["k"], r["n"], r["session"]) for r in got.collect()) == sessions
    got = sequences.pair_rows(events, ["k"], ["t", "n"], F.col("n") % 7 == 0, F.col("n") % 5 == 0, ["n"], most=most)
    assert got.columns == [*events.columns, "open_n"]
    assert Counter((r["k"], r["n"], r["open_n"]) for r in got.collect()) == pairs
    for f in (lambda d: sequences.carried(d, ["k"], ["t"], "v", "last"), lambda d: sequences.gap_sessions(d, ["k"], F.col("t"), ["t"], 3), lambda d: sequences.chunked(d, ["k"], ["t"], "bucket")):
        assert f(events.limit(0)).count() == 0


@pytest.mark.parametrize("most", [scans.MOST, 60])
def test_nearest_of_null_keys_and_times(spark, events, most):
    left = [(1, None, 3), (2, 1, None), (3, 1, 10), (4, 9, 10), (5, None, None), (6, 1, 10), (6, 1, 10)] + [(100 + i, 1, i * 3) for i in range(150)]
    lhs = spark.createDataFrame(left, "id long, k long, at long").withColumns({"k0": F.lit(1), "t": F.lit(2), "r": F.lit(3), "l": F.lit(4), "side": F.lit(5), "x": F.lit(6), "_l": F.lit(7)})
    right = events.select("k", F.col("t").alias("epoch"), F.col("n").alias("near"))
    lhs = lhs.withColumn("at", F.timestamp_micros("at"))
    right = right.withColumn("epoch", F.timestamp_micros("epoch"))
    expected = Counter()
    for i, k, t in left:
        found = [(abs(e - t), e, n) for q, e, n in EVENTS if q == k and e is not None] if k is not None and t is not None else []
        expected[i, min(found)[2] if found else None] += 1
    got = joins.nearest(lhs, right, by=["k"], at="at", epoch="epoch", order=["near"], payload=["near"], most=most)
    assert got.columns == [*lhs.columns, "near"]
    assert Counter((r["id"], r["near"]) for r in got.collect()) == expected


def test_a_hot_key_spreads(spark):
    """One key with 2 * 10^5 rows on each side is scanned by slices of 10,000, and found right."""
    n = 200_000
    left = spark.range(n).selectExpr("1 AS k", "timestamp_seconds(id * 3) AS t", "id AS row")
    right = spark.range(n).selectExpr("1 AS k", "timestamp_seconds(id * 3 + 1) AS epoch", "id AS element")
    found = joins.nearest(left, right, by=["k"], at="t", epoch="epoch", order=["element"], payload=["element"], most=10_000)
    assert found.where("row > 0 AND element <> row").count() == 0
    s = scans.Slices(right, ["k"], ["epoch"], 10_000)
    sizes = [r["count"] for r in s.rows.groupBy(s.part).count().collect()]
    assert len(sizes) >= 15
    assert max(sizes) < 30_000


def plain_chunks(lengths, most):
    out, chunk, size = [], 0, 0
    for x in lengths:
        full = size + x > most
        chunk, size = chunk + full, x + (0 if full else size)
        out.append(chunk)
    return out


def test_transfer_tables():
    rng = random.Random(4)
    for _ in range(200):
        most = rng.choice([0, 1, 7, 30])
        lengths = [rng.choice([0, 0, 1, 2, 5, 9, 40]) for _ in range(rng.randint(0, 30))]
        table = sequences.Transfer(np.array(lengths, dtype=np.int64), most)
        assert len(table.least) <= most + 2
        for before in range(2 * most + 50):
            size, chunks = before, 0
            for x in lengths:
                full = size + x > most
                chunks, size = chunks + full, x + (0 if full else size)
            assert table(before) == (chunks, size)


@pytest.mark.parametrize("first", [5, 5000])
def test_chunks_of_a_long_conversation(spark, first):
    """A conversation of 10^5 turns in slices, also with an over-long first turn, equals one pass; others stay whole."""
    rng = np.random.default_rng(first)
    sizes = [first, *rng.choice([0, 3, 90, 400, 1200], 100_000, p=[0.1, 0.3, 0.4, 0.19, 0.01]).tolist()]
    rows = [(1, i, n) for i, n in enumerate(sizes)] + [(2, 0, 600), (2, 1, 401), (None, 0, 1001), (None, 1, 3)]
    df = spark.createDataFrame(rows, "k long, pos long, n long").select("k", "pos", F.when(F.col("n") > 0, F.repeat(F.lit("x"), F.col("n").cast("int"))).alias("text"), F.lit("c").alias("part"), F.lit(1).alias("length"), F.lit(2).alias("opened"))
    got = sequences.chunked(df, ["k"], ["pos"], "text", most_rows=8000)
    assert got.columns == [*df.columns, "chunk"]
    chunks = {(r["k"], r["pos"]): r["chunk"] for r in got.select("k", "pos", "chunk").collect()}
    assert [chunks[1, i] for i in range(len(sizes))] == plain_chunks(sizes, 1000)
    assert [chunks[2, 0], chunks[2, 1], chunks[None, 0], chunks[None, 1]] == [0, 1, 1, 2]
