"""Interval and as-of joins against their fixtures."""

import pytest
from pyspark.sql import functions as F

from dayline import schemas
from dayline.functions import times
from dayline.operators import joins

STAYS = [
    *[(f"g1{i}", "2000-11-02 09:21:00", "2001-03-21 07:33:00") for i in range(3)],
    *[(f"g2{i}", "2001-03-08 11:42:00", "2001-08-22 19:24:00") for i in range(3)],
    *[(f"g3{i}", "2001-08-10 21:10:00", "2001-12-17 17:56:00") for i in range(3)],
    ("g40", "2001-12-05 22:19:00", "2002-06-19 09:57:00"),
]


@pytest.fixture(scope="module")
def crew(spark):
    rows = [*STAYS, ("open", "2000-11-02 09:21:00", None), ("early", None, "2001-01-01 00:00:00")]
    return spark.createDataFrame(rows, "name string, a string, d string").select("name", F.to_timestamp("a").alias("arrivalDate"), F.to_timestamp("d").alias("departureDate"))


@pytest.mark.parametrize(
    ("day", "names"),
    [
        ("2000-12-01", ["early", "g10", "g11", "g12"]),
        ("2001-04-15", ["g20", "g21", "g22"]),
        ("2001-12-10", ["g30", "g31", "g32", "g40"]),
        ("1999-01-01", ["early"]),
        ("2000-11-02", ["early"]),  # the query is at midnight, the arrival later
        ("2001-03-21", ["g10", "g11", "g12", "g20", "g21", "g22"]),  # departure later that day
        ("2001-01-01", ["early", "g10", "g11", "g12"]),  # inclusive at midnight
    ],
)
def test_onboard(spark, crew, day, names):
    dates = spark.createDataFrame([(day,)], "date string").select(F.to_date("date").alias("date"))
    assert sorted(r["name"] for r in joins.onboard(dates, crew).collect()) == names


def test_no_dates(spark, crew):
    assert joins.onboard(spark.createDataFrame([], "date date"), crew).count() == 0


def test_checked_day(spark):
    df = spark.createDataFrame([("2001-13-45",), ("2001-04-15",)], "d string")
    assert [r[0] is None for r in df.select(times.checked_day(F.col("d"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a date"):
        spark.createDataFrame([("2001-4-15",)], "d string").select(times.checked_day(F.col("d"))).collect()


@pytest.mark.parametrize(
    ("t", "epochs", "expected"),
    [
        ("12:00:00", [], None),
        ("12:00:00", [("11:00:00", 0), ("13:00:00", 1)], 0),
        ("10:00:00", [("11:00:00", 0), ("13:00:00", 1)], 0),
        ("20:00:00", [("11:00:00", 0), ("13:00:00", 1)], 1),
        ("12:50:00", [("13:00:00", 0), ("11:00:00", 1)], 0),
        ("11:00:00", [("11:00:00", 3), ("11:00:00", 2)], 2),
    ],
)
def test_nearest(spark, t, epochs, expected):
    at = lambda x: F.to_timestamp(F.concat(F.lit("2023-01-01 "), x))
    left = spark.createDataFrame([(1, t)], "k int, t string").select("k", at(F.col("t")).alias("t"))
    right = spark.createDataFrame([(1, e, p) for e, p in epochs], "k int, e string, pos int").select("k", at(F.col("e")).alias("epoch"), "pos")
    rows = joins.nearest(left, right, by=["k"], at="t", epoch="epoch", order=["pos"], payload=["pos"]).collect()
    assert [r["pos"] for r in rows] == [expected]


def test_lookup_todo_copy(spark):
    rows = spark.createDataFrame([("en",), ("xx",)], "lang string")
    names = spark.createDataFrame([("en", "English")], "lang string, language string")
    assert {r["lang"]: r["language"] for r in joins.lookup(rows, names, "lang", "language").collect()} == {"en": "English", "xx": "xx"}
    assert [r[0] for r in joins.todo(rows, "lang", names.select("lang")).collect()] == ["xx"]
    assert [r[0] for r in joins.copy_plan(rows, rows, names, "lang").collect()] == ["xx"]


def test_schemas_parse(spark):
    from pyspark.sql.types import StructType

    for name in [n for n in vars(schemas) if n.isupper() and " " in getattr(schemas, n) and not getattr(schemas, n).startswith("struct")]:
        assert StructType.fromDDL(getattr(schemas, name)).fields


def test_nearest_of_a_hot_key(spark):
    """Ten times the rows of one key take nothing like a hundred times as long."""
    import time

    def took(n):
        left = spark.range(n).selectExpr("1 AS k", "timestamp_seconds(id * 3) AS t", "id AS row")
        right = spark.range(n).selectExpr("1 AS k", "timestamp_seconds(id * 3 + 1) AS epoch", "id AS element")
        began = time.perf_counter()
        found = joins.nearest(left, right, by=["k"], at="t", epoch="epoch", order=["element"], payload=["element"])
        assert found.where("row > 0 AND element <> row").count() == 0
        return time.perf_counter() - began

    took(100)
    assert took(50_000) < 30


def test_first_covering(spark):
    points = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-20"), ("c", "2023-01-01")], "k string, t string").withColumn("at", F.to_timestamp("t"))
    spans = spark.createDataFrame([(2, "2024-01-01", "2024-01-10"), (1, "2024-01-05", "2024-02-01"), (3, None, "2024-01-05"), (4, "2024-01-01", None)], "n int, start string, end string").withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    found = joins.first_covering(points, spans, "at", "start", "end", "n")
    assert sorted((r["k"], r["n"], r["t"]) for r in found.collect()) == [("a", 1, "2024-01-05"), ("b", 1, "2024-01-20"), ("c", 3, "2023-01-01")]
    assert joins.first_covering(points.limit(0), spans, "at", "start", "end", "n").count() == 0


def rows_made(df, kind):
    """The rows that all operators of a kind gave out when df was run, by Spark's own counts."""

    def below(plan):
        yield plan
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from below(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from below(plan.plan())
        for n in range(plan.children().size()):
            yield from below(plan.children().apply(n))

    df.collect()
    return sum(p.metrics().apply("numOutputRows").value() for p in below(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == kind)


def test_first_covering_deals_spans_not_intervals(spark):
    """20,000 intervals of 40 spans: nodes are made for the spans and for the few intervals that are some day's first."""
    points = spark.range(12).selectExpr("date_add(DATE'2024-01-01', CAST(30 * id AS INT)) AS at")
    spans = spark.range(20_000).selectExpr("id * 7919 % 20000 AS n", "timestamp_seconds(1704067200 + 86400 * 9 * (id % 40)) AS start", "timestamp_seconds(1704067200 + 86400 * (9 * (id % 40) + 50)) AS end")
    found = joins.first_covering(points, spans, "at", "start", "end", "n")
    made = rows_made(found, "GenerateExec")
    assert 0 < made < 2_000
    days = [(r["at"], r["n"]) for r in found.collect()]
    assert len(days) == 12 and sorted(days) == sorted((r["at"], r["n"]) for r in joins.covering(points, spans, "at", "start", "end").groupBy("at").agg(F.min("n").alias("n")).collect())


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_first_covering_by_force(spark, kind):
    """Orders that tie, are null, or are no numbers; times to the microsecond; columns named as those made on the way."""
    import random

    rng = random.Random(5)
    at = lambda n: None if n is None else f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}.{n % 7:06d}"
    value = {"int": int, "string": lambda n: f"s{n}", "double": lambda n: float("nan") if n == 3 else n / 2}[kind]
    points = [(i, rng.choice([None, *range(0, 900, 9)])) for i in range(150)]
    ends = [sorted(rng.sample(range(1000), 2)) for _ in range(60)]
    spans = [(None if i == 7 else value(rng.randrange(1, 5)), None if i == 9 else a, None if i in (3, 4) else a + (b - a) // 4, i % 50, i) for i, (a, b) in enumerate(ends)]
    left = spark.createDataFrame([(i, at(t)) for i, t in points], "time int, node string").select("time", F.to_timestamp("node").alias("node"))
    right = spark.createDataFrame([(n, at(a), at(b), x, i) for n, a, b, x, i in spans], f"least {kind}, first string, last string, kept int, own int")
    right = right.withColumns({c: F.to_timestamp(c) for c in ("first", "last")})

    def key(s):
        low = lambda v: (v is not None, 0 if v is None else v)
        n = (0, 0) if s[0] is None else (2, 0) if s[0] != s[0] else (1, s[0])
        return n, low(at(s[1])), low(at(s[2])), s[3], s[4]

    wanted = {}
    for i, t in points:
        over = [s for s in spans if t is not None and s[2] is not None and at(s[2]) >= at(t) and (s[1] is None or at(s[1]) <= at(t))]
        if over:
            wanted[i] = min(over, key=key)[4]
    assert len(wanted) > 50
    assert {r["time"]: r["own"] for r in joins.first_covering(left, right, "node", "first", "last", "least").collect()} == wanted
