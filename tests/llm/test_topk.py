"""Exact top-k against brute force, ties and hot vectors included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dayline.llm import topk


def brute(rows, every, k):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in v if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dim", "slices", "k"), [(8, 2, 5), (7, 3, 3), (4, 1, 2)])
def test_top_k(spark, dim, slices, k):
    rng = random.Random(dim)
    hot = [rng.gauss(0, 1) for _ in range(dim)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(dim)]) for i in range(150)]
    rows += [(200, [0.0] * dim), (205, [0.0] * dim), (206, None), (210, []), (211, [float("nan")] * dim), (215, [None] + [1.0] * (dim - 1)), (220, [float("inf")] * dim), (None, hot), (225, hot[: dim - 1]), (230, [1e-9] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    found = topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 5 == 0, k=k, slices=slices, query_block=7, block=20)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, k)


def test_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    run = lambda d: [tuple(r) for r in topk.top_k(topk.whole_numbers(d), F.col("vec_id") % 5 == 0, k=5).collect()]
    assert run(df) == [(0, 1, 1, 256 * 512)]
    assert run(df.limit(0)) == []


def test_large_numbers(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**22, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(topk.whole_numbers(df, scale=1.0), F.col("vec_id") == 0, k=1).collect()]
    assert got == [(0, 1, 2, 2**52 + 4)]


def test_repeated_ids(spark):
    """As the query's SQL has it: rows of one query id share a list, repeated candidates count, own rows never do."""
    rng = random.Random(21)
    same = [3.0, 3.0]
    rows = [(0, same)] * 8 + [(7, same), (1, same)] + [(7, same)] * 2  # own rows fill a class
    rows += [(5, [float(i), 9.0]) for i in range(12)]  # one id, many vectors
    rows += [(10, [2.0, 2.0]), (10, [1.0, 1.0]), (11, [0.0, 4.0]), (15, [4.0, 0.0]), (15, same)]
    rows += [(i, [float(rng.randint(-2, 4)), float(rng.randint(-2, 4))]) for i in range(20, 50)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, block in ((5, 4), (1, 3)):
        merged = {}
        for q, a in rows:
            if q % 5 == 0:
                merged.setdefault(q, []).extend((-int(256 * 256 * (a[0] * b[0] + a[1] * b[1])), i) for i, b in rows if i != q)
        expected = sorted((q, n + 1, i, -s) for q, x in merged.items() for n, (s, i) in enumerate(sorted(x)[:k]))
        found = topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 5 == 0, k=k, query_block=3, block=block)
        assert sorted(tuple(r) for r in found.collect()) == expected
