"""Exact dedup, ranked search and clustering against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline.llm import clusters, exact, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def groups_of(rows):
    held = {}
    for doc, text in rows:
        held.setdefault(bare(text), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = Counter()
    for norm, members in held.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out[m[3], members[0][3], len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def marked(df, **bound):
    return Counter(tuple(r) for r in exact.mark(df, **bound).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.fixture(scope="module")
def copies(corpus):
    """The corpus, copies that differ in white space alone, a third of all rows equal, and one text far beyond any bucket."""
    rng = random.Random(3)
    rows = [*corpus, *[(2000 + i, "a hot text of  many") for i in range(150)], *[(3000 + i, t) for i, t in enumerate(["x y", "x  y", "xy\n", "\tx y", "x y", "X y"])]]
    rows += [(4000 + i, "long " * 30_000 + "\n" * (i % 3)) for i in range(5)] + [(None, ""), (None, None), (None, "x y"), (4100, "x" * 200_000)]
    rng.shuffle(rows)
    return rows


def test_groups(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert marked(df) == groups_of(copies)


def test_buckets_that_do_not_fit(spark, copies, monkeypatch):
    """With too few buckets at first, contents are dealt anew, level after level, with the same groups."""
    levels = []
    kept = exact.stored
    monkeypatch.setattr(exact, "parts_for", lambda n_bytes, part_bytes: 2)
    monkeypatch.setattr(exact, "stored", lambda df, name: levels.append(name) or kept(df, name))
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert marked(df, bucket_bytes=20_000) == groups_of(copies)
    assert len(levels) >= 4


def test_a_bucket_gives_records_back():
    import pyarrow as pa

    contents = [b"aa" * 50, b"bb" * 50, b"aa" * 50, b"cc" * 50, b"aa" * 50]
    rows = [(c, len(c) + exact.ENTRY_BYTES, 1, 10, i, i, i, i) for i, c in enumerate(contents)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), exact.RECORD.values(), strict=True)], names=list(exact.RECORD))
    fits = pa.Table.from_batches(exact._resolve(10_000)([batch]))
    assert Counter(zip(fits["rep"].to_pylist(), fits["group_size"].to_pylist(), fits["keep_id"].to_pylist(), strict=True)) == Counter([(0, 3, 0), (2, 3, 0), (4, 3, 0), (1, 1, 1), (3, 1, 3)])
    back = pa.Table.from_batches(exact._resolve(100)([batch, batch]))
    assert back["group_size"].null_count == len(back) == 10
    assert sum(back["n"].to_pylist()) == 10


def test_equal_hashes_are_compared(monkeypatch):
    """Contents of one hash stay apart, since the table compares them whole."""
    monkeypatch.setattr(exact.xxhash, "xxh3_64_intdigest", lambda content: 7)
    held = exact.Contents()
    words = [str(i).encode() for i in range(3000)]
    assert [held.place(w) for w in [*words, *words]] == [*range(3000), *range(3000)]


def test_keep_one(spark, documents, corpus, empty):
    more = documents.withColumns({"row": F.lit("r"), "rep": F.lit(1), "keep_id": F.lit(2)})
    kept = exact.keep_one(more)
    assert kept.columns == more.columns
    expected = Counter((d, bare(t)) for d, t in corpus)
    got = [(r["doc_id"], bare(r["text"])) for r in kept.collect()]
    assert len(got) == len({x for _, x in expected})
    assert not set(got) - set(expected)
    assert exact.keep_one(empty).count() == exact.mark(empty).count() == 0


def ranked(rows, items, k):
    fold = lambda s: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    docs = [(d, Counter(w), len(w)) for d, t in rows if (w := fold(t))]
    n_docs, n_words = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = Counter()
    for item in {i for i, _ in items}:
        asked = Counter(w for t in {t for i, t in items if i == item} for w in fold(t))
        found = []
        for d, c, n in docs:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out[item, rank, d, -s] += 1
    return out


ITEMS = [(1, None), (2, ""), (3, "aaa nowhere-at-all"), (4, "Ünïcödé Çafé"), (6, "Same SAME same"), (7, "id id at"), (None, "one no id"), (8, "tail0 tail1 tail2")]


@pytest.mark.parametrize(("block_bytes", "group_bytes"), [(lexical.BLOCK_BYTES, lexical.GROUP_BYTES), (200, 600), (600, 10_000)])
def test_search(spark, documents, corpus, block_bytes, group_bytes):
    """One block and many, in one group and several, give what a plain count gives, with an item of several rows, ties and repeated rows."""
    items = [*ITEMS, (5, " ".join(corpus[9][1].split()[:40])), (5, corpus[10][1]), (5, corpus[10][1]), (9, corpus[60][1])]
    df = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "term": F.lit("x")}).repartition(2)
    got = lexical.search(documents.withColumn("n", F.lit(1)), df, k=10, block_bytes=block_bytes, group_bytes=group_bytes)
    expected = ranked(corpus, items, 10)
    assert len(expected) >= 30
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == expected


def test_search_of_nothing(spark, documents, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == lexical.search(documents, items.limit(0)).count() == 0
    assert lexical.search(documents, items.where("item_id < 3")).columns == ["item_id", "rank", "doc_id", "score"]


def test_radix_order():
    rng = np.random.default_rng(1)
    for most in (1, 2**16, 2**20, 2**40):
        key = rng.integers(0, most, 5000).astype(np.uint64)
        assert (lexical.radix_order(key) == np.argsort(key, kind="stable")).all()
    assert len(lexical.radix_order(np.empty(0, np.uint64))) == 0


def test_heaps_keep_the_best():
    """Offered in parts, with many ties, the heaps hold what sorting all would give."""
    rng = np.random.default_rng(2)
    item, score = rng.integers(0, 5, 4000), rng.integers(1, 30, 4000)
    lost, doc = rng.integers(0, 2, 4000), rng.permutation(4000)
    best = lexical.Best(5, 7)
    for at in range(0, 4000, 333):
        s = slice(at, at + 333)
        best.offer(item[s], score[s], lost[s], doc[s])
    got = sorted((i, -s, d is None, d or 0) for i, d, s in best.rows())
    every = sorted(zip(item.tolist(), (-score).tolist(), lost.tolist(), doc.tolist(), strict=True))
    assert [x[:3] for x in got] == [(i, s, bool(x)) for n in range(5) for i, s, x, _ in [e for e in every if e[0] == n][:7]]
    assert [x[3] for x in got if not x[2]] == [d for n in range(5) for _, _, x, d in [e for e in every if e[0] == n][:7] if not x]


def lloyd(vectors, first, rounds):
    v, c = np.array(vectors, dtype=np.int64), np.array(first, dtype=np.int64)
    for n in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if n < rounds:
            c = np.array([v[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return own, d[np.arange(len(v)), own], c


def test_clusters(spark):
    """Against plain rounds: ties, repeated vectors, an empty cluster that stays, and rows that take no part."""
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) + rng.randint(0, 2) * 4 for _ in range(4)]) for i in range(300)]
    rows += [(400 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(120)] + [(7, rows[7][1]), (7, rows[7][1]), (None, [9.0, 9.0, 9.0, 9.0])]
    out = [(500, None), (501, []), (502, [1.0]), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0]), (506, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "upper": F.lit(2)}).repartition(3)
    vectors = clusters.whole_vectors(df, 4, 256.0)
    assert vectors.count() == len(rows)
    whole = [[math.floor(256 * x) for x in e] for _, e in rows]
    for k, rounds in ((6, 5), (1, 2), (2, 0), (500, 1)):
        first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))[:k]
        own, d, c = lloyd(whole, [whole[i] for i in first], rounds)
        got, centroids = clusters.cluster(vectors, F.col("vec_id"), k=k, dim=4, rounds=rounds)
        assert (centroids == c).all()
        assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()) == Counter((rows[i][0], int(own[i]), int(d[i])) for i in range(len(rows)))
        told = clusters.with_inertia(got, centroids).collect()
        assert {r["inertia"] for r in told} == {int(d.sum())}
        assert {(r["cluster"], r["cluster_inertia"], r["centroid_sha256"]) for r in told} == {(j, int(d[own == j].sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in set(own.tolist())}


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    got, centroids = clusters.cluster(clusters.whole_vectors(df, 4, 256.0), F.col("vec_id"), k=3, dim=4, rounds=2)
    assert clusters.with_inertia(got, centroids).count() == 0


def test_bounds_spare_scans():
    """Bounds hold after each move, and most vectors of clear clusters are not scanned again."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-3000, 3000, (20, 16))
    v = (centers[rng.integers(0, 20, 4000)] + rng.integers(-200, 200, (4000, 16))).astype(np.int64)
    before, c = None, v[:20].copy()
    own, upper, lower, scans = np.full(4000, -1), np.zeros(4000), np.zeros(4000), []
    for _ in range(8):
        own, upper, lower, n = clusters.Move(c, before).assign(v, own, upper, lower)
        scans.append(n)
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper**2 >= d[np.arange(4000), own]).all()
        d[np.arange(4000), own] = np.iinfo(np.int64).max
        assert (lower**2 <= d.min(axis=1)).all()
        before, c = c, np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(20)])
    assert scans[0] == 4000
    assert sum(scans[2:]) < 0.2 * 4000 * len(scans[2:])
