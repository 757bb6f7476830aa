"""Each registered query on small tables against a plain computation of its columns."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dayline.llm import queries
from dayline.llm.common import vocabulary

SPACE = re.compile("[^\x20\x09-\x0d]+")
NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """The corpus of the other tests and more documents, labels of most and a benchmark, as a folder of tables."""
    rng = random.Random(17)
    plain = ["".join(rng.choice("abdeghiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = list(corpus), []
    for i in range(1000, 1600):
        bad, junk = i % 7 == 0, i % 11 == 0
        w = rng.choices(plain, k=rng.randint(20, 90))
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["vermin", "zwock" + rng.choice(plain), "Fool"]))
        text = " ".join(w) + "."
        rows.append((i, text.replace(" ", " | ") if junk else text))
        labels.append((i, int(not junk), int(bad)))
    bench = [(1, " ".join(corpus[4][1].split()[:25])), (12, "same same same"), (3, None), (4, "...")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, labels, bench


def lower(s):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), s or "")


@functools.cache
def tokenizer(kind):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(kind))
    t.encode_special_tokens = True
    return t


def ids_of(kind, text, end):
    return np.array([*tokenizer(kind).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_op1(spark, tables):
    folder, rows, _, _ = tables
    expected, lengths = Counter(), Counter()
    for doc, text in rows:
        ids = ids_of("word_bpe_49k.json", text, 1)
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            expected[doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    places = {}
    got = queries.op1_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        lengths[r["sequence_id"]] += r["length"]
    assert all(sum(n for _, n in sorted(p)[:i]) == sorted(p)[i][0] for p in places.values() for i in range(len(p)))
    assert max(lengths.values()) <= 2048
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in lengths.values())
    assert sum(lengths.values()) > 0.95 * padded


def test_op2_and_op7(spark, tables):
    folder, rows, labels, _ = tables
    for query, at, level in ((queries.op2_toxicity, 2, 0.97), (queries.op7_quality, 1, 0.97)):
        got = query(spark, folder).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
        assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        said = {r["doc_id"]: r["predicted"] for r in got if r["held_out"]}
        held = [said[x[0]] == x[at] for x in labels if x[0] in said]
        assert len(held) > 80
        assert np.mean(held) >= level


def test_op4(spark, tables):
    folder, rows, _, _ = tables
    expected, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of("byte_bpe_50k.json", text, 0)
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op4_token_orc(spark, folder).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == expected


def test_op5(spark, tables):
    import xxhash

    folder, rows, _, _ = tables
    prints = []
    for _, text in rows:
        w = SPACE.findall(lower(text))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    distinct = np.array(sorted(set(prints)), dtype=np.uint64)
    root = np.arange(len(distinct))
    for _ in range(len(distinct)):
        new = np.array([root[np.bitwise_count(distinct ^ x) <= 4].min() for x in distinct])
        if (new == root).all():
            break
        root = new
    place = {int(x): int(r) for x, r in zip(distinct, root, strict=True)}
    least = {}
    for (doc, _), fp in zip(rows, prints, strict=True):
        if doc is not None:
            least[place[fp]] = min(doc, least.get(place[fp], doc))
    expected = Counter((doc, f"{fp:016x}", least.get(place[fp])) for (doc, _), fp in zip(rows, prints, strict=True))
    assert Counter(tuple(r) for r in queries.op5_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()) == expected


def test_op6(spark, tables):
    folder, rows, _, _ = tables
    lists = [SPACE.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + 35]) for w in lists for i in range(len(w) - 34))
    expected = Counter()
    for (doc, _), w in zip(rows, lists, strict=True):
        hit = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in hit)
        expected[doc, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op6_substring(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == expected


def test_op8(spark, tables):
    folder, rows, _, bench = tables
    held = {}
    for item, text in bench:
        w = NORMAL.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            held.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    expected, found = Counter(), 0
    for doc, text in rows:
        w = NORMAL.findall(lower(text))
        hit, items = set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if (names := held.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= names
        found += bool(hit)
        expected[doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    assert found >= 3
    got = queries.op8_decontamination(spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r) for r in got.collect()) == expected
