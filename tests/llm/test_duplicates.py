"""SimHash components, substring removal and decontamination against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayline.llm import decontam, simhash, substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), s or "")


def fingerprint(text, n):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


@pytest.mark.parametrize("text", ["", " \n", "one", "a b c", "a b c d", "A b C d e É", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == fingerprint(text, 4)


def test_components(spark, documents, corpus):
    rows = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(documents).collect()]
    fps = [fingerprint(t, 4) for _, t in corpus]
    groups = {}
    for (doc, _), root in zip(corpus, roots(fps, 4), strict=True):
        groups.setdefault(root, []).append(doc)
    expected = []
    for (doc, _), fp, root in zip(corpus, fps, roots(fps, 4), strict=True):
        ids = [d for d in groups[root] if d is not None]
        expected.append((doc, fp, min(ids) if ids else None))
    assert Counter(rows) == Counter(expected)


def test_long_posting_lists(spark, monkeypatch):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, *centre}
    for c in centre:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    for light, block in ((64, 2048), (4, 40)):
        monkeypatch.setattr(simhash, "LIGHT", light)
        monkeypatch.setattr(simhash, "BLOCK", block)
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
        groups, expected = {}, {}
        for x, root in zip(signed, roots(fps, 4), strict=True):
            groups.setdefault(found.get(x, x), set()).add(x)
            expected.setdefault(root, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_too_many_bits(documents):
    with pytest.raises(ValueError, match="at most 4"):
        simhash.near_duplicates(documents, max_bits=5)


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups_of(rows):
    """Rows joined where their words are equal or the similarity of 0.8 holds, and by nothing else."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        same = sets[i] == sets[j] and WORD.findall(lower(rows[i][1])) == WORD.findall(lower(rows[j][1]))
        if same or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def ids_of(rows):
    return sorted(rows, key=lambda x: (x is None, x or 0))


def test_keep_one(documents, corpus):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [min((d for d, _ in g if d is not None), default=None) for g in groups_of(corpus)]
    assert ids_of(r["doc_id"] for r in kept.collect()) == ids_of(ids)


def test_near_copies(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + n, edited(rng, t, n)) for i, t in enumerate(base) for n in (1, 2, 4, 8, 40)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = groups_of(rows)
    assert 12 < len(groups) < len(rows)
    assert ids_of(r["doc_id"] for r in kept.collect()) == ids_of(min(d for d, _ in g) for g in groups)


def test_crowd(spark, monkeypatch):
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [(i, edited(rng, base, 1)) for i in range(120)] + [(500 + i, " ".join(f"x{rng.randrange(5000)}" for _ in range(100))) for i in range(50)]
    monkeypatch.setattr(simhash, "BLOCK", 50)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ids_of(r["doc_id"] for r in kept.collect()) == [0, *range(500, 550)]


def fresh(rng, n):
    return " ".join(f"w{rng.getrandbits(48)}" for _ in range(n))


def test_contiguous_edits(spark):
    rng, rows = random.Random(13), []
    for i, (n, more) in enumerate([(20, 1), (40, 4), (100, 10), (100, 20), (100, 30), (300, 60), (1000, 200)] * 8):
        text = fresh(rng, n)
        rows += [(10 * i, text), (10 * i + 1, text + " " + fresh(rng, more))]
    for i in range(900, 910):
        text = fresh(rng, 100)
        rows += [(10 * i, text), (10 * i + 1, text.rsplit(" ", 5)[0] + " " + fresh(rng, 5))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ids_of(r["doc_id"] for r in kept.collect()) == ids_of(min(d for d, _ in g) for g in groups_of(rows))


def test_bands():
    rng, missed = np.random.default_rng(14), 0
    for n in (9, 90, 900):
        for _ in range(400):
            x = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
            missed += not (simhash.band_keys(x, simhash._bands(0.8)) == simhash.band_keys(x[: n * 8 // 9], simhash._bands(0.8))).any()
    assert simhash._bands(0.8) == 35
    assert missed == 0


def test_crowds_by_similarity(spark, monkeypatch):
    """More than LIGHT texts in a list: one rule for links, whatever the length."""
    rng = random.Random(15)
    base = fresh(rng, 100)
    rows = [(i, base + " " + fresh(rng, 12)) for i in range(90)]  # 0.8 between any two
    words = fresh(rng, 60).split()
    rows += [(1000 + i, " ".join(rng.sample(words, len(words)))) for i in range(80)]  # the same words in other orders
    base = fresh(rng, 100)
    rows += [(2000 + i, base + " " + fresh(rng, 60)) for i in range(90)]  # of one template, 0.45
    rows += [(2500 + i, t + " " + fresh(rng, 3)) for i, (_, t) in enumerate(rows[-12:])]
    expected = ids_of(min(d for d, _ in g) for g in groups_of(rows))
    assert len(expected) == 1 + 80 + 90
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for light, sets in ((64, 512), (2, 20)):
        monkeypatch.setattr(simhash, "LIGHT", light)
        monkeypatch.setattr(simhash, "SETS", sets)
        assert ids_of(r["doc_id"] for r in simhash.keep_one(df).collect()) == expected


def covered(texts, n):
    lists = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if counts[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h)))
    return out


@pytest.mark.parametrize("window", [1, 5, 35])
def test_substring(documents, corpus, window):
    got = substring.dedup(documents, window=window, part_bytes=3000, range_bytes=1500)
    assert [c for c in got.columns if c.startswith("input_")] == ["input_kept"]
    rows = Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in got.collect())
    assert rows == Counter((doc, *x) for (doc, _), x in zip(corpus, covered([t for _, t in corpus], window), strict=True))


def test_intervals():
    assert substring.intervals(np.array([0, 1, 2, 7, 20]), 5) == [(0, 12), (20, 25)]
    assert substring.intervals(np.array([], dtype=int), 5) == []


def test_hashes_are_of_words_alone():
    h = substring.Hasher(3)
    a, _ = h([b"x", b"a", b"b", b"c"])
    b, _ = h([b"a", b"b", b"c", b"a", b"b", b"c"])
    assert a[1] == b[0] == b[3]
    assert len(set(b.tolist())) == 3


BENCH = [(1, "Question: what is the name of the first long item here? Answer it now!"), (2, "short item"), (3, None), (4, "..."), (5, "what is the name of the first long item here answer"), (10, "short, item")]
NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_decontamination(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = [(1, "pre WHAT is -- the name of\nthe first long item here; answer it post"), (2, "a short-item, b"), (3, "shortitem short"), (4, None), (5, "é what is the name of the first long item her"), (6, "ключ short item short item"), (7, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    held = {}
    for item, text in BENCH:
        w = NORMAL.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            held.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    assert len(decontam.blocks_of(bench, 10, 150)) > 1
    for block_bytes in (1 << 20, 150):
        rows = {r["doc_id"]: r for r in decontam.scan(df, bench, block_bytes=block_bytes).collect()}
        for doc, text in texts:
            w = NORMAL.findall(lower(text))
            hit, items = set(), set()
            for key, names in held.items():
                for i in range(len(w) - len(key) + 1):
                    if tuple(w[i : i + len(key)]) == key:
                        hit |= set(range(i, i + len(key)))
                        items |= names
            r = rows[doc]
            assert (r["n_words"], r["items"]) == (len(w), sorted(items))
            assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == hit
            for s, c in zip(r["spans"], r["char_spans"], strict=True):
                assert NORMAL.findall(lower(text[c["start"] : c["end"]])) == w[s["start"] : s["end"]]
        clean = decontam.drop_contaminated(df, bench, block_bytes=block_bytes)
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in texts if not rows[d]["spans"])
    assert decontam.drop_contaminated(documents, bench).columns == documents.columns
    assert decontam.scan(documents, bench.limit(0)).where("size(items) > 0").count() == 0


def test_long_items_and_repeated_ones(spark):
    """An item of many pieces, repeated: windows over the seams of its pieces are found, and named once."""
    words = [f"w{i}" for i in range(2 * decontam.PIECE_WORDS + 50)]
    bench = spark.createDataFrame([(7, " ".join(words))] * 3, "item_id long, text string")
    at = decontam.PIECE_WORDS - 4
    docs = spark.createDataFrame([(1, "x " + " ".join(words[at : at + 10]) + " y"), (2, " ".join(words[at : at + 9])), (3, " ".join(words) * 2)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.scan(docs, bench).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]["spans"]] == [(1, 11)]
    assert rows[1]["items"] == rows[3]["items"] == ["7"]
    assert rows[2]["items"] == []


def test_only_texts_with_anchors_are_scanned_again(spark, monkeypatch):
    """Of a benchmark of many blocks, each text is scanned by the automata of those blocks alone that it holds anchors of; the result is that of one block, also with several groups of anchors."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abdeghiklmnoprst") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 30, 60])))) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(150)]
    for i in range(0, 60, 2):
        w = items[i][1].split()
        docs.append((200 + i, " ".join([*rng.choices(vocabulary, k=20), *w[-12:], *rng.choices(vocabulary, k=20)])))
    docs += [(400, None), (401, ""), (None, items[5][1]), (402, items[7][1]), (402, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("r"), "blocks": F.lit(1)}).repartition(3)
    whole = sorted(map(str, decontam.scan(df, bench).collect()))
    clean = sorted(map(str, decontam.drop_contaminated(df, bench).collect()))
    tables, kept = [], decontam.stored
    monkeypatch.setattr(decontam, "stored", lambda d, name: tables.append((name, out := kept(d, name))) or out)
    for anchor_rows in (1 << 20, 60):
        tables.clear()
        assert sorted(map(str, decontam.scan(df, bench, block_bytes=900, anchor_rows=anchor_rows).collect())) == whole
        names = [n for n, _ in tables]
        assert names.count("hits") >= 6
        assert (names.count("routed") == 1) == (anchor_rows == 1 << 20)
        again = sum(t.agg(F.sum(F.size("blocks"))).first()[0] for n, t in tables if n == "routed")
        assert again < 0.2 * len(docs) * names.count("hits")
    monkeypatch.undo()
    assert sorted(map(str, decontam.drop_contaminated(df, bench, block_bytes=900).collect())) == clean


@pytest.mark.parametrize("rest", range(11))
def test_items_a_little_longer_than_their_pieces(spark, monkeypatch, rest):
    """An item of whole pieces and a few words more is found by whole windows alone, whatever is left behind its last piece."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 20)
    words = [f"w{i}" for i in range(60 + rest)]
    bench = spark.createDataFrame([("A", " ".join(words)), ("B", "b1 b2 b3")], "item_id string, text string")
    texts = [f"clean {' '.join(words[60 - 5 : 60 + k])} text" for k in range(rest + 1)] + [" ".join(words[k:]) for k in (0, 15, 40, 50, 51 + rest, 55)] + ["x b1 b2 b3 y", "x b1 b2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    windows = {tuple(words[i : i + 10]) for i in range(len(words) - 9)} | {("b1", "b2", "b3")}
    expected = {}
    for i, t in enumerate(texts):
        w = t.split()
        hit = {j for k in (3, 10) for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in windows for j in range(a, a + k)}
        expected[i] = len(hit)
    got = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in decontam.scan(docs, bench).collect()}
    assert got == expected
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {i for i, n in expected.items() if not n}


def test_empty(spark, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert substring.dedup(empty).count() == 0
    assert decontam.scan(empty, bench).count() == 0


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Fingerprints propose links, also where no band does, and shingle sets decide on them."""
    rng = random.Random(31)
    rows = [(i, fresh(rng, 400)) for i in range(30)]
    rows += [(100 + i, f"{t} {fresh(rng, 1)}") for i, (_, t) in enumerate(rows)]
    near = {100 + i for i in range(30) if (simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[30 + i][1], 5)).bit_count() <= 4}
    assert len(near) >= 20
    df = spark.createDataFrame([*rows, (500, rows[0][1].upper())], "doc_id long, text string")
    monkeypatch.setattr(simhash, "band_keys", lambda shingles, n_bands: np.empty(0, dtype=np.int64))
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == {d for d, _ in rows} - near
    monkeypatch.setattr(simhash, "similar", lambda x, y, similarity: False)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == {d for d, _ in rows}
