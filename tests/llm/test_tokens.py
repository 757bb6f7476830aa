"""Tokenisation, packing and token files against the tokenizers library itself."""

import array
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayline.llm import packing, tokenfile
from dayline.llm.common import vocabulary
from dayline.llm.tokens import encoder

VOCABULARIES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


def library(kind, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(VOCABULARIES[kind]))
    t.encode_special_tokens = True
    return array.array("I", t.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("kind", VOCABULARIES)
@pytest.mark.parametrize("text", ["", " ", "a  b", "x \n y", " lead", "trail ", "a\tb\n\nc", "it's John's", "12 345", "foo_bar <|endoftext|> x", "naïve Œuvre straße", "漢字 test", "don't  stop", "²x ½", "İI ı", "é ǅ", "a b c\u001cd", "!!!??", "A" * 3000])
def test_equal(kind, text):
    assert encoder(vocabulary(VOCABULARIES[kind]), kind)(text) == library(kind, text)


@pytest.mark.parametrize("kind", VOCABULARIES)
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcXYZ'’.,!09_éÄßñ—"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=60))
def test_equal_on_any_text(kind, text):
    assert encoder(vocabulary(VOCABULARIES[kind]), kind)(text) == library(kind, text)


def test_first_fit_decreasing():
    lengths = sorted([7, 5, 5, 4, 3, 3, 2, 1, 10], reverse=True)
    bins, offsets = packing.first_fit_decreasing(lengths, 10)
    room, expected = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(10)
        expected.append((b, 10 - room[b]))
        room[b] -= n
    assert list(zip(bins, offsets, strict=True)) == expected


@pytest.mark.parametrize("size", [16, 64])
def test_pack(documents, corpus, size):
    packed = packing.pack(documents, vocabulary(VOCABULARIES["word"]), size=size, group_bytes=2000)
    rows = packed.collect()
    whole = {}
    for doc, text in corpus:
        whole.setdefault(doc, []).append(library("word", text) + b"\1\0\0\0")
    seen, sequences = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in whole.items():
        got = b"".join(x for _, x in sorted(seen[doc]))
        assert len(got) == sum(map(len, ids))
        if len(ids) == 1:
            assert got == ids[0]
            assert [s for s, _ in sorted(seen[doc])] == list(range(0, len(got) // 4, size))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    full = packing.sequences(packed, size=size).collect()
    assert all(len(r["ids"]) in (size, r["n_tokens"]) for r in full)
    used = sum(r["n_tokens"] for r in full)
    assert used == sum(n for p in sequences.values() for _, n in p)
    assert sum(len(r["ids"]) for r in full) < 1.2 * used


def test_token_files(spark, documents, corpus, tmp_path):
    vocab = vocabulary(VOCABULARIES["byte"])
    path = str(tmp_path / "orc")
    tokenfile.write(documents, path, vocab, file_bytes=20_000)
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for doc, text in order:
        ids = library("byte", text) + b"\0\0\0\0"
        expected.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in tokenfile.digests(spark, path).orderBy("start").collect()]
    assert got == expected
    files = tokenfile.read(spark, path)
    assert len(list((tmp_path / "orc").glob("part-*.orc"))) > 1
    back = files.where("doc_id = 303").collect()
    assert array.array("I", back[0]["ids"]).tobytes() == library("byte", "one") + b"\0\0\0\0"
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,303)]" in files.where("doc_id = 303")._jdf.queryExecution().toString()


def scanned(df):
    """Rows that the scan of files gave to the filter above it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()


def test_stripes_and_bloom_filters(spark, tmp_path):
    import pyarrow.orc as orc

    docs = spark.range(0, 24_000, 2).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), 20) AS text")
    path = str(tmp_path / "orc")
    tokenfile.write(docs, path, vocabulary(VOCABULARIES["byte"]), file_bytes=1 << 30, stripe_bytes=64 << 10)
    (file,) = (tmp_path / "orc").glob("part-*.orc")
    written = orc.ORCFile(file)
    sizes = [written.read_stripe(i, columns=["doc_id"]).num_rows for i in range(written.nstripes)]
    assert len(sizes) >= 4
    assert sum(sizes) == 12_000
    rows = tokenfile.read(spark, path)
    assert scanned(rows) == 12_000
    one = rows.where("doc_id = 6000")
    assert scanned(one) <= 1000  # the row group that holds it, of the one stripe that does
    assert one.count() == 1
    inside = [scanned(rows.where(f"doc_id = {x}")) for x in range(6001, 6041, 2)]
    assert inside.count(0) >= 18  # inside every statistic's range, so only the Bloom filters tell
    # splits of one file: each takes the stripes that begin in it
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(file.stat().st_size // 4))
    try:
        parts = tokenfile.read(spark, path).select("doc_id").rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(parts) == 12_000
    assert sum(n > 0 for n in parts) >= 3


def test_empty(spark, empty):
    assert packing.pack(empty, vocabulary(VOCABULARIES["word"])).count() == 0
    assert tokenfile.write_and_digest(empty, vocabulary(VOCABULARIES["byte"])).count() == 0


def test_columns(documents):
    assert packing.pack(documents.select(F.col("doc_id"), F.col("text")), vocabulary(VOCABULARIES["word"])).columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
