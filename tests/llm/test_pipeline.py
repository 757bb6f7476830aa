"""The stages of the pipeline on a small corpus, and the registered queries."""

import random

import pytest

import corpus_pipeline
from dayline.llm import queries

PASSAGE = " ".join(f"passage{i}" for i in range(60))
QUESTION = "Which of these many words makes a long question of more than ten words?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abdeghiklmnoprst") for _ in range(rng.randint(3, 9))) for _ in range(120))
    docs = [(i, text()) for i in range(200)]
    docs += [(300 + i, f"{docs[i][1]} vermin") for i in range(60)]  # toxic; all but the word is a clean document's text
    docs = [(i, t if i < 300 else text() + " vermin") for i, t in docs]
    docs += [(400, docs[7][1]), (401, docs[7][1] + " x"), (402, text() + " " + PASSAGE), (403, text() + " " + PASSAGE + " " + text()), (404, text() + " " + QUESTION), (405, None), (406, "")]
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 400)) for i, _ in docs[:260]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, near, cut, clean = kept
    assert sorted(toxic) == [*range(200), *range(400, 407)]
    assert sorted(near) == [*range(200), *range(402, 406)]
    assert sorted(cut) == sorted(near)
    assert all("passage" not in t for t in cut.values() if t)
    assert all(cut[i] == near[i] for i in range(200))
    assert sorted(clean) == [i for i in sorted(cut) if i != 404]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {*range(200), 402, 403, 405}
    assert all(len(r["ids"]) == 4 * r["length"] <= 8192 for r in rows)


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


CLASHING = ["toxicity", "kept_c", "kept_id", "own_c", "of_equal_rows", "part", "input_part", "kept", "input_kept", "removed", "n_words", "c0", "c1", "grp", "root", "k", "keys", "spans", "start", "length"]


def clashing(docs, names):
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_clashing_names(spark, folder):
    """Whatever other columns are called, each stage returns the rows it returns without them, and their values as they were; repeated rows and a null id are kept as ever."""
    plain = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id >= 300")
    plain = plain.unionByName(plain.where("doc_id = 3")).unionByName(plain.where("doc_id = 5").selectExpr("NULL AS doc_id", "concat(text, ' and more of it') AS text", "lang", "source", "n_chars"))
    docs = clashing(plain, CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        plain, docs = stage(spark, plain, folder).cache(), stage(spark, docs, folder).cache()
        assert docs.columns == columns
        assert rows_of(docs.select(*plain.columns)) == rows_of(plain)
        assert rows_of(docs.select(*CLASHING)) == rows_of(clashing(plain, CLASHING).select(*CLASHING))
    last = corpus_pipeline.STAGES[-1][1]
    assert rows_of(last(spark, docs, folder).drop("sequence_id", "offset")) == rows_of(last(spark, plain, folder).drop("sequence_id", "offset"))


@pytest.mark.parametrize("names", [["part"], ["kept", "removed"], ["part", "input_part"], ["kept", "input_kept", "n_words"], ["KEPT", "Input_kept"]])
def test_clashing_names_of_substring(spark, names):
    from dayline.llm import substring

    text = " ".join(f"w{i}" for i in range(40))
    docs = clashing(spark.createDataFrame([(1, text), (2, text + " end"), (3, "alone")], "doc_id long, text string"), names)
    cut = substring.dedup(docs)
    assert len({c.lower() for c in cut.columns}) == len(docs.columns) + 3
    assert {(r["doc_id"], r["kept"], r["n_words"]) for r in cut.collect()} == {(1, "", 40), (2, "end", 41), (3, "alone", 1)}
    assert {(r["doc_id"], r["text"], r[names[0]]) for r in substring.without_repeats(docs).collect()} == {(2, "end", f"{names[0]} of 2"), (3, "alone", f"{names[0]} of 3")}


def test_empty_stages(spark, folder):
    docs = clashing(spark.read.parquet(f"{folder}/documents.parquet").limit(0), CLASHING[:3])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = stage(spark, docs, folder).cache(), docs.columns
        assert docs.columns == columns
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
