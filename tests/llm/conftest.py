import random

import pytest


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz") * rng.randint(0, 2) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, very long, empty, null and odd texts, a repeated row and a null id."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 50))
    rows = [(i, " ".join(words(rng, rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, rows[3][1] + " " + passage + " tail" + str(i)) for i in range(4)]
    rows += [(200 + i, rows[5][1]) for i in range(3)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "Ünïcödé  çafé\nİstanbul 漢字 <|endoftext|>"), (305, " ".join(words(rng, 9000)))]
    rows += [(306, "same " * 80), (306, "same " * 80), (None, "no id at all"), (307, passage)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string")
    # more columns, some with names that operators use themselves
    return df.withColumns({"lang": F.lit("en"), "kept": F.lit("k"), "part": F.lit(7), "toxicity": F.lit("x"), "fp": F.lit(1)}).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
