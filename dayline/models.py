"""Models behind one interface: a function of a list of texts, made once in each worker, applied batch by batch.

No model is shipped; the stubs are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Batch = Callable[[list[str]], list[str]]


def first_sentences() -> Batch:
    """A summariser's stand-in: the first sentence."""
    return lambda texts: [t.split(". ")[0].strip() for t in texts]


def empty_index() -> Batch:
    """An event indexer's stand-in: an empty JSON object."""
    return lambda texts: ["{}" for _ in texts]


def apply(text: Column, make: Callable[[], Batch], batch: int = 8) -> Column:
    """The model's answer to each text, batch by batch."""

    @pandas_udf("string")
    def answers(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])])

    return answers(text)


def safe_json(answer: Column, schema: str) -> Column:
    """The answer read as JSON; an empty struct if it can't be."""
    return F.coalesce(F.from_json(answer, schema), F.from_json(F.lit("{}"), schema))


def transcribe(sounds: DataFrame, make: Callable[[], Callable[[bytes], dict]], schema: str) -> DataFrame:
    """Utterances of sound rows (name, content) by a model that answers with the fields of schema; the model is loaded once in each worker."""

    def run(frames):
        model = make()
        for frame in frames:
            yield pd.DataFrame([{"name": n} | model(c) for n, c in zip(frame["name"], frame["content"], strict=True)])

    return sounds.select("name", "content").mapInPandas(run, f"name string, {schema}")


def usable(utterances: DataFrame) -> DataFrame:
    """Utterances with segments, whose first is none of the phrases that models make of noise."""
    from .functions.text import WORTHLESS_INSIDE, contains_any

    return utterances.where((F.size("segments") > 0) & ~contains_any(F.get("segments", F.lit(0))["text"], WORTHLESS_INSIDE))
