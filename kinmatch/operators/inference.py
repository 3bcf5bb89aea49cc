"""Batch inference: a user-supplied model as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters of texts that a model gets at a time, unless one text is longer.
CHARS = 1_000_000


def _cuts(sizes: list[int | None], most: int, chars: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` texts and about ``chars`` characters; a null has no size."""
    start = texts = held = 0
    for i, n in enumerate(sizes):
        if n is None:
            continue
        if texts and (texts == most or held + n > chars):
            yield start, i
            start, texts, held = i, 0, 0
        texts, held = texts + 1, held + n
    if start < len(sizes):
        yield start, len(sizes)


def infer(text: Column, model: Callable[[], Callable], dtype: T.DataType | str = "string", most: int = 256) -> Column:
    """Answer of a model for each text, null where it fails or the text is null.

    ``model`` is called once per task and returns a function from a list of texts
    to a list of answers of the same length, for at most ``most`` texts at a time, or fewer
    long ones.  A list that fails is asked again in halves, so that one bad text costs its own answer
    and a few calls.  Answers go on as they come: a task holds those of one list.  The column counts as non-deterministic, so Spark asks once per row.
    """
    import pandas as pd

    def answers(batches):
        ask = model()

        def found(texts):
            try:
                got = list(ask(texts))
                if len(got) == len(texts):
                    return got
            except Exception:
                pass
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return found(texts[:half]) + found(texts[half:])

        for batch in batches:
            sizes = [None if pd.isna(t) else len(t) for t in batch]
            for start, end in _cuts(sizes, most, CHARS):
                rows = batch.iloc[start:end]
                texts = rows.dropna()
                got = found(list(texts)) if len(texts) else []
                yield pd.Series(got, index=texts.index, dtype=object).reindex(rows.index, fill_value=None)
            if not len(batch):
                yield pd.Series([], dtype=object)

    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(answers, dtype).asNondeterministic()(text)
