"""Set-difference joins that leave the large side where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def except_known(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not among the keys of ``known``.

    An anti join can only send its right side to the tasks, and here that is the
    large one.  So the known keys are first cut to those in the batch, which lets
    the planner send the batch keys to the scan of ``known`` when they are few.
    The batch should hold few rows per key; ``known`` may hold many.
    """
    hits = known.select(key).join(batch.select(key), key, "left_semi").distinct()
    return batch.join(hits, key, "left_anti")
