"""Session helpers: a local session for tests, and durable intermediate tables.

Intermediate results that are read more than once (frontiers of the graph walk,
the candidate list of the two-stage search) are written as Parquet below the
folder named by ``spark.checkpoint.dir``.  A written table cuts the lineage, has
real size statistics for adaptive execution, and survives the loss of executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class _Unwatched(list):
    """Folders outside of any ``stored_tables`` are not remembered."""

    def append(self, folder: str) -> None:
        pass


_made: ContextVar[list] = ContextVar("made", default=_Unwatched())


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinmatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_shared(folder: str, master: str) -> bool:
    """Whether all tasks reach ``folder``: any but a local one, and that too where one machine's threads do the work."""
    alone = master == "local" or master.startswith("local[")
    return alone or not (folder.startswith("file:") or "://" not in folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for durable tables, below ``spark.checkpoint.dir``.

    Where that is not set, they go below the warehouse.  A warehouse in the driver's own file system
    is refused unless the driver does all the work itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        master = spark.conf.get("spark.master", "")
        if not is_shared(warehouse, master):
            raise ValueError(f"executors of {master} do not share {warehouse}: set spark.checkpoint.dir to a folder that they all reach")
        root = f"{warehouse}/checkpoints"
    folder = f"{root.rstrip('/')}/kinmatch/{uuid.uuid4().hex}"
    _made.get().append(folder)
    return folder


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, every folder that ``shared_folder`` gave out within."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table and return a scan of that table."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/table"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
