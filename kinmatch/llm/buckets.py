"""Stored tables that are bucketed by a key, so that joins on it leave them where they are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kinmatch.session import shared_folder


class Bucketed:
    """A table below the shared folder, bucketed by ``key``; joins with another of as many buckets do not shuffle it."""

    def __init__(self, df: DataFrame, key: str, buckets: int):
        self.spark, self.key, self.buckets = df.sparkSession, key, buckets
        self.name = f"kinmatch_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/table"
        df.write.format("parquet").bucketBy(buckets, key).option("path", self.path).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Take the table out of the catalog, and its files out of the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
