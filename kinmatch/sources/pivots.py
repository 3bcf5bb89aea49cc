"""Field vectors stored by pivot, so that a search reads only what can be near.

Each vector is stored with the nearest of some pivots of its field, which are vectors drawn
from the corpus, and with its distance to it.  By the triangle inequality a vector of a pivot at the distance ``d``
from a query, whose members are between ``least`` and ``most`` away from it, is at least ``max(d - most, least - d)`` away
from the query.  A pivot is a folder, so pivots that are not wanted are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import vectors as V
from kinmatch.operators.ranking import top_k_per_group
from kinmatch.operators.similarity import usable_vectors

#: Pivots of a field.  The table of pivots is this many vectors per field and goes to the tasks.
PIVOTS = 64


@dataclass
class PivotStore:
    """A folder with vectors by field and pivot, the pivots, and what each pivot holds."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        schema = "company_id string, apart double, embedding array<float>, field_name string, pivot string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    @property
    def pivots(self) -> DataFrame:
        """field_name, pivot, embedding."""
        return self.spark.read.schema("field_name string, pivot string, embedding array<float>").parquet(f"{self.path}/pivots")

    @property
    def spheres(self) -> DataFrame:
        """field_name, pivot, members, least, most: how many vectors a pivot holds, and between which distances."""
        schema = "field_name string, pivot string, members long, least double, most double"
        return self.spark.read.schema(schema).parquet(f"{self.path}/spheres")


def store_by_pivot(vectors: DataFrame, path: str, pivots: int = PIVOTS) -> PivotStore:
    """Store all vectors that have a distance, each with the nearest pivot of its field and length.

    Pivots are the vectors of the companies with the smallest hashes.  One map assigns the vectors; they are
    balanced over the writing tasks by field and pivot.
    """
    import numpy as np

    spark = vectors.sparkSession
    usable = usable_vectors(vectors).filter((F.size("embedding") > 0) & V.is_finite(F.col("embedding")))
    rows = usable.select("company_id", "field_name", "embedding", F.size("embedding").alias("length"))
    drawn = top_k_per_group(rows, ["field_name", "length"], [F.xxhash64("company_id"), F.col("company_id")], pivots, "nth")
    number = F.concat_ws("-", "length", "nth").alias("pivot")
    drawn.select("field_name", number, "embedding").write.mode("overwrite").parquet(f"{path}/pivots")
    store = PivotStore(spark, path)
    groups: dict = {}
    for r in store.pivots.orderBy("field_name", "pivot").collect():  # ``pivots`` per field and length
        groups.setdefault((r["field_name"], len(r["embedding"])), []).append((r["pivot"], np.array(r["embedding"], dtype=np.float64)))
    shared = spark.sparkContext.broadcast({key: ([p for p, _ in found], np.stack([v for _, v in found])) for key, found in groups.items()})

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.column("field_name").to_pylist()
            lengths = batch.column("length").to_pylist()
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum([0, *lengths])[:-1]
            pivot, apart = [None] * len(names), np.zeros(len(names))
            places: dict = {}
            for i, key in enumerate(zip(names, lengths)):
                places.setdefault(key, []).append(i)
            for key, own in places.items():
                ids, matrix = shared.value[key]
                for at in range(0, len(own), 4096):
                    part = np.array(own[at : at + 4096])
                    block = flat[starts[part][:, None] + np.arange(key[1])[None, :]].astype(np.float64)
                    squares = (block**2).sum(1)[:, None] + (matrix**2).sum(1)[None, :] - 2 * block @ matrix.T
                    best = squares.argmin(1)
                    apart[part] = np.sqrt(((block - matrix[best]) ** 2).sum(1))
                    for i, b in zip(part.tolist(), best.tolist()):
                        pivot[i] = ids[b]
            columns = [batch.column("company_id"), batch.column("field_name"), pa.array(pivot, pa.string()), pa.array(apart), batch.column("embedding")]
            yield pa.RecordBatch.from_arrays(columns, ["company_id", "field_name", "pivot", "apart", "embedding"])

    placed = rows.mapInArrow(assign, "company_id string, field_name string, pivot string, apart double, embedding array<float>")
    placed.hint("rebalance", "field_name", "pivot").write.mode("overwrite").partitionBy("field_name", "pivot").parquet(f"{path}/vectors")
    held = store.vectors.groupBy("field_name", "pivot").agg(
        F.count(F.lit(1)).alias("members"), F.min("apart").alias("least"), F.max("apart").alias("most")
    )
    held.write.mode("overwrite").parquet(f"{path}/spheres")
    return store
