"""What the training-data operators share: word rules, folds, names, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space between words: 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Characters of text that a Python worker turns into words at a time.
SLICE_CHARS = 1_000_000


#: The multipliers of the SplitMix64 finalizer.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finalizer of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def packed(keys: np.ndarray, width: int) -> bytes:
    """Keys as ``width`` bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: Column) -> Column:
    """Words between white space, as an array; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; ``bytes.split`` has exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``chars`` characters, or one longer row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
