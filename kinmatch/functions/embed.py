"""A default text embedding: counts of hashed words, scaled to unit length.

It stands in where no model is plugged in.  The whole embedding is one column
expression, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.bind import let
from kinmatch.functions.urls import is_blank, strip
from kinmatch.functions.vectors import normalise

DIM = 64
# The character of the first bucket; the marks are plain ASCII for up to 79 buckets.
FIRST_MARK = 48


def word_bucket(word: Column, dim: int = DIM) -> Column:
    """Bucket of a word, from the first seven hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.encode(word, "UTF-8")), 1, 7), 16, 10).cast("int") % dim


def embed_text(text: Column, dim: int = DIM) -> Column:
    """Unit vector of the word counts of a text, null for a blank one.

    The buckets of the words are written as one character each; a bucket's count is
    what its character adds to the length of that line.
    """
    words = F.split(F.lower(strip(text)), "[ \\t\\r\\n]+")
    mark = [chr(FIRST_MARK + slot) for slot in range(dim)]
    marks = F.array(*[F.lit(m) for m in mark])
    line = F.array_join(F.transform(words, lambda w: F.get(marks, word_bucket(w, dim))), "")

    def counts(row: Column) -> Column:
        size = F.char_length(row)
        return F.array(*[size - F.char_length(F.replace(row, F.lit(m), F.lit(""))) for m in mark])

    vector = let(let(line, counts), normalise)
    return F.when(~is_blank(text), F.transform(vector, lambda x: x.cast("float")))
