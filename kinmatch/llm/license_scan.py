"""Licence notices in texts: exact phrases, and short notices with a few edits.

A text becomes its lower-cased words joined by single spaces.  A notice that may
differ by ``k`` edits is split in ``k + 1`` pieces; any match holds one of the pieces
unchanged (pigeonhole), so plain substring search for the pieces finds every place
that can match, and the ``regex`` library's bounded-error matching verifies just those
places and tells the edits.  Matches start and end at words and are reported as word spans.

Every row is scanned alone inside Arrow batches, a slice of about one million
characters at a time: no shuffle, and memory follows the longest single text.

Defined results: a null text is an empty one, with no words and null first and last
word; ids may be null or repeated, rows are scanned as they come; overlapping places
of a phrase all count; of overlapping spans of a notice the one with the fewest edits is
reported, of equally good ones the leftmost, and all that do not overlap it; an empty table
gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose exact places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, their labels and the edits allowed in characters.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-grant", 6),
]

FOUND = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())])
)
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base array<string>, "
    "found array<struct<label:string,start:long,end:long,edits:int,length:int>>"
)


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` pieces of a notice and their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache
def _matcher(notice: str, edits: int, best: bool = True):
    import regex

    flag = "(?b)" if best else ""
    return regex.compile(rf"{flag}(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?= )")


def matches(text: str, notice: str, edits: int) -> Iterator:
    """The best match of ``text``, and those of what lies before and after it, in order.

    The best match among all that overlap it is found in a window, so that the work follows
    the length of ``text``.
    """
    any_match, best_match = _matcher(notice, edits, False), _matcher(notice, edits)
    reach = len(notice) + edits + 1
    later: list = []
    start, end = 0, len(text)
    while True:
        m = any_match.search(text, start, end)
        while m:
            # All matches that overlap m lie in the window; a better one there may have better ones beyond.
            better = best_match.search(text, max(start, m.start() - reach), min(end, m.end() + reach))
            if better is None or (sum(better.fuzzy_counts), better.start()) >= (sum(m.fuzzy_counts), m.start()):
                break
            m = better
        if m and any_match.search(text, start, m.start()):
            # First what lies before it.
            later.append((m, end))
            end = m.start()
            continue
        if m:
            yield m
            start = m.end()
        elif later:
            m, end = later.pop()
            yield m
            start = m.end()
        else:
            return


def places(text: bytes, part: bytes) -> Iterator[int]:
    """All positions of ``part``, overlapping ones included."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def regions(text: bytes, notice: bytes, edits: int) -> Iterator[tuple[int, int]]:
    """The merged stretches of ``text``, grown to whole words, in which a match must lie."""
    spans = []
    for offset, piece in pieces(notice, edits):
        for at in places(text, piece):
            start = at - offset - edits
            spans.append((start, start + len(notice) + 2 * edits))
    start = end = None
    for a, b in sorted(spans):
        # One character outside 7-bit ASCII may take four bytes.
        a = max(0, text.rfind(b" ", 0, max(0, a - 3 * edits) + 1))
        b = text.find(b" ", min(len(text) - 1, b + 3 * edits))
        b = len(text) if b < 0 else b + 1
        if end is not None and a < end:
            end = max(end, b)
            continue
        if end is not None:
            yield start, end
        start, end = a, b
    if end is not None:
        yield start, end


def scan_text(text: str | None, phrases: dict[str, str], notices: list[tuple[str, str, int]]) -> tuple:
    """n_words, n_base, first and last word of exact phrases, their labels, and the notices found."""
    words = WORD.findall(text.encode().lower()) if text else []
    joined = b" " + b" ".join(words) + b" "
    # The word that starts after a space has the number of spaces before that one.
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, base = [], set()
    for phrase, label in phrases.items():
        for at in places(joined, b" " + phrase.encode() + b" "):
            starts.append(int(np.searchsorted(spaces, at)))
            base.add(label)
    found = []
    for notice, label, edits in notices:
        for a, b in regions(joined, notice.encode(), edits):
            stretch = joined[a:b].decode()
            first = int(np.searchsorted(spaces, a))
            inside = np.flatnonzero(np.frombuffer(stretch.encode("utf-32-le"), dtype="<u4") == 32)
            for m in matches(stretch, notice, edits):
                start = first + int(np.searchsorted(inside, m.start())) - 1
                end = start + m.group().count(" ") + 1
                found.append({"label": label, "start": start, "end": end, "edits": sum(m.fuzzy_counts), "length": len(notice)})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), found


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, str, int]] = NOTICES,
) -> DataFrame:
    """Word and phrase counts of every document, and the spans of the notices found in it."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.list_(pa.string()), FOUND]
        names = ["n_words", "n_base", "first_word", "last_word", "base", "found"]
        for part in slices(batches, "text"):
            rows = [scan_text(t.as_py(), phrases, notices) for t in part.column("text")]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(over, f"doc_id {kind}, {SCHEMA}")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, spans of the exact phrases, all labels and the best similarity."""

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    similarity = F.transform("found", lambda f: F.lit(1.0) - f["edits"] / f["length"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("found", lambda f: f["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(similarity), F.lit(0.0))).alias("score"),
        F.array_join(
            F.transform("found", lambda f: F.format_string("%s:%d-%d:%d", f["label"], f["start"], f["end"], f["edits"])), " "
        ).alias("spans"),
    )
