"""Captured web pages: ``(url, content)`` records, empty content is a failed capture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.bind import with_once
from kinmatch.functions.text import html_text
from kinmatch.functions.urls import is_blank


def with_content(pages: DataFrame, html: str = "html", text: Callable[[Column], Column] = html_text) -> DataFrame:
    """Adds the readable text of raw pages: all of it, or with ``page.main_text`` without menus and footers."""
    return with_once(pages, "content", text(F.col(html)))


def successful(captures: DataFrame) -> DataFrame:
    return captures.filter(~is_blank(F.col("content")))


def lookup(rows: DataFrame, captures: DataFrame, url: str = "company_id") -> DataFrame:
    """Rows with the content captured for their url; rows without content drop out."""
    pages = successful(captures).select(F.col("url").alias(url), "content")
    return rows.join(pages, url)
