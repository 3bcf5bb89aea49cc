"""Main text of a page: blocks of markup, kept by their length and their share of link text.

A page is cut at its block elements.  Menus, footers and advertisements are short blocks or
blocks of links; running text is long and has few links.  So a block is *plain* if at most a third of its
characters are link text, and *long* if it is plain and has ``LONG_WORDS`` words or more.  Long
blocks are kept, and plain ones right before or after a long one (headings, short paragraphs).
A page without a long block keeps its plain ones.  Broken markup only moves block borders:
nothing depends on elements being closed or nested.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.bind import let
from kinmatch.functions.text import HTML_DROPPED

LONG_WORDS = 12

#: Elements that start and end a block.
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul"
).split()

#: Marks for the start and end of a link and for a block border.
LINK, LINK_END, BORDER = "\x01", "\x02", "\x03"

ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def _code_point(code: Column) -> Column:
    """The character of a code point; those that are none give U+FFFD."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for entry in entries.items() for x in entry])


def _windows() -> dict[int, str]:
    """Characters that pages mean by the code points 128 to 159."""
    found = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return {n: char for n, char in found.items() if char}


def decode_references(text: Column) -> Column:
    """Named and numeric character references decoded once; unknown names stay as they are."""
    names = _table({name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"})
    windows = _table(_windows())

    def decoded(reference: Column) -> Column:
        name = F.regexp_extract(reference, ENTITY, 1)
        base = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(base, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        number = let(code, lambda c: F.coalesce(F.try_element_at(windows, c), _code_point(c)))
        return F.when(F.startswith(name, F.lit("#")), number).otherwise(F.coalesce(F.try_element_at(names, name), reference))

    parts = F.zip_with(
        F.split(text, ENTITY, -1),
        F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)),
        lambda plain, reference: F.concat(plain, F.when(reference.isNull(), "").otherwise(decoded(reference))),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def _marked(html: Column) -> Column:
    """Text with marks for links and block borders instead of markup."""
    html = F.translate(html, LINK + LINK_END + BORDER, "   ")
    for pattern in HTML_DROPPED[:-1]:
        html = F.regexp_replace(html, pattern, " ")
    for pattern, mark in [
        (rf"(?is)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", BORDER),
        (r"(?is)<a\b[^>]*>", LINK),
        (r"(?is)</a\s*>", LINK_END),
        (HTML_DROPPED[-1], " "),
    ]:
        html = F.regexp_replace(html, pattern, mark)
    return html


def _dense(text: Column) -> Column:
    """Characters other than marks and white space."""
    return F.length(F.regexp_replace(text, "[\\x01\\x02 \\t\\r\\n]+", ""))


def text_blocks(html: Column) -> Column:
    """The blocks of a page that have a text, as ``(text, words, chars, link_chars)`` in order."""

    def block(raw: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(raw, F.lit("\\x01([^\\x01\\x02]*)"), F.lit(1)), "")
        spaced = F.regexp_replace(decode_references(F.translate(raw, LINK + LINK_END, "")), "[ \\t\\r\\n\\x{A0}]+", " ")
        return let(
            F.trim(spaced),
            lambda text: F.struct(
                text.alias("text"),
                F.size(F.split(text, " ")).alias("words"),
                _dense(raw).alias("chars"),
                _dense(linked).alias("link_chars"),
            ),
        )

    return F.filter(F.transform(F.split(_marked(html), BORDER, -1), block), lambda b: b["text"] != "")


def main_text(html: Column) -> Column:
    """The kept blocks of a page, a line each; empty if there are none, null for a null page."""

    def kept(blocks: Column) -> Column:
        plain = F.transform(blocks, lambda b: b["link_chars"] * 3 <= b["chars"])
        long = F.transform(blocks, lambda b: (b["link_chars"] * 3 <= b["chars"]) & (b["words"] >= LONG_WORDS))

        def chosen(plain: Column, long: Column) -> Column:
            def near(i: Column) -> Column:
                here = [F.coalesce(F.get(long, at), F.lit(False)) for at in (i - 1, i, i + 1)]
                return F.get(plain, i) & (here[0] | here[1] | here[2] | ~F.exists(long, lambda x: x))

            return F.array_join(F.transform(F.filter(blocks, lambda b, i: near(i)), lambda b: b["text"]), "\n")

        return let(plain, lambda p: let(long, lambda q: chosen(p, q)))

    return let(text_blocks(html), kept)
