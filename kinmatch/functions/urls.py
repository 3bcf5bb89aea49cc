"""Website predicates and URL rewriting as native column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.bind import let

# The characters Python counts as whitespace, as a regex class body.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode whitespace (``trim`` only knows U+0020)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(f"[^{SPACE}]")


@lru_cache
def _unsafe_in_host() -> str:
    """Regex class of characters whose compatibility form holds a URL delimiter."""
    chars = (chr(c) for c in range(128, sys.maxunicode + 1))
    unsafe = (c for c in chars if re.search("[/?#@:]", unicodedata.normalize("NFKC", c)))
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in unsafe) + "]"


@lru_cache
def _ip6() -> str:
    """Regex of an IPv6 address, with an optional zone."""
    group = "[0-9a-f]{1,4}"
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = f"(?:{group}:{group}|{byte}(?:\\.{byte}){{3}})"
    forms = [f"(?:{group}:){{6}}{tail}"]
    for before in range(6):
        head = f"(?:(?:{group}:){{0,{before - 1}}}{group})?" if before else ""
        after = 5 - before
        forms.append(f"{head}::(?:{group}:){{{after}}}{tail}")
    forms.append(f"(?:(?:{group}:){{0,5}}{group})?::{group}")
    forms.append(f"(?:(?:{group}:){{0,6}}{group})?::")
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


def is_valid_website(url: Column) -> Column:
    """True when the text, prefixed with a scheme if it has none, names a host.

    The host may be any non-empty text up to ``/``, ``?`` or ``#``, so
    ``not a url`` is valid; a bracketed host must be an IP literal.
    """
    bare = F.lower(strip(url))
    prefixed = let(bare, lambda t: F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t)))
    host = F.regexp_extract(F.regexp_replace(prefixed, r"[\t\r\n]", ""), "^https?://([^/?#]*)", 1)
    return F.when(is_blank(url), F.lit(False)).otherwise(let(host, _is_host))


def _is_host(host: Column) -> Column:
    plain = host.rlike(r"^[\x21-\x7e&&[^\[\]]]+\z")
    opens, closes = host.contains("["), host.contains("]")
    literal = F.regexp_extract(host, r"^[^\[]*\[([^\]]*)", 1)
    brackets_ok = (~opens & ~closes) | (
        opens & closes & literal.rlike(f"^(?:v[0-9a-f]+\\..+|{_ip6()})\\z")
    )
    return plain | ((host != "") & brackets_ok & ~host.rlike(_unsafe_in_host()))


def with_scheme(url: Column) -> Column:
    """Prefix ``https://`` unless the text already starts with either scheme."""
    has = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has, url).otherwise(F.concat(F.lit("https://"), url))


def domain(url: Column) -> Column:
    """Drop every scheme and ``www.``, wherever they occur, and trailing slashes."""
    for part in ("https://", "http://", "www."):
        url = F.replace(url, F.lit(part), F.lit(""))
    return F.regexp_replace(url, r"/+\z", "")
