"""Text, date and id expressions shared by the pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.urls import SPACE

NOT_ENOUGH = "[Not enough information]"
NO_SOURCES = "No sources provided"
NOT_AVAILABLE = "N/A"


def join_items(items: Column, sep: str = ", ") -> Column:
    """Join the non-null, non-empty items of an array; a blank item is kept."""
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), sep)


def document_id(company: Column, field: Column) -> Column:
    return F.concat(company, F.lit("_"), field)


def parse_date(text: Column, fmt: str = "yyyy-MM-dd", on_error: str = "fail") -> Column:
    """Text to timestamp; bad text raises (``fail``) or becomes null (``null``)."""
    if on_error not in ("fail", "null"):
        raise ValueError("on_error is 'fail' or 'null'")
    parse = F.to_timestamp if on_error == "fail" else F.try_to_timestamp
    return parse(text, fmt if on_error == "fail" else F.lit(fmt))


def format_date(when: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(when, fmt)


def preview(text: Column, size: int = 100) -> Column:
    """Cut text longer than ``size`` and mark the cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def or_placeholder(value: Column, is_list: bool = False, placeholder: str = NOT_ENOUGH) -> Column:
    """Show a string or a comma-joined list; null and empty become the placeholder."""
    if is_list:
        return F.when(F.size(value) > 0, F.array_join(value, ", ")).otherwise(F.lit(placeholder))
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(placeholder))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def name_slug(name: Column) -> Column:
    """Keep letters, digits and underscores of a name, lower-cased."""
    kept = F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_{SPACE}-]", "")
    return F.lower(F.regexp_replace(kept, "[ -]", ""))


# Words that decide a company's kind (first match wins), the
# domain endings of each kind, and the prefixes a site name may carry.
NAME_KINDS = {
    "tech": ["ai", "tech", "cyber", "data"],
    "developer": ["code", "dev", "stack", "ops"],
    "modern": ["app", "cloud", "space"],
}
DOMAIN_ENDINGS = {
    "standard": [".com"],
    "tech": [".ai", ".tech", ".io"],
    "developer": [".dev", ".io", ".sh"],
    "modern": [".app", ".so", ".xyz"],
    "regional": [".us", ".co"],
}
SITE_PREFIXES = ["", "get", "use", "try", "join"]


def name_kind(name: Column) -> Column:
    lowered = F.lower(name)
    kind = F.lit("standard")
    for label, words in reversed(NAME_KINDS.items()):
        kind = F.when(lowered.rlike("|".join(words)), F.lit(label)).otherwise(kind)
    return kind


def website_from_name(name: Column, kind: Column, style: Column, ending: Column) -> Column:
    """Build a site name from a company name.

    ``style`` 0-4 picks a prefix and 5 shortens ``technologies``; ``ending``
    picks one of the endings of the kind, wrapping around.
    """
    slug = name_slug(name)
    prefixes = F.array(*[F.lit(p) for p in SITE_PREFIXES])
    base = F.when(
        style < len(SITE_PREFIXES), F.concat(F.get(prefixes, style.cast("int")), slug)
    ).otherwise(F.replace(slug, F.lit("technologies"), F.lit("tech")))
    suffix = F.lit(None).cast("string")
    for label, endings in DOMAIN_ENDINGS.items():
        choice = F.get(F.array(*[F.lit(e) for e in endings]), F.pmod(ending, F.lit(len(endings))).cast("int"))
        suffix = F.when(kind == label, choice).otherwise(suffix)
    return F.concat(base, suffix)


# Sentence patterns of a generated company description.
DESCRIPTION_TEMPLATES = [
    "A {industry} company that provides {product_form} solutions to help {icp} with {job}.",
    "We're building the next generation of {product_form} for {industry} focused on {job}.",
    "Our {product_form} empowers {icp} in the {industry} space to streamline their {job} processes.",
    "Leading provider of {product_form} solutions for {industry} companies looking to optimize {job}.",
    "Innovative {industry} startup developing {product_form} to revolutionize how {icp} handle {job}.",
    "Enterprise-grade {product_form} designed specifically for {industry} organizations managing {job}.",
    "AI-powered {product_form} helping {icp} in {industry} automate and enhance their {job} workflows.",
]


def fill_template(template: str, slots: Mapping[str, Column]) -> Column:
    """A template with its ``{slot}`` parts replaced; what fills a slot is not searched for slots."""
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [slots[slot]] if slot else []
    return F.concat(*parts)


def describe(choice: Column, slots: Mapping[str, Column], templates: Sequence[str] = DESCRIPTION_TEMPLATES) -> Column:
    """Lower-case the slots into the template picked by ``choice`` (from 0)."""
    lowered = {k: F.lower(v) for k, v in slots.items()}
    picked = F.lit(None).cast("string")
    for number, template in enumerate(templates):
        picked = F.when(choice == number, fill_template(template, lowered)).otherwise(picked)
    return picked


def padded(prefix: str, number: Column, width: int = 5, suffix: str = "") -> Column:
    """Zero-padded number between two texts; a longer number keeps all its digits."""
    digits = number.cast("string")
    filled = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), filled, F.lit(suffix))


def labelled_lines(parts: Sequence[tuple[str, Column]]) -> Column:
    """Prompt text: one ``label: value`` line per part; a null value drops its line."""
    lines = [F.concat(F.lit(f"{label}: " if label else ""), value) for label, value in parts]
    return F.concat_ws("\n", *lines)


def features_line(features: Column) -> Column:
    """Comma-joined features, or null when there are none."""
    return F.when(F.size(features) > 0, F.array_join(features, ", "))


# Markup removed by ``html_text``, in order of application.
HTML_DROPPED = [
    r"(?is)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<head\b.*?</head\s*>",
    r"(?s)<[^>]*>",
]
HTML_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def decode_entities(text: Column) -> Column:
    for entity, char in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Readable text of a page: no markup, entities decoded, spaces collapsed."""
    for pattern in HTML_DROPPED:
        html = F.regexp_replace(html, pattern, " ")
    spaced = F.regexp_replace(decode_entities(html), r"[ \t\r\n]+", " ")
    return F.trim(spaced)


def html_element(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element, or null."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(html_text(inner), F.lit(""))


