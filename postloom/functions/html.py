"""Text, links and elements of HTML pages."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions import batches
from postloom.functions.text import lit_array, normalize_text
from postloom.functions.urls import canonicalize_url, resolve_url

# Comments, code blocks with their content, then single tags; the leftmost construct wins.
_CODE = (
    r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
)
_TAG = r"""<[a-zA-Z/!?](?:[^"'>]+|"[^"]*"|'[^']*')*>"""
_MARKUP = f"(?is){_CODE}|{_TAG}"
_ANCHOR = rf"""(?is)<a\s(?:[^"'>]+|"[^"]*"|'[^']*')*>.*?</a\s*>"""
_HREF = r"""(?is)^<a(?:\s(?:[^"'>]+|"[^"]*"|'[^']*')*?)?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

# The references met on most pages.
_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "#39": "'", "#x27": "'", "nbsp": "\xa0", "copy": "©",
    "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»",
}
_RARE = f"&(?!(?:amp|{'|'.join(_NAMED)});)[#A-Za-z]"


def _unescape_common(text: Column) -> Column:
    for name, char in _NAMED.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))  # last, so that nothing is read twice


@lru_cache(maxsize=1)
def _unescape_udf():
    return F.arrow_udf(batches.unescape_texts, "string")


def unescape(text: Column) -> Column:
    """Resolve character references.

    The common ones are replaced inside the JVM; only texts with other references are sent to
    Python (the rest crosses as NULL), where the full HTML 5 table is at hand.
    """
    rare = text.rlike(_RARE)
    return F.coalesce(_unescape_udf()(F.when(rare, text)), _unescape_common(text))


def visible_text(page: Column) -> Column:
    """White-space-normalised text of a page without code, comments and tags."""
    return normalize_text(unescape(F.regexp_replace(page, _MARKUP, " ")))


def is_blocked(page: Column) -> Column:
    """Login walls and challenge pages."""
    low = F.lower(page)
    hits = [low.contains(marker) for marker in v.BLOCK_MARKERS]
    return F.coalesce(*[F.when(h, True) for h in hits], F.lit(False))


def listing_links(page: Column, base: Column, marker: str = v.LISTING_PATH_MARKER) -> Column:
    """Absolute canonical links of a page in order of first occurrence, each once.

    Works inside the row (the page is the bound), so no shuffle is needed.
    """
    markup = F.regexp_replace(page, f"(?is){_CODE}", " ")
    anchors = F.regexp_extract_all(markup, F.lit(f"({_ANCHOR})"), F.lit(1))
    pairs = F.transform(
        anchors,
        lambda a: F.struct(
            _unescape_common(
                F.concat(*[F.coalesce(F.regexp_extract(a, _HREF, g), F.lit("")) for g in (1, 2, 3)])
            ).alias("href"),
            normalize_text(_unescape_common(F.regexp_replace(a, _MARKUP, " "))).alias("label"),
        ),
    )
    named = F.filter(
        pairs, lambda p: p["href"].contains(marker) & (F.length(p["label"]) >= v.MIN_ANCHOR_TEXT)
    )
    links = F.transform(named, lambda p: canonicalize_url(resolve_url(p["href"], base)))
    return F.array_distinct(F.filter(links, lambda x: x.contains(marker)))


def _elements_udf(firsts: dict, alls: dict):
    fields = [f"{n} string" for n in firsts] + [f"{n} array<string>" for n in alls]
    schema = ", ".join([*fields, "text string", "lines string"])
    # Not deterministic in name only: otherwise a filter on the result is pushed below it, with a
    # copy of the call, and every page is parsed twice.
    return F.arrow_udf(batches.read_pages(firsts, alls), schema).asNondeterministic()


# Where listing cards and detail pages keep their parts.
CARD_FIRSTS = {
    "title_1": [{"token": "base-search-card__title"}],
    "title_2": [{"tag": "h3"}],
    "title_3": [{"attr": "data-test-job-title"}],
    "company_1": [{"token": "base-search-card__subtitle"}],
    "company_2": [{"tag": "h4"}],
    "company_3": [{"attr": "data-test-company-name"}],
    "location_1": [{"token": "job-search-card__location"}],
    "location_2": [{"attr": "data-test-job-location"}],
    "href": [
        {"tag": "a", "token": "base-card__full-link", "get": "href"},
        {"tag": "a", "has": ("href", "/jobs/view/"), "get": "href"},
    ],
    "published": [{"tag": "time", "get": "datetime"}],
}
PAGE_FIRSTS = {
    "h1": [{"tag": "h1"}],
    "h2": [{"tag": "h2"}],
    "image_alt": [{"tag": "img", "attr": "alt", "filled": True, "get": "alt"}],
}
PAGE_ALLS = {
    "chips": [
        {"token": "tag"},
        {"token": "badge"},
        {"token": "label"},
        {"part": "tag"},
        {"part": "skill"},
        {"part": "technology"},
        {"tag": "li"},
    ]
}


CARD_BOXES = [{"tag": "div", "token": "base-search-card"}]
CARD_LISTS = [{"tag": "ul", "token": "jobs-search__results-list"}]


def card_list(page: Column) -> Column:
    """Elements of every card of a page, one struct per card."""
    fields = ", ".join(f"{n}: string" for n in (*CARD_FIRSTS, "text", "lines"))
    reader = batches.read_card_list(CARD_FIRSTS, CARD_BOXES, CARD_LISTS)
    return F.arrow_udf(reader, f"array<struct<{fields}>>").asNondeterministic()(page)


def page_elements(page: Column) -> Column:
    return _elements_udf(PAGE_FIRSTS, PAGE_ALLS)(page)


def first_of(*candidates: Column) -> Column:
    """First candidate with a non-empty normalised text."""
    return F.coalesce(*[F.nullif(normalize_text(c), F.lit("")) for c in candidates])


def chip_stack(chips: Column, terms) -> Column:
    """Technologies named by short elements, in document order."""
    from postloom.functions.text import detect_stack

    short = F.filter(F.transform(chips, normalize_text), lambda c: (c != "") & (F.length(c) <= 30))
    named = F.transform(short, lambda c: detect_stack(F.lower(c), terms))
    return F.array_distinct(F.coalesce(F.flatten(named), lit_array([])))
