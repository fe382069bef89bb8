"""Whitespace, whole-term matching and escaping.

The character classes are spelled out because engines disagree on ``\\w`` and ``\\s``: a word
character is a Unicode letter, number or underscore, and a space is any Unicode white space.
"""

from __future__ import annotations

import re
from itertools import groupby
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.profile import TermDictionary, squeeze

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"


def _codes(chars) -> str:
    """Characters for a pattern, one by one: a class keeps these in a table, ranges are compared in turn."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars)


def _beyond(known, others: str) -> str:
    """A class of ``others`` that rules out the ``known`` ASCII characters, most of a text, by one look-up."""
    return f"[[^{_codes(known)}]&&[{others}]]"


def loose(gap: str) -> str:
    """Runs of the class ``gap`` that are not one blank: what must change where runs become one blank."""
    return f"{gap}(?:(?<! )|{gap}){gap}*"


_LETTERS = ascii_letters + digits + "_"
# White space, and what is no word character.
_GAP = _beyond(map(chr, range(0x21, 0x7F)), SPACE)
NO_WORD = _beyond(_LETTERS, f"^{WORD}")
_LOOSE = loose(_GAP)
# A term may not touch these, so that "C++", "C#" and "node.js" do not match by their parts.
NOT_BEFORE = rf"(?<![{WORD}+#.])"
NOT_AFTER = rf"(?![{WORD}+#.])"
# The same as a character before a term.  Letters beyond the basic plane may stand there: a look-behind sees half of them.
_EDGE = _beyond(_LETTERS + "+#.", rf"[^{WORD}+#.]\x{{10000}}-\x{{10ffff}}")
# Without them.
NO_TERM = _beyond(_LETTERS + "+#.", f"^{WORD}+#.")


def _literal(value) -> str:
    """A Python value as Spark SQL text."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_literal(x)}" for k, x in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(_literal(x) for x in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lit_rows(rows: list[dict]) -> Column:
    """A small table (dictionary entries, rules) as one constant array of structs."""
    return F.expr(_literal(rows))


def lit_array(values) -> Column:
    return F.expr(_literal(list(values)) if values else "cast(array() as array<string>)")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Written out, an expression over a long text would be evaluated once per mention: mentions
    inside conditions and lambdas are not shared by the optimizer.  As the variable of a
    one-element ``transform`` it is computed first and then only referred to.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _LOOSE, " "))


def normalized(text: Column) -> Column:
    """:func:`normalize_text` of a text that mostly is normalised already: it is only searched, not built anew."""

    def tidy(t: Column) -> Column:
        untidy = t.startswith(" ") | t.endswith(" ") | t.rlike(_LOOSE)
        return F.when(untidy, normalize_text(t)).otherwise(t)

    return bound(F.coalesce(text, F.lit("")), tidy)


def text_or_null(text: Column) -> Column:
    return F.nullif(normalize_text(text), F.lit(""))


def joined(*texts: Column) -> Column:
    """Lower-cased, normalised texts in one string; NULLs are skipped."""
    return F.lower(normalize_text(F.concat_ws(" ", *texts)))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters ("rest api-x" -> "Rest Api-X")."""
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    runs = F.regexp_extract_all(text, F.lit(rf"({cased}+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first spelling of every item, in order."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def normalize_stack(items: Column) -> Column:
    """Trimmed, without blanks, case-insensitively unique; NULL becomes an empty array."""
    trimmed = F.transform(F.coalesce(items, lit_array([])), strip)
    return distinct_ignoring_case(F.filter(trimmed, lambda x: x != ""))


def term_pattern(term: str) -> str:
    """Whole-term pattern; a space in the term matches any white space."""
    words = rf"[{SPACE}]+".join(re.escape(w) for w in squeeze(term).split(" "))
    return f"(?iu){NOT_BEFORE}{words}{NOT_AFTER}"


def contains_term(text: Column, term: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(term_pattern(term))


def has_word(text: Column, words) -> Column:
    """Any of ``words`` between word boundaries, in text that is lower-cased already.

    Plain substring tests go first: they are many times cheaper than the pattern and settle most
    texts.  ``text`` is mentioned often, so long texts should come :func:`bound`.
    """
    either = "|".join(re.escape(w) for w in words)
    maybe = F.lit(False)
    for word in words:
        maybe = maybe | text.contains(word)
    letters = "".join(sorted({re.escape(word[0]) for word in words}))  # cheapest test first
    return maybe & text.rlike(rf"(?=[{letters}])(?<![{WORD}])(?:{either})(?![{WORD}])")


def spellings_in(text: Column, spellings: list[str], edge: str = _EDGE) -> Column:
    """Distinct spellings found as whole terms in ``text`` (from :func:`joined`), in ONE pass.

    A match is the character before a spelling, which itself is only looked at, so spellings inside longer
    spellings are still seen at their own start ("rest" in "django rest framework").  Of several spellings starting at one
    place the longest is reported; :func:`_reports` knows which shorter ones it implies.  ``edge``: class of the
    characters that may stand before a spelling.
    """
    longest_first = sorted(spellings, key=lambda s: (s[0], -len(s), s))
    by_letter = [
        re.escape(letter) + "(?:" + "|".join(re.escape(s[1:]) for s in group) + ")"
        for letter, group in groupby(longest_first, key=lambda s: s[0])
    ]
    letters = "".join(sorted({re.escape(s[0]) for s in spellings}))  # cheapest test first
    pattern = f"{edge}(?=[{letters}])(?=({'|'.join(by_letter)}){NOT_AFTER})"
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(pattern), F.lit(1)))


def _reports(spelling: str, spellings: list[str]) -> list[str]:
    """Reported spellings whose match means that ``spelling`` matches at the same place too."""
    whole = re.compile(rf"{re.escape(spelling)}(?![\w+#.])")
    return [s for s in spellings if whole.match(s)]


def signs_of(wanted, spellings: list[str]) -> list[str]:
    """Reported spellings that show any of the ``wanted`` ones."""
    return sorted({r for w in wanted for r in _reports(squeeze(w), spellings)})


def found_in(found: Column, wanted, spellings: list[str]) -> Column:
    """Does ``found`` (of :func:`spellings_in`) show any of the ``wanted`` spellings?"""
    return F.arrays_overlap(found, lit_array(signs_of(wanted, spellings)))


def techs_by_name(terms: TermDictionary) -> list[tuple[str, str]]:
    """(name, entry), ordered by entry; of entries with one name (ignoring case) only the first."""
    first: dict[str, tuple[str, str]] = {}
    for entry in sorted(terms.entries):
        name = terms.name(entry)
        first.setdefault(name.lower(), (name, entry))
    return list(first.values())


def techs_in(found: Column, terms: TermDictionary, spellings: list[str]) -> Column:
    """Display names of the dictionary entries shown by ``found``, ordered by canonical name."""
    table = lit_rows(
        [
            {"name": name, "signs": signs_of(terms.entries[entry], spellings)}
            for name, entry in techs_by_name(terms)
        ]
    )
    shown = F.filter(table, lambda e: F.arrays_overlap(found, e["signs"]))
    return F.when(F.size(found) == 0, lit_array([])).otherwise(F.transform(shown, lambda e: e["name"]))


def detect_stack(text: Column, terms: TermDictionary) -> Column:
    """Technologies named in ``text`` (from :func:`joined`)."""
    spellings = terms.spellings()
    return bound(spellings_in(text, spellings), lambda f: techs_in(f, terms, spellings))


def html_escape(text: Column) -> Column:
    escaped = text
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped
