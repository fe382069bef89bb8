"""Features read from free text: seniority, salary, contract, work model, place, issue fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.text import (
    SPACE,
    WORD,
    bound,
    has_word,
    lit_rows,
    normalize_text,
    signs_of,
    spellings_in,
    strip,
    text_or_null,
)
from postloom.profile import squeeze

SENIORITY_SPELLINGS = sorted({squeeze(k) for group in v.SENIORITY_KEYWORDS.values() for k in group})


def seniority_in(text: Column, found: Column, spellings: list[str]) -> Column:
    """Level of the keyword that comes first in ``text`` among the ones shown by ``found``."""
    keywords = [
        {"word": word, "rank": rank, "level": level, "signs": signs_of([word], spellings)}
        for rank, (level, words) in enumerate(v.SENIORITY_KEYWORDS.items())
        for word in words
    ]
    shown = F.filter(lit_rows(keywords), lambda k: F.arrays_overlap(found, k["signs"]))
    places = F.transform(
        shown,
        lambda k: F.struct(
            F.position(k["word"], text).alias("at"), k["rank"].alias("rank"), k["level"].alias("level")
        ),
    )
    return F.when(F.size(found) > 0, F.array_min(places)["level"])


def estimate_seniority(text: Column) -> Column:
    """Level whose keyword is first in ``text`` (from ``joined``); ties go to the lower level."""

    def in_text(t: Column) -> Column:
        found = spellings_in(t, SENIORITY_SPELLINGS)
        return bound(found, lambda f: seniority_in(t, f, SENIORITY_SPELLINGS))

    return bound(text, in_text)


def seniority_by_priority(text: Column) -> Column:
    """Junior words beat mid-level words, which beat senior words, wherever they stand."""
    return bound(F.lower(text), lambda t: _first_match(t, v.SENIORITY_PRIORITY))


def _first_match(text: Column, words_of: dict[str, tuple[str, ...]]) -> Column:
    """Name of the first group with a word in ``text``."""
    return F.coalesce(*[F.when(has_word(text, words), name) for name, words in words_of.items()])


# --- salary -----------------------------------------------------------------------------------


def parse_number(raw: Column) -> Column:
    """"10.000,50" and "10,5" style numbers; below 100 means thousands; NULL if not a number."""
    plain = (
        F.when(
            raw.contains(",") & raw.contains("."),
            F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        )
        .otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    )
    scaled = bound(
        plain.try_cast("decimal(38,10)"), lambda n: F.when(n < 100, n * 1000).otherwise(n)
    )
    return F.bround(scaled, 2).try_cast("decimal(28,2)")


def parse_currency(text: Column) -> Column:
    return bound(
        F.lower(text),
        lambda low: F.when(low.contains("usd") | low.contains("us$"), "USD")
        .when(low.contains("brl") | low.contains("r$"), "BRL")
        .when(low.contains("$"), "USD"),
    )


def parse_salary(text: Column) -> Column:
    """STRUCT of the smallest and largest number of three or more characters, and the currency.

    Without any number all three fields are NULL.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0123456789][0123456789.,]{2,}"), F.lit(0))
    return bound(
        F.array_compact(F.transform(runs, parse_number)),
        lambda n: F.struct(
            F.array_min(n).alias("salary_min"),
            F.array_max(n).alias("salary_max"),
            F.when(F.size(n) > 0, parse_currency(text)).alias("salary_currency"),
        ),
    )


# --- contract and place --------------------------------------------------------------------------


def parse_contract_type(*texts: Column) -> Column:
    return contract_in(F.lower(F.concat_ws(" ", *texts)))


def contract_in(text: Column) -> Column:
    """The same from a text that is lower-cased already."""
    return bound(text, lambda t: _first_match(t, v.CONTRACT_WORDS))


def _place_text(location: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", location, description))


def parse_remote_type(location: Column, description: Column) -> Column:
    return bound(_place_text(location, description), lambda t: _first_match(t, v.REMOTE_WORDS))


def _country(text: Column, location: Column) -> Column:
    last_part = strip(F.element_at(F.split(location, ","), -1))
    return F.when(has_word(text, v.HOME_COUNTRY_WORDS), v.HOME_COUNTRY).when(
        location.contains(","), F.nullif(last_part, F.lit(""))
    )


def parse_country(location: Column, description: Column) -> Column:
    return bound(_place_text(location, description), lambda t: _country(t, location))


def parse_city(location: Column) -> Column:
    first = strip(F.split(location, "[,/|-]", 2)[0])
    return F.when(
        (first != "") & ~F.lower(first).isin(*v.NOT_A_CITY), F.substring(first, 1, 120)
    )


def normalize_location(location: Column, remote_type: Column) -> Column:
    from_type = F.coalesce(*[F.when(remote_type == k, x) for k, x in v.REMOTE_LABELS.items()])
    return F.coalesce(text_or_null(location), from_type)


def parse_location(location: Column, description: Column) -> Column:
    """STRUCT of work model, country, city and normalised place; the text is read once."""
    return location_in(location, _place_text(location, description))


def location_in(location: Column, place_text: Column) -> Column:
    """The same from the text of both, which is lower-cased already."""

    def place(found: Column) -> Column:
        return F.struct(
            found["remote_type"].alias("remote_type"),
            found["country"].alias("country"),
            parse_city(location).alias("city"),
            normalize_location(location, found["remote_type"]).alias("normalized_location"),
        )

    def found(text: Column) -> Column:
        return F.struct(
            _first_match(text, v.REMOTE_WORDS).alias("remote_type"),
            _country(text, location).alias("country"),
        )

    return bound(bound(place_text, found), place)


# --- fields written into the text of an issue or page ------------------------------------------------


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)


def _line_value(text: Column, pattern: str, group: int = 1) -> Column:
    return F.substring(text_or_null(_captured(text, "(?imd)" + pattern, group)), 1, 200)


_S = f"[{SPACE}]"
# How issues state their company and place.
_TITLE_COMPANY = rf"@{_S}*([^\])|/\-][{WORD}À-ÿ .,&+\-]{{2,80}})"
_BODY_COMPANY = (
    rf"^{_S}*(?:empresa|company){_S}*[:\-]{_S}*(.+)$",
    rf"^{_S}*##{_S}*(?:empresa|company){_S}*${_S}*(.+)$",
)
_TITLE_PLACE = r"\[([^\]]+)\]"
_BODY_PLACE = rf"^{_S}*(?:local|localização|localizacao|location){_S}*[:\-]{_S}*(.+)$"
_BODY_REMOTE = rf"^{_S}*(?:remoto|remote)(?![{WORD}]).*$"


def company_from_issue(title: Column, body: Column) -> Column:
    in_title = strip(_captured(title, _TITLE_COMPANY))
    return F.coalesce(
        F.when(title.rlike(_TITLE_COMPANY), in_title),
        *[_line_value(body, p) for p in _BODY_COMPANY],
    )


def location_from_issue(title: Column, body: Column, labels: Column) -> Column:
    bracket = F.substring(strip(_captured(title, _TITLE_PLACE)), 1, 200)
    low = F.lower(labels)
    return F.when(title.rlike(_TITLE_PLACE), bracket).otherwise(
        F.coalesce(
            _line_value(body, _BODY_PLACE),
            _line_value(body, _BODY_REMOTE, 0),
            F.when(low.contains("remoto") | low.contains("remote"), "Remoto"),
        )
    )


def labelled_field(text: Column, labels) -> Column:
    """Value after "Label:" for the first label that has one, up to a pipe, bullet or line end."""
    values = []
    for label in labels:
        pattern = rf"(?iu){label}{_S}*:{_S}*([^|•\n\r]{{2,200}})"
        # A match counts even when only blanks follow the colon; it then yields ''.
        value = F.substring(normalize_text(_captured(text, pattern)), 1, 200)
        values.append(F.when(text.rlike(pattern), value))
    return F.coalesce(*values)
