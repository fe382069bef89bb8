"""Posting assembly and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.features import SENIORITY_SPELLINGS, seniority_in
from postloom.functions.text import (
    normalize_stack,
    spellings_in,
    strip,
    techs_in,
    text_or_null,
)
from postloom.functions.urls import canonicalize_url, is_absolute_http, redact_url
from postloom.profile import TermDictionary
from postloom.schema import REQUIRED_TEXTS, TEXT_LIMITS, with_posting_columns


def safe_datetime(text: Column) -> Column:
    """ISO-8601 text as a timestamp in the session time zone; NULL when it is not one."""
    value = strip(text)
    compact = (("yyyyMMdd'T'HHmmss[.SSSSSS][XXX][X]", r"^[0-9]{8}T[0-9]{6}"), ("yyyyMMdd", r"^[0-9]{8}$"))
    extended = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?)?)?$"
    return F.coalesce(
        F.when(value.rlike(extended), F.try_to_timestamp(value)),
        *[F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(f))) for f, shape in compact],
    )


def build_postings(df: DataFrame, terms: TermDictionary | None = None) -> DataFrame:
    """Assemble postings from what a reader found.

    Texts are normalised, the link becomes canonical, and stack and seniority are read from title,
    description and ``extra_text`` unless they were given (an empty stack counts as not given).
    """
    terms = terms or TermDictionary.stack()
    df = with_posting_columns(df)
    if "extra_text" not in df.columns:
        df = df.withColumn("extra_text", F.lit(None).cast("string"))
    text, found = F.col("__text"), F.col("__found")
    spellings = sorted({*terms.spellings(), *SENIORITY_SPELLINGS})  # one scan finds both
    given = F.size(F.coalesce(F.col("stack"), F.array().cast("array<string>"))) > 0
    # Every text is normalised once; what is searched is put together from the normalised ones.
    names = ("title", "description", "extra_text")
    return (
        df.withColumns({n: text_or_null(F.col(n)) for n in (*names, "company", "location")})
        .withColumn("__text", F.lower(F.concat_ws(" ", *names)))
        .withColumn("__found", spellings_in(text, spellings))
        .withColumns(
            {
                "title": F.coalesce("title", F.lit("")),
                "stack": F.when(given, F.col("stack")).otherwise(
                    techs_in(found, terms, spellings)
                ),
                "seniority": F.coalesce(
                    F.nullif(F.col("seniority"), F.lit("")), seniority_in(text, found, spellings)
                ),
                "link": canonicalize_url(F.col("link")),
                "raw_payload": F.coalesce(
                    F.col("raw_payload"), F.create_map().cast("map<string,string>")
                ),
            }
        )
        .drop("__text", "__found", "extra_text")
    )


def posting_errors() -> Column:
    """Array with the name of every rule a posting breaks (lengths are taken after trimming)."""
    rules = []
    for name, (low, high) in TEXT_LIMITS.items():
        length = F.length(strip(F.col(name)))
        if name in REQUIRED_TEXTS:
            rules.append((F.col(name).isNull(), f"{name} missing"))
        if low:
            rules.append((length < low, f"{name} too short"))
        rules.append((length > high, f"{name} too long"))
    rules.append((~is_absolute_http(F.col("link")), "link is not an absolute http url"))
    return F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for broken, rule in rules]))


def validate_postings(df: DataFrame) -> DataFrame:
    """Trim all texts, tidy the stack and add ``errors``; nothing is dropped here."""
    df = with_posting_columns(df)
    trimmed = {n: strip(F.col(n)) for n in (*TEXT_LIMITS, "description")}
    return df.withColumns({**trimmed, "stack": normalize_stack(F.col("stack"))}).withColumn(
        "errors", posting_errors()
    )


def with_errors(df: DataFrame) -> DataFrame:
    """Validated postings with ``errors`` and ``valid``; to be written once where both kinds are used."""
    return validate_postings(df).withColumn("valid", F.size("errors") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid postings, rejected postings with their ``errors``)."""
    checked = with_errors(df)
    return checked.filter("valid").drop("valid", "errors"), checked.filter("not valid").drop("valid")


def redact_columns(df: DataFrame) -> DataFrame:
    """Mask the columns whose name speaks of a secret; URLs keep all but their password."""
    masked = {}
    for name in df.columns:
        if not any(word in name.lower() for word in v.SECRET_NAME_WORDS):
            continue
        value = F.col(name).cast("string")
        is_url = name.lower().endswith("_url")
        hidden = redact_url(value) if is_url else F.lit(v.REDACTED)
        masked[name] = F.when(value.isNull() | (value == ""), value).otherwise(hidden)
    return df.withColumns(masked) if masked else df
