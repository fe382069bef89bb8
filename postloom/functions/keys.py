"""Duplicate keys: what two postings must share to count as one."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import batches
from postloom.functions.text import NO_WORD, WORD, lit_array, loose

# Spellings of the levels that count as equal in a key, with a substring each
# spelling contains.  A full stop is part of the spelling only when a word follows at once.
_LEVELS = (
    ("senior", rf"sr\.(?=[{WORD}])|sr(?![{WORD}])", "sr"),
    ("junior", rf"jr\.(?=[{WORD}])|jr(?![{WORD}])", "jr"),
    ("pleno", rf"mid[- ]?level(?![{WORD}])", "mid"),
)


@lru_cache(maxsize=1)
def _fold_udf():
    return F.arrow_udf(batches.fold_lists, "array<string>")


@lru_cache(maxsize=1)
def _key_udf():
    return F.arrow_udf(batches.key_texts, "array<string>")


def _latin() -> tuple[str, str, str]:
    """Latin letters that decompose to one ASCII letter and marks, these letters, and a pattern of
    what is neither ASCII, nor such a letter, nor a Latin letter that does not decompose at all."""
    letters, bases, stable = "", "", ""
    for c in map(chr, range(0xA1, 0x250)):
        folded = unicodedata.normalize("NFKD", c)
        if folded == c:
            stable += c
        elif len(folded) > 1 and folded[0] < "\x7f" and all(map(unicodedata.combining, folded[1:])):
            letters, bases = letters + c, bases + folded[0]
    codes = "".join(rf"\x{{{ord(c):x}}}" for c in stable)
    # Nearly all characters are ASCII, which is one test; the class is one test for each of its members.
    return letters, bases, rf"(?![\x00-\x7F])[^{codes}]"


LATIN, BASES, FOREIGN = _latin()


def _plain(text: Column) -> Column:
    """Whether a text is ASCII: as many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def _foreign(text: Column) -> Column:
    return ~_plain(text) & text.rlike(FOREIGN)


def fold_latin(texts: Column) -> Column:
    """Array of texts whose accented Latin letters are replaced, inside the JVM."""
    return F.transform(texts, lambda t: F.when(_plain(t), t).otherwise(F.translate(t, LATIN, BASES)))


def fold_others(folded: Column) -> Column:
    """Array of texts of :func:`fold_latin` in compatibility form without combining marks.

    Only single texts with other characters that may decompose cross to Python; the rest crosses as
    NULL and stays as it is.  ``folded`` is mentioned often and should be a column.
    """
    crossing = F.transform(folded, lambda t: F.when(_foreign(t), t))
    other = _fold_udf()(F.when(F.exists(folded, _foreign), crossing))
    return F.coalesce(F.zip_with(other, folded, lambda a, b: F.coalesce(a, b)), folded)


def fold_accents(texts: Column) -> Column:
    """Array of texts in compatibility form without combining marks."""
    return fold_others(fold_latin(texts))


def _unifier(level: str, pattern: str, part: str):
    """Replace the spellings of a level; only texts that contain ``part`` are searched."""
    return lambda t: F.when(t.contains(part), F.regexp_replace(t, pattern, level)).otherwise(t)


def _filled(*texts: Column) -> Column:
    return F.array(*[F.coalesce(t, F.lit("")) for t in texts])


def _words(folded: Column) -> Column:
    """Lower-case words with one space between them and one spelling per level, of folded texts."""
    words = F.transform(folded, F.lower)
    for level, pattern, part in _LEVELS:
        words = F.transform(words, _unifier(level, rf"(?<![{WORD}])(?:{pattern})", part))
    return F.transform(words, lambda t: F.trim(F.regexp_replace(t, loose(NO_WORD), " ")))


def _key_texts(texts: Column) -> Column:
    """Texts without accents; those that are ASCII then, which is most, are words already.

    Searching a text once more and building it anew costs a regular expression far more than it costs to
    hand the text to Python, where ASCII is one table.  Which other characters are letters is for the
    JVM to say, as in all other patterns.
    """
    return _key_udf()(texts)


def _other_words(texts: Column) -> Column:
    """Words of :func:`_key_texts`, which is mentioned often and should be a column."""
    others = _words(F.transform(texts, lambda t: F.when(~_plain(t), t)))
    return F.when(F.exists(texts, lambda t: ~_plain(t)), F.zip_with(others, texts, lambda w, t: F.coalesce(w, t))).otherwise(texts)


def normalize_keys(*texts: Column) -> Column:
    """Array of key texts, one per input; NULL counts as ''.  All inputs share one Python call."""
    return _other_words(_key_texts(_filled(*texts)))


def normalize_key(text: Column) -> Column:
    return normalize_keys(text)[0]


def stack_text(stack: Column) -> Column:
    """Stack in case-insensitive order as one text."""
    ordered = F.array_sort(
        stack,
        lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0),
    )
    return F.array_join(F.coalesce(ordered, lit_array([])), " ")


def _digest(parts) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def with_keys(df, fingerprint: str = "fingerprint", content_hash: str = "content_hash"):
    """Add both keys of every posting; their texts are computed once for the two."""
    texts = _filled(
        *[F.col(c) for c in ("title", "company", "location", "seniority")],
        stack_text(F.col("stack")),
        F.col("description"),
    )
    key_parts = F.col("__key_parts")
    return (
        df.withColumn("__key_texts", _key_texts(texts))
        .withColumn("__key_parts", _other_words(F.col("__key_texts")))
        .withColumns(
            {
                fingerprint: _digest([key_parts[i] for i in range(4)]),
                content_hash: _digest([key_parts[i] for i in (0, 1, 2, 4, 5)]),
            }
        )
        .drop("__key_texts", "__key_parts")
    )
