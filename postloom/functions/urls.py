"""URL clean-up with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.text import bound, lit_array, strip, title_case

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^//([^/?#]*)"


def _clean(url: Column) -> Column:
    return F.regexp_replace(strip(url), r"[\t\r\n]", "")


def split_url(url: Column) -> tuple[Column, Column, Column, Column]:
    """(scheme, host part, path, query) of a clean URL; the fragment is left out."""
    rest = F.regexp_replace(url, _SCHEME, "")
    return (
        F.lower(F.regexp_extract(url, _SCHEME, 1)),
        F.regexp_extract(rest, _NETLOC, 1),
        F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    )


def _decode(text: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    # The built-in leaves "*" and escapes "~"; the wanted form is the other way round.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    """Query without tracking keys, blank values and valueless names; order is kept."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.filter(decoded, lambda p: ~F.array_contains(lit_array(v.TRACKING_PARAMETERS), p["key"]))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&"
    )


def _parts(url: Column) -> Column:
    scheme, netloc, path, query = split_url(url)
    return F.struct(
        scheme.alias("scheme"),
        F.lower(netloc).alias("host"),
        F.regexp_replace(path, ";[^/]*$", "").alias("path"),
        query.alias("query"),
    )


def canonicalize_url(url: Column) -> Column:
    """One spelling per page: lower-case scheme and host, no trailing slash, no ";parameters", no
    fragment, no tracking keys."""

    def build(p: Column) -> Column:
        short = F.regexp_replace(p["path"], "/+$", "")
        path = F.coalesce(F.nullif(short, F.lit("")), p["path"])
        query = F.when(p["query"].contains("="), _clean_query(p["query"])).otherwise("")
        rootless = (p["host"] != "") & (p["path"] != "") & ~p["path"].startswith("/")
        return F.concat(
            F.when(p["scheme"] == "", "").otherwise(F.concat(p["scheme"], F.lit(":"))),
            F.when(p["host"] == "", "").otherwise(F.concat(F.lit("//"), p["host"])),
            F.when(rootless, "/").otherwise(""),
            path,
            bound(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
        )

    return bound(bound(_clean(url), _parts), build)


def is_absolute_http(url: Column) -> Column:
    scheme, netloc, _, _ = split_url(_clean(url))
    return scheme.isin("http", "https") & (netloc != "")


def _without_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments,
        lit_array([]),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(s))),
    )
    ends_in_dot = path.rlike(r"/\.\.?$")
    return F.concat(F.array_join(folded, "/"), F.when(ends_in_dot, "/").otherwise(""))


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL, read on the page ``base``."""
    scheme, netloc, path, query = split_url(base)
    origin = F.concat(scheme, F.lit("://"), netloc)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    with_query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))

    def joined(target: Column) -> Column:
        tail = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
        bare = F.regexp_extract(target, r"^([^?#]*)", 1)
        dotted = bare.rlike(r"/\.\.?(/|$)")
        return F.concat(origin, F.when(dotted, _without_dot_segments(bare)).otherwise(bare), tail)

    def resolved(link: Column) -> Column:
        return (
            F.when(link == "", base)
            .when(link.rlike(_SCHEME), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("#"), F.concat(origin, path, with_query, link))
            .when(link.startswith("?"), F.concat(origin, path, link))
            .when(link.startswith("/"), joined(link))
            .otherwise(bound(F.concat(folder, link), joined))
        )

    return bound(_clean(href), resolved)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def view_id(url: Column) -> Column:
    """Number in ".../jobs/view/<number>", NULL without one."""
    return F.nullif(F.regexp_extract(url, r"/jobs/view/([0-9]+)", 1), F.lit(""))


def title_from_url(url: Column) -> Column:
    slug = F.regexp_replace(last_segment(url), "^[0-9]+-", "")
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


def redact_url(url: Column) -> Column:
    """Hide the password of a URL that carries a login; other URLs stay as they are."""
    scheme, netloc, _, _ = split_url(_clean(url))
    login = F.regexp_extract(netloc, "^(.*)@", 1)
    user = F.regexp_extract(login, "^([^:]*)", 1)
    host = F.lower(F.regexp_extract(netloc, "([^@]*)$", 1))
    tail = F.regexp_extract(url, r"^[^:]*://[^/?#]*(.*)$", 1)
    return F.when(
        login != "",
        F.concat(
            scheme,
            F.lit("://"),
            F.when(user == "", "***").otherwise(user),
            F.lit(":***@"),
            host,
            tail,
        ),
    ).otherwise(url)
