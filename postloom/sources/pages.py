"""Listing cards and detail pages, stored as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.features import (
    estimate_seniority,
    labelled_field,
    parse_contract_type,
    parse_location,
    parse_salary,
    seniority_by_priority,
)
from postloom.functions.html import card_list, chip_stack, first_of, is_blocked, page_elements
from postloom.functions.text import joined, normalize_text
from postloom.functions.urls import last_segment, title_from_url, view_id
from postloom.operators.postings import build_postings, safe_datetime
from postloom.profile import TermDictionary
from postloom.schema import CARRIED

# Labels a detail page writes before its fields.
PLACE_LABELS = ("Localização", "Localizacao", "Local")
COMPANY_LABELS = ("Empresa", "Company")
NO_TITLES = ("vagas",)


def flag_blocked(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``blocked``: login and challenge pages, looked for once per page."""
    return pages.withColumn("blocked", is_blocked(F.col(html)))


def split_blocked(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages to read, quarantine of login and challenge pages); write ``flag_blocked`` once where
    both are used."""
    flagged = pages if "blocked" in pages.columns else flag_blocked(pages, html)
    return flagged.filter(~F.col("blocked")).drop("blocked"), flagged.filter("blocked").drop("blocked")


def published_within(postings: DataFrame, as_of, seconds: int = 86_400) -> DataFrame:
    """Postings published in the last ``seconds`` before ``as_of`` (one day for card searches)."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    return postings.filter(F.col("published_at") >= since)


def card_postings(cards: DataFrame, source: str = "cards", html: str = "html") -> DataFrame:
    """Postings of all listing cards of result pages; a card without title or link gives none."""
    e = F.col("__e")
    rest = [c for c in CARRIED if c in cards.columns]
    each = cards.select(*rest, F.posexplode(card_list(F.col(html))).alias("__row", "__e"))
    if "landed_file" in rest and "landed_row" not in rest:
        each = each.withColumn("landed_row", F.col("__row").cast("bigint"))
        rest = [*rest, "landed_row"]
    found = each.select(
        *rest,
        first_of(e["title_1"], e["title_2"], e["title_3"]).alias("title"),
        first_of(e["company_1"], e["company_2"], e["company_3"]).alias("company"),
        first_of(e["location_1"], e["location_2"]).alias("location"),
        F.nullif(e["href"], F.lit("")).alias("link"),
        safe_datetime(e["published"]).alias("published_at"),
        normalize_text(e["text"]).alias("description"),
    ).filter(F.col("title").isNotNull() & F.col("link").isNotNull())
    return build_postings(
        found.withColumns(
            {
                "external_id": view_id(F.col("link")),
                "source": F.lit(source),
                "raw_payload": F.create_map(F.lit("parser"), F.lit("card")),
            }
        )
    )


def company_from_page(
    image_alt: Column, full_text: Column, lines: Column, site: str = "", use_labels: bool = False
) -> Column:
    """Logo text, else the labelled field, else the second line after one starting "vaga"."""
    alt = normalize_text(image_alt)
    usable = F.length(alt).between(2, 80)
    if site:
        usable = usable & ~F.lower(alt).contains(site.lower())
    rows = F.filter(
        F.transform(F.split(lines, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), normalize_text),
        lambda line: line != "",
    )

    def after_heading(rows: Column) -> Column:
        picks = F.transform(rows, lambda line, i: F.when(F.lower(line).startswith("vaga"), F.get(rows, i + 2)))
        return F.get(F.filter(picks, lambda p: F.length(p).between(2, 80)), F.lit(0))

    from_lines = F.element_at(F.transform(F.array(rows), after_heading), 1)
    labelled = F.nullif(labelled_field(full_text, COMPANY_LABELS), F.lit("")) if use_labels else F.lit(None)
    return F.coalesce(F.when(usable, alt), labelled.cast("string"), from_lines)


def detail_postings(
    pages: DataFrame, source: str = "details", site: str = "", use_labels: bool = False,
    html: str = "html", link: str = "link",
) -> DataFrame:
    """Postings of detail pages with salary, contract and place read from the page text.

    ``use_labels`` also reads "Localização:" and "Empresa:" fields; it is off by default because
    the results to be matched do not contain them.
    """
    terms = TermDictionary.stack()
    e, text = F.col("__e"), F.col("description")
    rest = [c for c in CARRIED if c in pages.columns]
    titled = (
        pages.withColumn("__e", page_elements(F.col(html)))
        .select(
            *rest,
            F.col(link).alias("link"),
            "__e",
            normalize_text(e["text"]).alias("description"),
            F.coalesce(first_of(e["h1"], e["h2"]), title_from_url(F.col(link))).alias("title"),
        )
        .filter((F.col("title") != "") & ~F.lower("title").isin(*NO_TITLES, site.lower()))
    )
    place = labelled_field(text, PLACE_LABELS) if use_labels else F.lit(None).cast("string")
    found = titled.withColumn("location", place).withColumns(
        {
            "__salary": parse_salary(text),
            "__place": parse_location(F.col("location"), text),
            "company": company_from_page(e["image_alt"], text, e["lines"], site, use_labels),
            "stack": chip_stack(e["chips"], terms),
            "seniority": F.coalesce(
                seniority_by_priority(text), estimate_seniority(joined(F.col("title"), text))
            ),
            "contract_type": parse_contract_type(text),
            "external_id": last_segment(F.col("link")),
            "source": F.lit(source),
            "raw_payload": F.create_map(F.lit("html_parser"), F.lit("detail")),
        }
    )
    fields = {n: F.col("__place")[n] for n in ("remote_type", "country", "city")}
    money = {n: F.col("__salary")[n].try_cast("decimal(12,2)") for n in ("salary_min", "salary_max")}
    currency = {"salary_currency": F.col("__salary")["salary_currency"]}
    return build_postings(found.withColumns({**fields, **money, **currency}).drop("__e", "__salary", "__place"))


# Where a page names its own address.
_CANONICAL = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>""",
    r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url["']?[^>]*>""",
)
_ADDRESS = (r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)\bcontent\s*=\s*["']?([^"'\s>]+)""")


def own_link(html: Column) -> Column:
    """The address a page gives for itself: its canonical link, else its og:url; else NULL."""
    found = [
        F.nullif(F.regexp_extract(F.regexp_extract(html, tag, 0), value, 1), F.lit(""))
        for tag, value in zip(_CANONICAL, _ADDRESS)
    ]
    return F.coalesce(*found)


def read_html(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(link, html, landed_file) of stored pages: parquet with link and html, or a folder of files.

    Of a file, the link is the one ``manifest`` (file, link; file by its name) gives, else the one the
    page names itself, else the path of the file, which validation then rejects.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("landed_file"), F.col("value").alias("html")
    )
    link = F.coalesce(own_link(F.col("html")), F.col("landed_file"))
    if manifest is not None:
        known = manifest.select(F.col("file").alias("__file"), F.col("link").alias("__link"))
        files = files.join(known, F.element_at(F.split("landed_file", "/"), -1) == F.col("__file"), "left")
        link = F.coalesce("__link", link)
    return files.select(link.alias("link"), "html", "landed_file")


def read_cards(
    spark: SparkSession, path: str, source: str = "cards", as_of=None, seconds: int = 86_400
) -> DataFrame:
    """Postings of all cards of the stored result pages, with ``as_of`` only the recent ones.

    A page that says a block marker is a wall only where it holds no card; walls yield one row
    without title and link each, so that validation counts and keeps them as rejects.
    """
    pages = read_html(spark, path)
    cards = card_postings(pages, source)
    if as_of is not None:
        cards = published_within(cards, as_of, seconds)
    held = F.forall(card_list(F.col("html")), lambda c: c["href"].isNull())
    walls = flag_blocked(pages).filter("blocked").filter(held)
    place = [c for c in ("landed_file",) if c in pages.columns]
    blocked = walls.select(
        *place, F.lit("").alias("title"), F.lit(source).alias("source"),
        F.create_map(F.lit("parser"), F.lit("blocked page")).alias("raw_payload"),
        F.lit(None).cast("string").alias("link"),
    )
    return cards.unionByName(build_postings(blocked), allowMissingColumns=True)


def read_details(
    spark: SparkSession, path: str, source: str = "details", manifest: DataFrame | None = None
) -> DataFrame:
    return detail_postings(read_html(spark, path, manifest), source)
