"""Sources, deduplication, scoring, store, serving and reports over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import duck
from catalog.bridge import raw_postings, table
from catalog.inputs import (
    batch,
    dbl,
    keyed,
    labelled,
    landed_postings,
    old_store,
    payload_table,
    pipe,
    postings,
    raw,
    spread,
    stamp,
    store,
)
from catalog.registry import query
from postloom import vocabulary as v
from postloom.functions import html
from postloom.functions.text import html_escape
from postloom.operators import dedupe, report, scoring, serve
from postloom.operators import store as state
from postloom.profile import MatchProfile, TermDictionary
from postloom.session import new_folder
from postloom.sinks import exports
from postloom.sources import issues, pages, registry

NOW = dt.datetime(2026, 6, 1, 8, 0, 0)
AS_OF = dt.datetime(2026, 1, 30)

# --- landed records derived from the postings ---------------------------------------------------------

# The same text for both engines.
ISSUE_SQL = """
SELECT seq,
       seq + 500000 AS id,
       CASE WHEN seq % 9 = 0 THEN 0 ELSE seq END AS number,
       CASE WHEN seq % 4 = 0 THEN 'closed' ELSE 'open' END AS state,
       CASE WHEN location IS NULL THEN '' ELSE '[' || location || '] ' END || title
           || CASE WHEN seq % 3 = 0 AND company IS NOT NULL THEN ' @ ' || company ELSE '' END AS title,
       CASE WHEN company IS NULL THEN '' ELSE 'Empresa: ' || company || chr(10) END
           || CASE WHEN seq % 2 = 0 THEN 'Local: Remoto ' || lang || chr(10) ELSE '' END || description AS body,
       link AS html_url,
       CASE WHEN seq % 2 = 0 THEN 'Remoto' ELSE 'Vaga' END AS label,
       CAST('2026-01-01 00:00:00' AS TIMESTAMP) + seq * INTERVAL '1' HOUR AS touched,
       published_at,
       seq % 10 = 0 AS is_pr
FROM bridge
"""
ISSUE = {"issue": ISSUE_SQL}


def issue_lines(spark, sf):
    """One JSON object per posting, as an issue tracker would deliver them."""
    bridge = raw(spark, sf)
    rows = spark.sql(ISSUE_SQL.replace("FROM bridge", "FROM {bridge}"), bridge=bridge)
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    record = F.struct(
        "id", "number", "state", "title", "body", "html_url",
        F.date_format("published_at", iso).alias("created_at"),
        F.date_format("touched", iso).alias("updated_at"),
        (F.col("seq") % 7).cast("int").alias("comments"),
        F.array(F.struct(F.col("label").alias("name"))).alias("labels"),
        F.when(F.col("is_pr"), F.struct(F.col("html_url").alias("url"))).alias("pull_request"),
    )
    return rows.select("seq", F.to_json(record).alias("value"))


_IN_TITLE = rf"'@[{duck.S}]*([^\])|/\-][{duck.W}À-ÿ .,&+\-]{{2,80}})'"


@query(
    "read_issue_json",
    duck.sql(
        f"""SELECT seq, title, company, location, {duck.canonical_url('html_url')} AS link, external_id, {duck.stamp('published_at')} AS published_at,
              array_to_string({duck.detect_stack('t')}, '|') AS stack, {duck.seniority('t')} AS seniority, md5({duck.norm('body')}) AS description_md5
            FROM (SELECT seq, {duck.norm('title')} AS title, body, html_url, published_at,
                {duck.text_of('title', 'body', 'label')} AS t,
                CASE WHEN regexp_matches(title, {_IN_TITLE}) THEN {duck.strip(f'regexp_extract(title, {_IN_TITLE}, 1)')}
                     ELSE nullif({duck.norm("regexp_extract(body, 'Empresa: (.+)', 1)")}, '') END AS company,
                CASE WHEN contains(title, '[') THEN regexp_extract(title, '\\[([^\\]]+)\\]', 1)
                     WHEN seq % 2 = 0 THEN {duck.norm("regexp_extract(body, 'Local: (.+)', 1)")} END AS location,
                CAST(CASE WHEN number = 0 THEN id ELSE number END AS VARCHAR) AS external_id
              FROM issue WHERE NOT is_pr)""",
        "bridge",
        extra=ISSUE,
    ),
)
def read_issue_json(spark, sf):
    found = issues.issue_postings(issues.drop_pull_requests(issues.parse_issues(issue_lines(spark, sf))))
    return found.select(
        "seq", "title", "company", "location", "link", "external_id", stamp("published_at"),
        pipe(F.col("stack")).alias("stack"), "seniority", F.md5("description").alias("description_md5"),
    )


@query("drop_pull_requests", duck.sql("SELECT seq, id FROM issue WHERE NOT is_pr", "bridge", extra=ISSUE))
def drop_pull_requests(spark, sf):
    return issues.drop_pull_requests(issues.parse_issues(issue_lines(spark, sf))).select("seq", "id")


@query(
    "state_and_since_filter",
    duck.sql(
        """SELECT 'issue' AS kind, seq FROM issue WHERE state = 'open' AND touched >= TIMESTAMP '2026-01-16 00:00:00'
            UNION ALL SELECT 'card', seq FROM bridge WHERE published_at >= TIMESTAMP '2026-01-01 08:00:00'""",
        "bridge",
        extra=ISSUE,
    ),
)
def state_and_since_filter(spark, sf):
    """Open issues of the last 14 days and cards of the last day."""
    open_issues = issues.open_since(issues.parse_issues(issue_lines(spark, sf)), AS_OF, 14)
    cards = pages.published_within(raw(spark, sf), dt.datetime(2026, 1, 2, 8))
    return open_issues.select(F.lit("issue").alias("kind"), "seq").unionByName(
        cards.select(F.lit("card").alias("kind"), "seq")
    )


@query(
    "cap_per_source",
    "SELECT doc_id AS seq, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30",
)
def cap_per_source(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "source")
    return serve.cap_per_source(rows, 30)


def card_pages(spark, sf):
    """A listing card per posting; every fourth has no title, so that the card is dropped."""
    e = {n: html_escape(F.coalesce(n, F.lit(""))) for n in ("title", "company", "location", "description", "link")}
    card = F.concat(
        F.lit('<div class="base-search-card"><a class="base-card__full-link x" href="'), e["link"], F.lit('"><h3>'),
        F.when(F.col("seq") % 4 == 0, "").otherwise(e["title"]),
        F.lit('</h3></a><!-- ad --><h4 class="base-search-card__subtitle">'), e["company"],
        F.lit('</h4><span class="job-search-card__location"> '), e["location"], F.lit('</span><time datetime="'),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('">now</time><script>var a="<b>";</script><p>'),
        e["description"], F.lit("</p></div>"),
    )
    return raw(spark, sf).select("seq", card.alias("html"))


_CARD_TEXT = "concat_ws(' ', title, company, location, 'now', description)"


@query(
    "parse_listing_card",
    duck.sql(
        f"""SELECT seq, {duck.norm('title')} AS title, company, location, {duck.canonical_url('link')} AS link, CAST(NULL AS VARCHAR) AS external_id,
            {duck.stamp('published_at')} AS published_at, array_to_string({duck.detect_stack('t')}, '|') AS stack, {duck.seniority('t')} AS seniority,
            md5({duck.norm(_CARD_TEXT)}) AS description_md5
            FROM (SELECT *, {duck.text_of('title', _CARD_TEXT)} AS t FROM bridge WHERE seq % 4 <> 0)""",
        "bridge",
    ),
)
def parse_listing_card(spark, sf):
    return pages.card_postings(card_pages(spark, sf)).select(
        "seq", "title", "company", "location", "link", "external_id", stamp("published_at"),
        pipe(F.col("stack")).alias("stack"), "seniority", F.md5("description").alias("description_md5"),
    )


def detail_pages(spark, sf):
    """A detail page per posting with a logo, the text and one chip per word of the title."""
    e = {n: html_escape(F.coalesce(n, F.lit(""))) for n in ("title", "company", "description")}
    chips = F.transform(F.split(e["title"], " "), lambda t: F.concat(F.lit('<span class="skill-tag">'), t, F.lit("</span>")))
    page = F.concat(
        F.lit("<html><head><style>p{margin:0}</style></head><body><h1>"),
        F.when(F.col("seq") % 5 == 0, "Vagas").when(F.col("seq") % 5 == 1, "").otherwise(e["title"]),
        F.lit('</h1><img alt=""><img alt="'), e["company"], F.lit('"><div>'), F.array_join(chips, " "),
        F.lit("</div><p>"), e["description"], F.lit("</p></body></html>"),
    )
    link = F.concat(F.lit("https://boards.example.com/jobs/"), F.col("seq").cast("string"), F.lit("-python-dev/"))
    return raw(spark, sf).select("seq", link.alias("link"), page.alias("html"))


_CHIPS = TermDictionary.stack()
_PAGE_TITLE = "CASE WHEN seq % 5 = 1 THEN 'Python Dev' ELSE title END"
_PAGE_TEXT = "CASE WHEN seq % 5 = 1 THEN '' ELSE title || ' ' END || title || ' ' || description"


def _chips_sql(x: str) -> str:
    """Names per word of the title, in order of the words, each once."""
    one = duck.detect_stack("w")
    return (
        f"list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(string_split({x}, ' '), lambda u: list_transform([lower(u)], lambda w: {one})[1])), "
        "lambda a, b: list_concat(a, list_filter(b, lambda z: NOT list_contains(a, z))))"
    )


@query(
    "parse_detail_page",
    duck.sql(
        f"""SELECT seq, title, company, CAST(NULL AS VARCHAR) AS location, regexp_extract(link, '([^/]*)/$', 1) AS external_id, rtrim(link, '/') AS link,
            array_to_string(CASE WHEN len(chips) > 0 THEN chips ELSE {duck.detect_stack('page_words')} END, '|') AS stack,
            coalesce({duck.first_word('t', v.SENIORITY_PRIORITY)}, {duck.seniority('page_words')}) AS seniority,
            CASE WHEN list_min(a) < 1e10 THEN list_min(a) END AS salary_min, CASE WHEN list_max(a) < 1e10 THEN list_max(a) END AS salary_max,
            CASE WHEN len(a) > 0 THEN {duck.currency('t')} END AS salary_currency, {duck.contract('t')} AS contract_type, {duck.remote_type('NULL', 't')} AS remote_type,
            CASE WHEN {duck.has_word('t', v.HOME_COUNTRY_WORDS)} THEN 'Brazil' END AS country
            FROM (SELECT *, {duck.text_of('title', 't')} AS page_words, {duck.numbers('t')} AS a FROM
              (SELECT seq, {_PAGE_TITLE} AS title, nullif({duck.norm('company')}, '') AS company,
                 'https://boards.example.com/jobs/' || seq || '-python-dev/' AS link, lower({duck.norm(_PAGE_TEXT)}) AS t, {_chips_sql('title')} AS chips
               FROM bridge WHERE seq % 5 <> 0))""",
        "bridge",
    ),
)
def parse_detail_page(spark, sf):
    d = pages.detail_postings(detail_pages(spark, sf))
    return d.select(
        "seq", "title", "company", "location", "external_id", "link", pipe(F.col("stack")).alias("stack"), "seniority",
        dbl("salary_min"), dbl("salary_max"), "salary_currency", "contract_type", "remote_type", "country",
    )


@query(
    "detect_stack_chips",
    duck.sql(f"SELECT seq, array_to_string({_chips_sql('title')}, '|') AS stack FROM bridge", "bridge"),
)
def detect_stack_chips(spark, sf):
    e = detail_pages(spark, sf).select("seq", html.page_elements(F.col("html")).alias("e"))
    return e.select("seq", pipe(html.chip_stack(F.col("e.chips"), TermDictionary.stack())).alias("stack"))


@query(
    "company_from_page",
    duck.sql(
        f"""SELECT seq, CASE WHEN seq % 3 = 0 AND company IS NOT NULL THEN company WHEN seq % 3 = 1 THEN 'Firma ' || lang END AS company FROM bridge""",
        "bridge",
    ),
)
def company_from_page(spark, sf):
    """A third of the rows with a logo, a third with a "vaga" heading, a third with neither."""
    kind = F.col("seq") % 3
    rows = raw(spark, sf).select(
        "seq",
        F.when(kind == 0, F.col("company")).otherwise(F.lit("Site Logo")).alias("alt"),
        F.col("description").alias("text"),
        F.when(kind == 1, F.concat(F.lit("Vaga nova\n \n"), F.col("title"), F.lit("\n Firma "), F.col("lang"), F.lit("\nfim")))
        .otherwise("nada\nmais").alias("lines"),
    )
    return rows.select(
        "seq", pages.company_from_page(F.col("alt"), F.col("text"), F.col("lines"), site="site logo").alias("company")
    )


@query(
    "company_from_issue",
    duck.sql(
        f"""SELECT seq, CASE WHEN regexp_matches(title, {_IN_TITLE}) THEN {duck.strip(f'regexp_extract(title, {_IN_TITLE}, 1)')}
              ELSE nullif({duck.norm("regexp_extract(body, 'Empresa: (.+)', 1)")}, '') END AS company FROM issue""",
        "bridge",
        extra=ISSUE,
    ),
)
def company_from_issue(spark, sf):
    from postloom.functions.features import company_from_issue as company

    rows = issues.parse_issues(issue_lines(spark, sf))
    return rows.select("seq", company(F.col("title"), F.col("body")).alias("company"))


@query(
    "location_from_issue",
    duck.sql(
        """SELECT seq, CASE WHEN contains(title, '[') THEN regexp_extract(title, '\\[([^\\]]+)\\]', 1)
              WHEN seq % 2 = 0 THEN trim(regexp_extract(body, 'Local: (.+)', 1)) END AS location FROM issue""",
        "bridge",
        extra=ISSUE,
    ),
)
def location_from_issue(spark, sf):
    from postloom.functions.features import location_from_issue as place

    rows = issues.parse_issues(issue_lines(spark, sf))
    return rows.select("seq", place(F.col("title"), F.col("body"), F.col("labels")[0]["name"]).alias("location"))


def _register(sf: str) -> dict[str, str]:
    """Readers over the derived records; the last one always fails."""

    def broken(spark, path):
        raise RuntimeError("blocked")

    registry.register_source("derived_issues", lambda s, p: issues.issue_postings(issues.drop_pull_requests(issues.parse_issues(issue_lines(s, p)))))
    registry.register_source("derived_cards", lambda s, p: pages.card_postings(card_pages(s, p), "derived_cards"))
    registry.register_source("derived_broken", broken)
    return {"derived_issues": sf, "derived_cards": sf, "derived_broken": sf}


_UNION = """(SELECT 0 AS source_rank, 'derived_issues' AS source, true AS ok, (SELECT count(*) FROM issue WHERE NOT is_pr) AS found, NULL AS error
    UNION ALL SELECT 1, 'derived_cards', true, (SELECT count(*) FROM bridge WHERE seq % 4 <> 0), NULL
    UNION ALL SELECT 2, 'derived_broken', false, 0, 'blocked')"""


@query("union_sources", duck.sql(f"SELECT CAST(source_rank AS BIGINT) AS source_rank, source, ok, found, error FROM {_UNION}", "bridge", extra=ISSUE))
def union_sources(spark, sf):
    stats = registry.union_sources(spark, _register(sf)).per_source()
    return stats.select(F.col("source_rank").cast("bigint").alias("source_rank"), "source", "ok", "found", "error")


@query(
    "select_sources",
    duck.sql("SELECT 'cards' AS kind, seq, title FROM (SELECT seq, " + duck.norm("title") + " AS title FROM bridge WHERE seq % 4 <> 0)", "bridge"),
)
def select_sources(spark, sf):
    paths = _register(sf)
    chosen = registry.select_sources([" Derived_Cards ", "unknown"])
    rows = registry.union_sources(spark, paths, chosen).postings
    return rows.select(F.lit("cards").alias("kind"), "seq", "title")


@query("register_source", duck.sql(f"SELECT seq, {duck.norm('title')} AS title FROM bridge", "bridge"))
def register_source(spark, sf):
    registry.register_source(" Own_Source ", lambda s, p: postings(s, p))
    return registry.union_sources(spark, {"own_source": sf}).postings.select("seq", "title")


@query("per_source_counts", "SELECT source, count(*) AS jobs FROM documents GROUP BY source")
def per_source_counts(spark, sf):
    return serve.per_source_counts(table(spark, sf, "documents"))


# --- duplicates ---------------------------------------------------------------------------------------


@query("dedupe_batch", duck.sql("SELECT k.seq, k.link, k.fingerprint, k.content_hash FROM keyed k JOIN kept USING (seq)", "keyed", "kept"))
def dedupe_batch(spark, sf):
    return dedupe.dedupe_batch(postings(spark, sf)).select("seq", "link", "fingerprint", "content_hash")


def _stored_keys(spark, sf):
    rows = keyed(spark, sf).withColumn("created_at", F.col("published_at"))
    return rows.join(labelled(spark, sf), "seq", "left_semi"), rows.join(labelled(spark, sf), "seq", "left_anti")


OLD = {"old": "SELECT * FROM keyed WHERE seq IN (SELECT doc_id FROM labels)", "new": "SELECT * FROM keyed WHERE seq NOT IN (SELECT doc_id FROM labels)"}


def _existing(name: str, key: str):
    @query(
        name,
        duck.sql(
            f"""SELECT {key}, 'ever' AS window FROM old WHERE {key} IN (SELECT {key} FROM new) GROUP BY {key}
                UNION ALL SELECT {key}, 'recent' FROM old WHERE {key} IN (SELECT {key} FROM new)
                AND published_at >= TIMESTAMP '2026-01-01 08:00:00' GROUP BY {key}""",
            "keyed",
            extra=OLD,
        ),
    )
    def run(spark, sf):
        old, new = _stored_keys(spark, sf)
        ever = dedupe.existing_keys(old, new, key)
        recent = dedupe.existing_keys(old, new, key, as_of=dt.datetime(2026, 1, 8, 8), window_days=7)
        return ever.select(key, F.lit("ever").alias("window")).unionByName(recent.select(key, F.lit("recent").alias("window")))

    return run


_existing("existing_links", "link")
_existing("existing_fingerprints", "fingerprint")
_existing("existing_content_hashes", "content_hash")


@query(
    "filter_new",
    duck.sql(
        """SELECT k.seq, k.link FROM keyed k JOIN kept USING (seq) WHERE k.link NOT IN (SELECT link FROM old)
            AND k.fingerprint NOT IN (SELECT fingerprint FROM old) AND k.content_hash NOT IN (SELECT content_hash FROM old)""",
        "keyed",
        "kept",
        extra=OLD,
    ),
)
def filter_new(spark, sf):
    old, _ = _stored_keys(spark, sf)
    return dedupe.filter_new(keyed(spark, sf), old).select("seq", "link")


@query(
    "find_duplicates",
    duck.sql(
        """SELECT * FROM (SELECT seq, link IN (SELECT link FROM new) AS same_link, fingerprint IN (SELECT fingerprint FROM new) AS same_fingerprint,
            content_hash IN (SELECT content_hash FROM new) AS same_content_hash FROM old) WHERE same_link OR same_fingerprint OR same_content_hash""",
        "keyed",
        extra=OLD,
    ),
)
def find_duplicates(spark, sf):
    old, new = _stored_keys(spark, sf)
    return dedupe.find_duplicates(old, new).select("seq", "same_link", "same_fingerprint", "same_content_hash")


@query(
    "duplicates_by_posting",
    duck.sql(
        "SELECT n.seq, "
        + ", ".join(f"count(*) FILTER (o.{k} = n.{k}) AS {k}_rows, min(o.seq) FILTER (o.{k} = n.{k}) AS {k}_id" for k in dedupe.KEYS)
        + " FROM new n JOIN old o ON o.link = n.link OR o.fingerprint = n.fingerprint OR o.content_hash = n.content_hash GROUP BY n.seq",
        "keyed",
        extra=OLD,
    ),
)
def duplicates_by_posting(spark, sf):
    old, new = _stored_keys(spark, sf)
    return dedupe.duplicates_by_posting(old.withColumn("id", F.col("seq")), new)


# --- score --------------------------------------------------------------------------------------------


@query(
    "canonical_tech",
    duck.sql(
        "SELECT seq, coalesce(CASE "
        + " ".join(f"WHEN w IN ({', '.join(duck.q(s) for s in (n, *a))}) THEN {duck.q(n)}" for n, a in v.TECH_ALIASES.items())
        + f" END, w) AS tech FROM (SELECT seq, lower({duck.norm(chr(39) + ' ' + chr(39) + ' || regexp_extract(title, ' + duck.q('^(?:Senior |Sênior |Sr. |Pleno |Jr )?(.*) Engineer') + ', 1)')}) AS w FROM bridge)",
        "bridge",
    ),
)
def canonical_tech(spark, sf):
    name = F.concat(F.lit(" "), F.regexp_extract("title", "^(?:Senior |Sênior |Sr. |Pleno |Jr )?(.*) Engineer", 1))
    return raw(spark, sf).select("seq", scoring.canonical_tech(name).alias("tech"))


@query(
    "tech_match_scores",
    duck.sql(f"SELECT seq, {', '.join(f'tech[{i + 1}] AS tech_{i}' for i in range(7))} FROM {duck.scored('postings')}", "postings"),
)
def tech_match_scores(spark, sf):
    s = scoring.tech_scores(postings(spark, sf), MatchProfile())
    return s.select("seq", *[F.col("tech_scores")[i].alias(f"tech_{i}") for i in range(7)])


@query("base_score", duck.sql(f"SELECT seq, round(base, 4) AS base FROM {duck.scored('postings')}", "postings"))
def base_score(spark, sf):
    p = MatchProfile()
    s = scoring.tech_scores(postings(spark, sf), p)
    return s.select("seq", F.round(scoring.base_score(F.col("tech_scores"), p), 4).alias("base"))


_FACTORS = {w: duck.score_columns(MatchProfile(seniority=w))[2] for w in ("senior", "pleno", "junior", "any")}


def _factor_sql(wanted: str) -> str:
    return _FACTORS[wanted].split(" * 100.0 AS base, ")[1].split(" AS factor")[0] + f" AS {wanted}_wanted"


@query("seniority_factor", duck.sql(f"SELECT seq, {', '.join(_factor_sql(w) for w in _FACTORS)} FROM postings", "postings"))
def seniority_factor(spark, sf):
    found = F.col("seniority")
    return postings(spark, sf).select(
        "seq", *[scoring.seniority_factor(found, w).alias(f"{w}_wanted") for w in ("senior", "pleno", "junior", "any")]
    )


STRICT = MatchProfile(must_have=("Python",), nice_to_have=("fast api", "Kafka"), negative_keywords=("C++", "estágio"), preferred_locations=("recife",), seniority="pleno", remote_only=True)


@query(
    "context_adjustments",
    duck.sql(
        f"""SELECT a.seq, a.bonus, a.penalty, b.bonus AS strict_bonus, b.penalty AS strict_penalty
            FROM {duck.scored('postings')} a JOIN {duck.scored('postings', STRICT)} b ON a.seq = b.seq""",
        "postings",
    ),
)
def context_adjustments(spark, sf):
    plain = scoring.context_adjustments(postings(spark, sf))
    strict = scoring.context_adjustments(plain.withColumnsRenamed({"bonus": "b", "penalty": "p"}), STRICT)
    return strict.select(
        "seq", F.col("b").alias("bonus"), F.col("p").alias("penalty"),
        F.col("bonus").alias("strict_bonus"), F.col("penalty").alias("strict_penalty"),
    )


@query("score_postings", duck.sql(f"SELECT seq, score, factor FROM {duck.scored('postings')}", "postings"))
def score_postings(spark, sf):
    return scoring.score_postings(postings(spark, sf)).select(
        "seq", "score", F.col("score_reasons.seniority_factor").alias("factor")
    )


_REASONS = ", ".join(f"array_to_string({n}, '|') AS {n}" for n in ("matched", "missing", "positive", "negative"))


@query("score_reasons", duck.sql(f"SELECT seq, {_REASONS} FROM {duck.scored('postings', STRICT)}", "postings"))
def score_reasons(spark, sf):
    r = scoring.score_postings(postings(spark, sf), STRICT)
    names = {"matched": "matched_techs", "missing": "missing_techs", "positive": "positive_reasons", "negative": "negative_reasons"}
    return r.select("seq", *[pipe(F.col(f"score_reasons.{c}")).alias(n) for n, c in names.items()])


SIMPLE = ("Python", "FastAPI", "Postgres", "rest")
_PLAIN = MatchProfile(must_have=(), nice_to_have=SIMPLE, negative_keywords=(), preferred_locations=(), seniority="junior")


@query("score_simple", duck.sql(f"SELECT seq, score FROM {duck.scored('postings', _PLAIN)}", "postings"))
def score_simple(spark, sf):
    return scoring.score_simple(postings(spark, sf), SIMPLE, "junior").select("seq", "score")


@query(
    "best_matches",
    duck.sql(
        "SELECT seq, title, company, link, score, array_to_string(matched, '|') AS matched FROM "
        f"{duck.scored('postings')} ORDER BY score DESC, link, seq LIMIT 10",
        "postings",
    ),
)
def best_matches(spark, sf):
    """The flagship: raw text to the ten best matching postings."""
    scored = scoring.score_postings(postings(spark, sf))
    top = scored.orderBy(F.desc("score"), "link", "seq").limit(10)
    return top.select("seq", "title", "company", "link", "score", pipe(F.col("score_reasons.matched_techs")).alias("matched"))


PROFILES = {
    "default": MatchProfile(),
    "strict": STRICT,
    "plain": _PLAIN,
}
_BY_PROFILE = " UNION ALL ".join(
    f"SELECT seq, '{n}' AS profile, title, company, location, link, source, score, CAST(matched AS VARCHAR[]) AS matched FROM {duck.scored('postings', p)}" for n, p in PROFILES.items()
)


@query("score_profiles", duck.sql(f"SELECT seq, profile, score, array_to_string(matched, '|') AS matched FROM ({_BY_PROFILE})", "postings"))
def score_profiles(spark, sf):
    """Every posting against several profiles."""
    r = scoring.score_profiles(postings(spark, sf), PROFILES)
    return r.select("seq", "profile", "score", pipe(F.col("score_reasons.matched_techs")).alias("matched"))


_TOP_BY = f"(SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, link, seq) AS rank FROM ({_BY_PROFILE}))"


@query("top_by_profile", duck.sql(f"SELECT profile, rank, seq, link, score FROM {_TOP_BY} WHERE rank <= 10", "postings"))
def top_by_profile(spark, sf):
    """The ten best postings of each profile."""
    top = serve.top_by(scoring.score_profiles(postings(spark, sf), PROFILES), ("profile",), 10)
    return top.select("profile", F.col("rank").cast("bigint").alias("rank"), "seq", "link", "score")


@query(
    "report_by_profile",
    duck.sql(
        f"""SELECT profile, least(count(*), 10) AS jobs, '<b>{v.REPORT_TOTAL}' || count(*) || '</b>' AS last_line,
            list(link ORDER BY rank)[1] AS first_link FROM {_TOP_BY} GROUP BY profile""",
        "postings",
    ),
)
def report_by_profile(spark, sf):
    """One report per profile over the landed postings, checked by its first link and its last line."""
    scored = scoring.score_profiles(postings(spark, sf), PROFILES)
    totals = scored.groupBy("profile").agg(F.count(F.lit(1)).alias("total"))
    told = report.reports_by(serve.top_by(scored, ("profile",), 10), totals, ("profile",), NOW.date())
    lines = F.split("report", "\n")
    return told.select(
        "profile", "jobs", F.element_at(lines, -1).alias("last_line"),
        F.regexp_replace(F.regexp_extract("report", 'href="([^"]*)"', 1), "&amp;", "&").alias("first_link"),
    )


# --- store --------------------------------------------------------------------------------------------

JOB = "id, title, company, link, source, seniority, score, salary_min, salary_max, contract_type, remote_type, seen_count"


def job(df, *more):
    return df.select(
        "id", "title", "company", "link", "source", "seniority", dbl("score"), dbl("salary_min"), dbl("salary_max"),
        "contract_type", "remote_type", F.col("seen_count").cast("bigint").alias("seen_count"), *more,
    )


_STAMPS = f"{duck.stamp('last_seen_at')} AS last_seen_at, {duck.stamp('created_at')} AS created_at, {duck.stamp('updated_at')} AS updated_at"
_NOW = f"TIMESTAMP '{NOW}'"
_B = ", ".join(f"CASE WHEN b.link IS NULL THEN s.{c} ELSE b.{c} END AS {c}" for c in ("title", "company", "source", "seniority", "score", "salary_min", "salary_max", "contract_type", "remote_type"))


@query(
    "upsert_postings",
    duck.sql(
        f"""SELECT {JOB}, {_STAMPS} FROM (SELECT coalesce(s.id, b.seq) AS id, coalesce(s.link, b.link) AS link, {_B},
              CASE WHEN s.link IS NULL THEN 1 WHEN b.link IS NULL THEN s.seen_count ELSE s.seen_count + 1 END AS seen_count,
              CASE WHEN b.link IS NULL THEN s.last_seen_at ELSE {_NOW} END AS last_seen_at, coalesce(s.created_at, {_NOW}) AS created_at,
              CASE WHEN b.link IS NULL THEN s.updated_at ELSE {_NOW} END AS updated_at
            FROM old_store s FULL JOIN batch b ON s.link = b.link)""",
        "old_store",
        "batch",
    ),
)
def upsert_postings(spark, sf):
    after = state.upsert_postings(old_store(spark, sf), batch(spark, sf), NOW)
    return job(after, stamp("last_seen_at"), stamp("created_at"), stamp("updated_at"))


@query(
    "upsert_affected_count",
    duck.sql(
        """SELECT count(*) AS affected, count(*) FILTER (WHERE link NOT IN (SELECT link FROM old_store)) AS inserted,
            count(*) FILTER (WHERE link IN (SELECT link FROM old_store)) AS updated FROM batch""",
        "old_store",
        "batch",
    ),
)
def upsert_affected_count(spark, sf):
    return state.upsert_counts(old_store(spark, sf), batch(spark, sf))


@query(
    "payload_defaults",
    duck.sql(
        f"""SELECT seq, CASE WHEN seq % 2 = 0 THEN 'closed' ELSE 'active' END AS status, CAST(1 AS BIGINT) AS seen_count,
            {duck.stamp(_NOW)} AS last_seen_at, {duck.stamp(_NOW)} AS updated_at FROM payloads""",
        "payloads",
    ),
)
def payload_defaults(spark, sf):
    rows = payload_table(spark, sf).withColumn("status", F.when(F.col("seq") % 2 == 0, "closed"))
    full = state.payload_defaults(rows, NOW)
    return full.select("seq", "status", F.col("seen_count").cast("bigint").alias("seen_count"), stamp("last_seen_at"), stamp("updated_at"))


_SIGHTINGS = "SELECT user_id || ':' || event_type AS link, event_id AS seq, ts AS seen_at, value, props FROM events"
_US = "'%Y-%m-%d %H:%M:%S.%f'"


def sightings(spark, sf):
    return table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("link"),
        F.col("event_id").alias("seq"), F.col("ts").alias("seen_at"), "value", "props",
    )


def micros(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query(
    "fold_sightings",
    f"""SELECT link, arg_max(value, (seen_at, seq)) AS value, arg_max(props, (seen_at, seq)) AS props, strftime(min(seen_at), {_US}) AS created_at,
        strftime(max(seen_at), {_US}) AS last_seen_at, count(*) AS seen_count, min(seq) AS first_seq FROM ({_SIGHTINGS}) GROUP BY link""",
)
def fold_sightings(spark, sf):
    f = state.fold_sightings(sightings(spark, sf))
    return f.select("link", "value", "props", micros("created_at"), micros("last_seen_at"), "seen_count", "first_seq")


@query(
    "mark_seen",
    f"""SELECT id, s.seen_count + coalesce(m.n, 0) AS seen_count, CASE WHEN m.n IS NULL THEN strftime(s.last_seen_at, {_US}) ELSE strftime({_NOW}, {_US}) END AS last_seen_at
        FROM (SELECT user_id AS id, count(*) AS seen_count, max(ts) AS last_seen_at FROM events GROUP BY user_id) s
        LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY user_id) m ON s.id = m.user_id""",
)
def mark_seen(spark, sf):
    events = table(spark, sf, "events")
    snapshot = events.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("seen_count"), F.max("ts").alias("last_seen_at"), F.max("ts").alias("updated_at")
    )
    marks = events.filter("event_type = 'purchase' AND value > 40").select(F.col("user_id").alias("id"))
    return state.mark_seen(snapshot, marks, NOW).select("id", "seen_count", micros("last_seen_at"))


# Runs: one per day of events; the sources of a run are 20 groups of users; a source fails in a run
# when its last event of the day is an error.
_RUNS = """SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS id, user_id % 20 AS source_rank, 'src' || (user_id % 20) AS source,
    arg_max(event_type, event_id) <> 'error' AS ok, count(*) AS found, 'event ' || max(event_id) AS error,
    min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1, 2, 3"""
_STATUS = f"""SELECT id, min(started_at) AS started_at, max(finished_at) AS finished_at, count(*) FILTER (WHERE ok) AS sources_scraped,
    coalesce(sum(found) FILTER (WHERE ok), 0)::BIGINT AS jobs_found,
    CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' ELSE 'success' END AS status,
    nullif(array_to_string(list(source || ': ' || error ORDER BY source_rank) FILTER (WHERE NOT ok), '; '), '') AS error_message FROM ({_RUNS}) GROUP BY id"""


def run_sources(spark, sf):
    group = F.col("user_id") % 20
    return (
        table(spark, sf, "events")
        .groupBy(
            F.date_format("ts", "yyyyMMdd").cast("bigint").alias("id"), group.alias("source_rank"),
            F.concat(F.lit("src"), group.cast("string")).alias("source"),
        )
        .agg(
            (F.max_by("event_type", "event_id") != "error").alias("ok"),
            F.count(F.lit(1)).alias("found"),
            F.concat(F.lit("event "), F.max("event_id").cast("string")).alias("error"),
            F.min("ts").cast("timestamp").alias("started_at"),
            F.max("ts").cast("timestamp").alias("finished_at"),
        )
    )


@query("run_status", f"SELECT id, sources_scraped, jobs_found, status, error_message FROM ({_STATUS})")
def run_status(spark, sf):
    return state.run_status(run_sources(spark, sf), "id").select("id", "sources_scraped", "jobs_found", "status", "error_message")


def run_starts(spark, sf):
    return run_sources(spark, sf).groupBy("id").agg(F.min("started_at").alias("started_at"))


def run_events(spark, sf):
    """Opening events of all runs and closing events of those with more than five sources up."""
    results = state.run_status(run_sources(spark, sf), "id").filter("sources_scraped > 5")
    ends = run_sources(spark, sf).groupBy("id").agg(F.max("finished_at").alias("finished_at"))
    results = results.join(ends, "id").withColumn("jobs_new", F.col("jobs_found"))
    return state.run_log_create(run_starts(spark, sf)), state.run_log_finish(results)


@query(
    "run_log_create",
    f"SELECT id, strftime(started_at, {_US}) AS started_at, 'pending' AS status, CAST(0 AS BIGINT) AS jobs_found FROM ({_STATUS})",
)
def run_log_create(spark, sf):
    opened, _ = run_events(spark, sf)
    return opened.select("id", micros("started_at"), "status", "jobs_found")


_LOG = f"""SELECT id, started_at, CASE WHEN sources_scraped > 5 THEN finished_at END AS finished_at, CASE WHEN sources_scraped > 5 THEN sources_scraped ELSE 0 END AS sources_scraped,
    CASE WHEN sources_scraped > 5 THEN jobs_found ELSE 0 END AS jobs_found, CASE WHEN sources_scraped > 5 THEN jobs_found ELSE 0 END AS jobs_new,
    CASE WHEN sources_scraped > 5 THEN status ELSE 'pending' END AS status, CASE WHEN sources_scraped > 5 THEN error_message END AS error_message FROM ({_STATUS})"""
_LOG_OUT = f"SELECT id, strftime(started_at, {_US}) AS started_at, strftime(finished_at, {_US}) AS finished_at, CAST(sources_scraped AS BIGINT) AS sources_scraped, jobs_found, jobs_new, status, error_message"


def log_rows(df):
    return df.select(
        "id", micros("started_at"), micros("finished_at"), F.col("sources_scraped").cast("bigint").alias("sources_scraped"),
        "jobs_found", "jobs_new", "status", "error_message",
    )


@query("run_log_finish", f"{_LOG_OUT} FROM ({_LOG})")
def run_log_finish(spark, sf):
    opened, closed = run_events(spark, sf)
    return log_rows(state.run_log_view(opened.unionByName(closed)))


@query("recent_executions", f"{_LOG_OUT} FROM (SELECT * FROM ({_LOG}) ORDER BY started_at DESC NULLS FIRST, id DESC LIMIT 25)")
def recent_executions(spark, sf):
    opened, closed = run_events(spark, sf)
    return log_rows(serve.recent_executions(state.run_log_view(opened.unionByName(closed)), 25))


@query("project_execution_read", f"{_LOG_OUT} FROM ({_LOG})")
def project_execution_read(spark, sf):
    opened, closed = run_events(spark, sf)
    return log_rows(serve.project_execution_read(state.run_log_view(opened.unionByName(closed))))


@query("scan_store", duck.sql(f"SELECT {JOB}, {_STAMPS} FROM store", "store"))
def scan_store(spark, sf):
    from postloom.sources.store import read_store, write_store

    folder = new_folder(spark, "scan")
    write_store(store(spark, sf), folder)
    return job(read_store(spark, folder), stamp("last_seen_at"), stamp("created_at"), stamp("updated_at"))


@query(
    "incremental_ingest",
    duck.sql(f"SELECT link, title, score, CAST(1 AS BIGINT) AS seen_count FROM {duck.scored('(SELECT * FROM keyed WHERE seq IN (SELECT seq FROM kept))')}", "kept"),
)
def incremental_ingest(spark, sf):
    """Stream over postings landed in several files."""
    from postloom.schema import POSTING_DDL
    from postloom.streaming import incremental

    folder = new_folder(spark, "stream")
    landed_postings(spark, sf, 3).drop("seq", "part").write.parquet(f"{folder}/landed")
    landed = incremental.read_landed(spark, f"{folder}/landed", POSTING_DDL)
    incremental.incremental_ingest(landed, f"{folder}/store", f"{folder}/progress", now=NOW)
    return incremental.current(spark, f"{folder}/store").select("link", "title", dbl("score"), "seen_count")


@query("dedupe_rounds", duck.sql("SELECT k.seq, k.link FROM keyed k JOIN kept USING (seq)", "keyed", "kept"))
def dedupe_rounds(spark, sf):
    """Duplicates decided by rounds alone, without the sequential rule for a small remainder."""
    return dedupe.dedupe_batch(keyed(spark, sf), tail_rows=0).select("seq", "link")


_DAILY = {
    **ISSUE,
    "landed": f"""SELECT row_number() OVER (ORDER BY seq DESC) AS seq, * EXCLUDE (seq) FROM (SELECT seq, 'issues' AS source, {duck.norm('title')} AS title,
          CASE WHEN regexp_matches(title, {_IN_TITLE}) THEN {duck.strip(f'regexp_extract(title, {_IN_TITLE}, 1)')}
               ELSE nullif({duck.norm("regexp_extract(body, 'Empresa: (.+)', 1)")}, '') END AS company,
          CASE WHEN contains(title, '[') THEN regexp_extract(title, '\\[([^\\]]+)\\]', 1)
               WHEN seq % 2 = 0 THEN trim(regexp_extract(body, 'Local: (.+)', 1)) END AS location,
          nullif({duck.norm('body')}, '') AS description, {duck.canonical_url('html_url')} AS link, published_at,
          {duck.text_of('title', 'body', 'label')} AS t FROM issue WHERE NOT is_pr)""",
    "daily_postings": f"SELECT * EXCLUDE (t), {duck.detect_stack('t')} AS stack, {duck.seniority('t')} AS seniority, {duck.SALARY_NULLS} FROM landed",
    "daily_parts": duck.CTES["key_parts"][1].replace("FROM postings", "FROM daily_postings"),
    "daily_keyed": duck.CTES["keyed"][1].replace("FROM key_parts", "FROM daily_parts"),
    "daily_kept": duck.CTES["kept"][1].replace("FROM keyed", "FROM daily_keyed"),
    "daily_scored": f"SELECT * FROM {duck.scored('(SELECT * FROM daily_keyed WHERE seq IN (SELECT seq FROM daily_kept))')}",
}


@query(
    "daily_run",
    duck.sql("SELECT link, title, company, fingerprint, score, CAST(1 AS BIGINT) AS seen_count FROM daily_scored", "bridge", extra=_DAILY),
)
def daily_run(spark, sf):
    """The whole run over landed issue files: read, validate, deduplicate, score, store."""
    from postloom.plans.daily_run import RunSettings, run

    folder = new_folder(spark, "landed")
    issue_lines(spark, sf).select("value").write.text(folder, compression="gzip")
    newest_first = (F.desc("published_at"), F.asc("link"), F.asc("external_id"))
    result = run(spark, RunSettings(paths={"issues": folder}, now=NOW, order=newest_first), None)
    return result.snapshot.select(
        "link", "title", "company", "fingerprint", dbl("score"), F.col("seen_count").cast("bigint").alias("seen_count")
    )


_SINCE = dt.datetime(2026, 1, 16)
_OPEN = {
    **_DAILY,
    "landed": _DAILY["landed"].replace(
        "FROM issue WHERE NOT is_pr", "FROM issue WHERE NOT is_pr AND state = 'open' AND touched >= TIMESTAMP '2026-01-02 00:00:00'"
    ),
}


@query(
    "daily_run_store",
    duck.sql(
        "SELECT link, title, fingerprint, score, CAST(2 AS BIGINT) AS seen_count, (SELECT count(*) FROM daily_scored) AS jobs_new, 'success' AS run_status FROM daily_scored",
        "bridge",
        extra=_OPEN,
    ),
)
def daily_run_store(spark, sf):
    """Two runs of open, recent issues on one versioned store; what is stored, beside the second run's log row."""
    from postloom.plans.daily_run import RunSettings, run
    from postloom.sources.store import read_log

    folder = new_folder(spark, "runs")
    issue_lines(spark, sf).select("value").write.text(f"{folder}/landed", compression="gzip")
    newest_first = (F.desc("published_at"), F.asc("link"), F.asc("external_id"))
    for number in (1, 2):
        settings = RunSettings(
            paths={"issues": f"{folder}/landed"}, now=NOW + dt.timedelta(days=number), run_id=number, order=newest_first,
            reader_options={"issues": {"as_of": _SINCE, "days": 14}}, store=f"{folder}/store",
        )
        last = run(spark, settings)
    log = F.broadcast(read_log(spark, f"{folder}/store").filter("id = 2").select("jobs_new", F.col("status").alias("run_status"), F.lit(1).alias("one")))
    stored = last.snapshot.withColumn("one", F.lit(1)).join(log, "one")
    return stored.select("link", "title", "fingerprint", dbl("score"), F.col("seen_count").cast("bigint").alias("seen_count"), "jobs_new", "run_status")


# --- serve --------------------------------------------------------------------------------------------


@query("recent_jobs", duck.sql(f"SELECT {JOB} FROM store ORDER BY created_at DESC NULLS FIRST, link LIMIT 50", "store"))
def recent_jobs(spark, sf):
    return job(serve.recent_jobs(store(spark, sf), 50))


TOP = "ORDER BY score DESC, last_seen_at DESC NULLS FIRST, link LIMIT 10"


@query("top_jobs", duck.sql(f"SELECT {JOB} FROM store WHERE score >= 20 {TOP}", "store"))
def top_jobs(spark, sf):
    return job(serve.top_jobs(store(spark, sf), 10, 20.0))


@query("top_payloads", duck.sql("SELECT seq, link, score FROM payloads WHERE score >= 20 ORDER BY score DESC, seq LIMIT 10", "payloads"))
def top_payloads(spark, sf):
    return serve.top_payloads(payload_table(spark, sf), 10, 20.0).select("seq", "link", dbl("score"))


@query("job_by_id", duck.sql(f"SELECT {JOB} FROM store WHERE id = (SELECT max(id) FROM store)", "store"))
def job_by_id(spark, sf):
    jobs = store(spark, sf)
    last = jobs.agg(F.max("id")).first()[0]
    return job(serve.job_by_id(jobs, last))


@query(
    "metrics_summary",
    duck.sql(f"SELECT count(*) AS total_jobs, coalesce(max(score), 0) AS top_score, {duck.stamp('max(last_seen_at)')} AS last_seen_at FROM store", "store"),
)
def metrics_summary(spark, sf):
    return serve.metrics_summary(store(spark, sf)).select("total_jobs", "top_score", stamp("last_seen_at"))


@query(
    "recently_seen",
    duck.sql(f"SELECT id, title, company, score, seen_count, {duck.stamp('last_seen_at')} AS last_seen_at FROM (SELECT * FROM store ORDER BY last_seen_at DESC NULLS FIRST, link LIMIT 20)", "store"),
)
def recently_seen(spark, sf):
    return serve.recently_seen(store(spark, sf)).select("id", "title", "company", dbl("score"), "seen_count", stamp("last_seen_at"))


@query(
    "run_summary",
    duck.sql(
        """SELECT CAST(2 AS BIGINT) AS sources_scraped, (SELECT count(*) FROM payloads) AS jobs_found, (SELECT count(*) FROM batch) AS affected,
            (SELECT count(*) FROM batch WHERE link NOT IN (SELECT link FROM old_store)) AS inserted, 'success' AS status, 'c: blocked' AS error_message""",
        "old_store",
        "batch",
    ),
)
def run_summary(spark, sf):
    from postloom.plans.daily_run import run_summary as summary

    arrived = payload_table(spark, sf).groupBy(F.when(F.col("seq") % 2 == 0, "a").otherwise("b").alias("source")).agg(F.count(F.lit(1)).alias("found"))
    lines = arrived.select(
        F.when(F.col("source") == "a", 0).otherwise(1).alias("source_rank"), "source", F.lit(True).alias("ok"), "found",
        F.lit(None).cast("string").alias("error"),
    )
    failed = spark.createDataFrame([(2, "c", False, 0, "blocked")], "source_rank int, source string, ok boolean, found bigint, error string")
    counts = state.upsert_counts(old_store(spark, sf), batch(spark, sf)).withColumn("id", F.lit(1))
    status = state.run_status(lines.unionByName(failed).withColumn("id", F.lit(1)), "id")
    one = summary(status, counts)
    return one.select("sources_scraped", "jobs_found", "affected", "inserted", "status", "error_message")


_READ = "id, title, company, location, array_to_string(stack, '|') AS stack, link, source, seniority, score, remote_type, contract_type, salary_min, salary_max"


@query(
    "project_job_read",
    duck.sql(f"SELECT {_READ}, array_to_string(positive, '|') AS reasons, {duck.stamp('created_at')} AS created_at, {duck.stamp('updated_at')} AS updated_at FROM store", "store"),
)
def project_job_read(spark, sf):
    return serve.project_job_read(store(spark, sf)).withColumns(
        {"stack": pipe(F.col("stack")), "reasons": pipe(F.col("score_reasons.positive_reasons"))}
    ).withColumns({c: stamp(c) for c in ("created_at", "updated_at")}).drop("score_reasons")


@query(
    "project_job_dict",
    duck.sql(
        f"""SELECT {_READ}, external_id, fingerprint, content_hash, salary_currency, country, city, status, seen_count, array_to_string(negative, '|') AS reasons,
            {duck.stamp('published_at')} AS published_at, {_STAMPS} FROM store""",
        "store",
    ),
)
def project_job_dict(spark, sf):
    times = ("published_at", "created_at", "updated_at", "last_seen_at")
    return serve.project_job_dict(store(spark, sf)).withColumns(
        {"stack": pipe(F.col("stack")), "reasons": pipe(F.col("score_reasons.negative_reasons"))}
    ).withColumns({c: stamp(c) for c in times}).drop("score_reasons")


# --- reports ------------------------------------------------------------------------------------------


@query("format_salary", duck.sql(f"SELECT seq, {duck.format_salary('salary_min', 'salary_max', 'salary_currency')} AS salary FROM payloads", "payloads"))
def format_salary(spark, sf):
    money = [F.col(f"salary_{x}") for x in ("min", "max", "currency")]
    return payload_table(spark, sf).select("seq", report.format_salary(*money).alias("salary"))


@query("html_escape", f"SELECT page_id, md5({duck.html('html')}) AS escaped_md5 FROM pages")
def escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(html_escape(F.col("html"))).alias("escaped_md5"))


def _block_sql() -> str:
    def shown(name: str, default: str) -> str:
        return duck.html(f"coalesce(nullif({name}, ''), {duck.q(default)})")

    lines = [
        f"'<b>' || rank || '. ' || {shown('title', v.REPORT_NO_TITLE)} || '</b>'",
        f"'Empresa: ' || {shown('company', v.REPORT_NO_COMPANY)}",
        f"'Local: ' || {shown('location', v.REPORT_NO_LOCATION)}",
        f"'Modelo: ' || {shown('remote_type', v.REPORT_NOT_INFORMED)}",
        f"'Contrato: ' || {shown('contract_type', v.REPORT_NOT_INFORMED)}",
        f"'Salário: ' || {duck.format_salary('salary_min', 'salary_max', 'salary_currency')}",
        "'Score: ' || format('{:.2f}', coalesce(score, 0))",
        f"""CASE WHEN len(positive) + len(negative) > 0 THEN 'Motivos:' || chr(10) || array_to_string(list_concat(
            list_transform(positive[1:3], lambda r: '- ' || {duck.html('r')}), list_transform(negative[1:2], lambda r: '- penalidade: ' || {duck.html('r')})), chr(10)) END""",
        f"""CASE WHEN link <> '' THEN '<a href="' || {duck.html('link')} || '">{v.REPORT_LINK_TEXT}</a>' END""",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)}) || chr(10)"


_BLOCKS = {
    "ranked": f"SELECT *, row_number() OVER (ORDER BY score DESC, last_seen_at DESC NULLS FIRST, link) AS rank FROM (SELECT * FROM store WHERE score >= 20 {TOP})",
    "blocks": f"SELECT rank, link, {_block_sql()} AS block FROM ranked",
}


@query("report_rows", duck.sql("SELECT rank, link, block FROM blocks", "store", extra=_BLOCKS))
def report_rows(spark, sf):
    top = serve.top_jobs(store(spark, sf), 10, 20.0)
    return report.report_rows(top).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "daily_report",
    duck.sql(
        f"""SELECT '🤖 <b>Daily Report – 2026-06-01</b>' || chr(10) || chr(10) || (SELECT string_agg(block, chr(10) ORDER BY rank) FROM blocks) || chr(10)
            || '<b>{v.REPORT_TOTAL}' || (SELECT count(*) FROM payloads) || '</b>' AS report, (SELECT count(*) FROM blocks) AS jobs""",
        "store",
        extra=_BLOCKS,
    ),
)
def daily_report(spark, sf):
    total = payload_table(spark, sf).count()
    return report.daily_report(serve.top_jobs(store(spark, sf), 10, 20.0), total, NOW.date())


@query(
    "report_gate",
    duck.sql(
        """SELECT source, CASE WHEN count(*) FILTER (WHERE score >= 20) > 0 THEN 'sent' ELSE 'skipped_empty' END AS outcome, 'sent' AS always FROM payloads GROUP BY source""",
        "payloads",
    ),
)
def report_gate(spark, sf):
    per = payload_table(spark, sf).groupBy("source").agg(F.count(F.when(F.col("score") >= 20, 1)).alias("jobs"))
    return per.select(
        "source", report.report_gate(F.col("jobs")).alias("outcome"), report.report_gate(F.col("jobs"), True).alias("always")
    )


_PLAIN_TEXT = "'<b>' || " + duck.html("text") + " || '</b><br><a href=\"x\">" + v.REPORT_LINK_TEXT + "</a>'"


@query("strip_report_html", f"SELECT doc_id, md5(text || chr(10) || 'x - {v.REPORT_LINK_TEXT}') AS plain_md5 FROM documents")
def strip_report_html(spark, sf):
    marked = F.concat(F.lit("<b>"), html_escape(F.col("text")), F.lit(f'</b><br><a href="x">{v.REPORT_LINK_TEXT}</a>'))
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", F.md5(report.strip_report_html(marked)).alias("plain_md5"))


@query(
    "chunk_by_lines",
    """WITH lines AS (SELECT doc_id, text, list_filter(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)), lambda l: l <> '') AS ls FROM documents),
        packed AS (SELECT doc_id, list_reduce(
            list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': ''}, list_transform(ls, lambda l: {'done': CAST([] AS VARCHAR[]), 'cur': l})),
            lambda a, b: CASE WHEN length(a.cur) + length(b.cur) > 3800 AND length(a.cur) > 0 THEN {'done': list_append(a.done, a.cur), 'cur': b.cur}
                ELSE {'done': a.done, 'cur': a.cur || b.cur} END) AS r FROM lines WHERE length(text) > 4096)
        SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_no, md5(c) AS chunk_md5 FROM
          (SELECT doc_id, unnest(list_append(r.done, r.cur)) AS c, unnest(range(1, len(r.done) + 2)) AS i FROM packed)
        UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 4096""",
)
def chunk_by_lines(spark, sf):
    chunks = report.chunk_table(spread(table(spark, sf, "documents")), "doc_id")
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


_RECENT = "(SELECT * FROM store ORDER BY created_at DESC NULLS FIRST, link LIMIT 100)"


@query("export_csv", duck.sql("SELECT id, title, company, location, source, score, seniority, link FROM store", "store"))
def export_csv(spark, sf):
    path = exports.export_csv(store(spark, sf), new_folder(spark, "csv"))
    back = spark.read.csv(path, header=True, escape='"', schema="id bigint, title string, company string, location string, source string, score double, seniority string, link string")
    return back


@query(
    "export_json",
    duck.sql(
        "SELECT id, title, company, array_to_string(stack, '|') AS stack, score, array_to_string(positive, '|') AS positive, salary_min, strftime(published_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS published_at FROM store",
        "store",
    ),
)
def export_json(spark, sf):
    path = exports.export_json(store(spark, sf), new_folder(spark, "json"))
    back = spark.read.schema(
        "id bigint, title string, company string, stack array<string>, score double, score_reasons struct<positive_reasons: array<string>>, salary_min double, published_at string"
    ).json(path)
    return back.select(
        "id", "title", "company", pipe(F.col("stack")).alias("stack"), "score",
        pipe(F.col("score_reasons.positive_reasons")).alias("positive"), "salary_min", "published_at",
    )


_SECTION = f"""'## ' || rank || '. ' || title || chr(10) || chr(10) || '- Empresa: ' || coalesce(nullif(company, ''), '{v.MARKDOWN_NO_COMPANY}') || chr(10)
    || '- Local: ' || coalesce(nullif(location, ''), '{v.MARKDOWN_NO_LOCATION}') || chr(10) || '- Score: ' || format('{{:.2f}}', coalesce(score, 0)) || chr(10) || '- Link: ' || link || chr(10)"""
_MD = {
    "md": f"SELECT {_SECTION} AS section, rank FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, link) AS rank FROM {_RECENT})"
}


@query(
    "export_markdown",
    duck.sql(
        "SELECT line FROM (SELECT unnest(string_split(section, chr(10))) AS line FROM md UNION ALL SELECT '# Daily Report' UNION ALL SELECT '') WHERE line <> ''",
        "store",
        extra=_MD,
    ),
)
def export_markdown(spark, sf):
    path = exports.export_markdown(serve.recent_jobs(store(spark, sf), 100), new_folder(spark, "markdown"))
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("line"))


_MANY = "(SELECT * FROM store ORDER BY created_at DESC NULLS FIRST, link LIMIT 500)"


@query("export_jobs", duck.sql(f"SELECT id, title, score, link FROM {_MANY}", "store"))
def export_jobs(spark, sf):
    path = exports.export_jobs(store(spark, sf), new_folder(spark, "export"), "csv", 500)
    back = spark.read.csv(path, header=True, escape='"', schema="id bigint, title string, company string, location string, source string, score double, seniority string, link string")
    return back.select("id", "title", "score", "link")
