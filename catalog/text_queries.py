"""Scalar normalisation and text features over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck
from catalog.inputs import documents, pages, payloads, pipe, postings, raw, stamp
from catalog.registry import query
from postloom.functions import features, html, keys, text, urls
from postloom.operators import postings as ops
from postloom.operators.scoring import merge_raw_payload
from postloom.profile import TermDictionary

def full_text():
    return text.joined(F.col("title"), F.col("description"))


# --- normalisation ----------------------------------------------------------------------------------


@query(
    "normalize_text",
    f"SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT doc_id, {duck.norm('text')} AS t FROM documents)",
)
def normalize_text(spark, sf):
    t = documents(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


STACK_ITEMS = "title || ', ,' || upper(title) || ',Python, python ,' || coalesce(location, '') || ',' || upper(coalesce(company, 'x')) || ',X'"


@query(
    "normalize_stack",
    duck.sql(
        f"""SELECT seq, array_to_string(list_transform(list_filter(list_zip(items, range(1, len(items) + 1)),
              lambda p: list_position(list_transform(items, lambda y: lower(y)), lower(p[1])) = p[2]), lambda p: p[1]), '|') AS stack
            FROM (SELECT seq, list_filter(list_transform(string_split({STACK_ITEMS}, ','), lambda x: {duck.strip('x')}), lambda x: x <> '') AS items FROM bridge)""",
        "bridge",
    ),
)
def normalize_stack(spark, sf):
    return raw(spark, sf).select("seq", pipe(text.normalize_stack(F.split(F.expr(STACK_ITEMS), ","))).alias("stack"))


@query("canonicalize_url", f"SELECT page_id, {duck.canonical_url('url')} AS link FROM pages")
def canonicalize_url(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonicalize_url(F.col("url")).alias("link"))


HREFS = """'href="([^"]*)"'"""


@query(
    "resolve_url",
    f"""SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, {duck.resolved('href', 'url')} AS link FROM
        (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS pos FROM
          (SELECT page_id, url, regexp_extract_all(html, {HREFS}, 1) || ['next?p=2', '?q=1', '#end', '//cdn.example.org/x'] AS hrefs FROM pages))""",
)
def resolve_url(spark, sf):
    hrefs = F.concat(
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)),
        text.lit_array(["next?p=2", "?q=1", "#end", "//cdn.example.org/x"]),
    )
    found = pages(spark, sf).select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), urls.resolve_url(F.col("href"), F.col("url")).alias("link"))


DATE_TEXT = """CASE event_id % 6
  WHEN 0 THEN {f}(ts, '{iso}') || 'Z' WHEN 1 THEN {f}(ts, '{iso}') || '+03:00'
  WHEN 2 THEN {f}(ts, '{day}') WHEN 3 THEN 'on ' || {f}(ts, '{day}')
  WHEN 4 THEN '  ' || {f}(ts, '{iso}') ELSE '' END"""


@query(
    "safe_datetime",
    f"""SELECT event_id, {duck.stamp("CASE event_id % 6 WHEN 0 THEN s WHEN 1 THEN s - INTERVAL '3' HOUR WHEN 2 THEN date_trunc('day', s) WHEN 4 THEN s END")} AS parsed
        FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)""",
)
def safe_datetime(spark, sf):
    from catalog.bridge import table

    words = DATE_TEXT.format(f="date_format", iso="yyyy-MM-dd''T''HH:mm:ss", day="yyyy-MM-dd")
    events = table(spark, sf, "events").select("event_id", F.expr(words).alias("written"))
    return events.select("event_id", ops.safe_datetime(F.col("written")).alias("parsed")).select("event_id", stamp("parsed"))


@query(
    "title_from_url",
    f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(slug, '([\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)'),
          lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM
        (SELECT page_id, replace(regexp_replace(regexp_extract(rtrim(u, '/'), '([^/]*)$', 1), '^[0-9]+-', ''), '-', ' ') AS slug FROM
          (SELECT page_id, 'https://boards.example.com/jobs/' || page_id || '-' || replace(regexp_extract(url, '^https?://([^/]*)', 1), '.', '-') || '/' AS u FROM pages))""",
)
def title_from_url(spark, sf):
    link = F.concat(
        F.lit("https://boards.example.com/jobs/"), F.col("page_id").cast("string"), F.lit("-"),
        F.replace(F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("."), F.lit("-")), F.lit("/"),
    )
    return pages(spark, sf).select("page_id", urls.title_from_url(link).alias("title"))


@query(
    "external_id_from_url",
    """SELECT page_id, nullif(regexp_extract('https://boards.example.com/jobs/view/' || page_id || '/?x=1', '/jobs/view/([0-9]+)', 1), '') AS view_id,
        nullif(regexp_extract(url, '/jobs/view/([0-9]+)', 1), '') AS no_view_id,
        regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS segment FROM pages""",
)
def external_id_from_url(spark, sf):
    link = F.concat(F.lit("https://boards.example.com/jobs/view/"), F.col("page_id").cast("string"), F.lit("/?x=1"))
    return pages(spark, sf).select(
        "page_id",
        urls.view_id(link).alias("view_id"),
        urls.view_id(F.col("url")).alias("no_view_id"),
        urls.last_segment(F.col("url")).alias("segment"),
    )


TITLES = """CASE WHEN n_chars % 5 = 0 THEN text WHEN n_chars % 5 = 1 THEN 'x' ELSE 'Engineer ' || CAST(doc_id AS STRING) END"""
LINKS = """CASE WHEN n_chars % 4 = 0 THEN 'not-url' WHEN n_chars % 4 = 1 THEN 'ftp://example.com/jobs' WHEN n_chars % 4 = 2 THEN 'HTTPS://example.com/' || lang ELSE NULL END"""


@query(
    "validate_postings",
    f"""SELECT doc_id, array_to_string({duck.compact([
        "CASE WHEN length(title) < 2 THEN 'title too short' END", "CASE WHEN length(title) > 300 THEN 'title too long' END",
        "CASE WHEN length(company) > 200 THEN 'company too long' END",
        "CASE WHEN link IS NULL THEN 'link missing' END", "CASE WHEN length(link) < 8 THEN 'link too short' END",
        "CASE WHEN NOT regexp_matches(lower(link), '^https?://[^/?#]') THEN 'link is not an absolute http url' END",
        ])}, '|') AS errors FROM (SELECT doc_id, {duck.strip(TITLES)} AS title, {duck.strip('text')} AS company, {LINKS} AS link FROM documents)""",
)
def validate_postings(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", F.expr(TITLES).alias("title"), F.col("text").alias("company"),
        F.expr(LINKS).alias("link"), "source",
    )
    return ops.validate_postings(rows).select("doc_id", pipe(F.col("errors")).alias("errors"))


POSTING_COLUMNS = "seq, title, company, location, md5(description) AS description_md5, link, array_to_string(stack, '|') AS stack, seniority"


@query("build_posting", duck.sql(f"SELECT {POSTING_COLUMNS}, source FROM postings", "postings"))
def build_posting(spark, sf):
    return postings(spark, sf).select(
        "seq", "title", "company", "location", F.md5("description").alias("description_md5"), "link",
        pipe(F.col("stack")).alias("stack"), "seniority", "source",
    )


@query(
    "build_payload",
    duck.sql(
        """SELECT seq, title, company, location, array_to_string(stack, '|') AS stack, link, source, fingerprint, content_hash, seniority,
            score, salary_min, salary_max, salary_currency, contract_type, remote_type, country, city, status,
            array_to_string(positive, '|') AS positive, array_to_string(negative, '|') AS negative FROM payloads""",
        "payloads",
    ),
)
def build_payload(spark, sf):
    p = payloads(spark, sf)
    return p.select(
        "seq", "title", "company", "location", pipe(F.col("stack")).alias("stack"), "link", "source",
        "fingerprint", "content_hash", "seniority",
        *[F.col(c).cast("double").alias(c) for c in ("score", "salary_min", "salary_max")],
        "salary_currency", "contract_type", "remote_type", "country", "city", "status",
        pipe(F.col("score_reasons.positive_reasons")).alias("positive"),
        pipe(F.col("score_reasons.negative_reasons")).alias("negative"),
    )


@query(
    "merge_raw_payload",
    """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'given' WHEN n_chars % 3 = 1 THEN md5(text) END AS description,
        CAST(CASE WHEN n_chars % 3 = 2 THEN 1 ELSE 2 END AS BIGINT) AS fields FROM documents""",
)
def merge_raw(spark, sf):
    kind = F.col("n_chars") % 3
    own = F.create_map(F.lit("lang"), F.col("lang"))
    payload = F.when(kind == 0, F.map_concat(own, F.create_map(F.lit("description"), F.lit("given")))).otherwise(own)
    description = F.when(kind == 2, "").otherwise(F.col("text"))
    merged = documents(spark, sf).select("doc_id", merge_raw_payload(payload, description).alias("m"))
    value = F.try_element_at("m", F.lit("description"))
    return merged.select(
        "doc_id",
        F.when(value == "given", value).otherwise(F.md5(value)).alias("description"),
        F.size("m").cast("bigint").alias("fields"),
    )


@query(
    "redact_columns",
    """SELECT page_id, regexp_replace(lower(split_part(url, ':', 1)) || '://owner:***@' || regexp_extract(url, '^[^:]*://(.*)$', 1), '^$', '') AS database_url,
        CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN NULL ELSE '***REDACTED***' END AS access_token,
        url AS redis_url, url AS link FROM pages""",
)
def redact_columns(spark, sf):
    rows = pages(spark, sf).select(
        "page_id",
        F.replace("url", F.lit("://"), F.lit("://owner:s3cret@")).alias("database_url"),
        F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 != 1, F.col("url")).alias("access_token"),
        F.col("url").alias("redis_url"),
        F.col("url").alias("link"),
    )
    return ops.redact_columns(rows)


# --- features -----------------------------------------------------------------------------------------


@query(
    "contains_term",
    duck.sql(
        f"SELECT seq, {duck.has_term('lower(description)', 'docker')} AS docker, {duck.has_term('lower(description)', 'Fast API')} AS fast_api, "
        f"{duck.has_term('lower(title)', 'c++')} AS cpp FROM bridge",
        "bridge",
    ),
)
def contains_term(spark, sf):
    d, t = F.col("description"), F.col("title")
    return raw(spark, sf).select(
        "seq",
        text.contains_term(d, "docker").alias("docker"),
        text.contains_term(d, "Fast API").alias("fast_api"),
        text.contains_term(t, "c++").alias("cpp"),
    )


@query("detect_stack", duck.sql(f"SELECT seq, array_to_string({duck.detect_stack('full_text')}, '|') AS stack FROM texts", "texts"))
def detect_stack(spark, sf):
    terms = TermDictionary.stack()
    return raw(spark, sf).withColumn("t", full_text()).select("seq", pipe(text.detect_stack(F.col("t"), terms)).alias("stack"))


@query("estimate_seniority", duck.sql(f"SELECT seq, {duck.seniority('full_text')} AS seniority FROM texts", "texts"))
def estimate_seniority(spark, sf):
    return raw(spark, sf).withColumn("t", full_text()).select("seq", features.estimate_seniority(F.col("t")).alias("seniority"))


@query(
    "seniority_by_priority",
    duck.sql(f"SELECT seq, {duck.first_word('full_text', duck.v.SENIORITY_PRIORITY)} AS seniority FROM texts", "texts"),
)
def seniority_by_priority(spark, sf):
    return raw(spark, sf).select("seq", features.seniority_by_priority(full_text()).alias("seniority"))


@query(
    "parse_salary",
    duck.sql(
        f"""SELECT seq, list_min(a) AS salary_min, list_max(a) AS salary_max, CASE WHEN len(a) > 0 THEN {duck.currency('description')} END AS salary_currency
            FROM (SELECT seq, description, {duck.numbers('description')} AS a FROM bridge)""",
        "bridge",
    ),
)
def parse_salary(spark, sf):
    s = raw(spark, sf).select("seq", features.parse_salary(F.col("description")).alias("s"))
    return s.select(
        "seq", F.col("s.salary_min").cast("double").alias("salary_min"),
        F.col("s.salary_max").cast("double").alias("salary_max"), "s.salary_currency",
    )


NUMBERS = r"'([0-9][0-9.,]*)'"


@query(
    "parse_number",
    f"""SELECT seq, CAST(pos - 1 AS BIGINT) AS pos, {duck.number('n')} AS amount FROM
        (SELECT seq, unnest(a) AS n, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT doc_id AS seq,
           regexp_extract_all(text, {NUMBERS}, 1) || [CAST(n_chars AS VARCHAR), n_chars || '.500,75', n_chars || ',5', n_chars || '.', '1.000.' || n_chars] AS a FROM documents))""",
)
def parse_number(spark, sf):
    n = F.col("n_chars").cast("string")
    runs = F.concat(
        F.regexp_extract_all("text", F.lit("([0-9][0-9.,]*)"), F.lit(1)),
        F.array(n, F.concat(n, F.lit(".500,75")), F.concat(n, F.lit(",5")), F.concat(n, F.lit(".")), F.concat(F.lit("1.000."), n)),
    )
    rows = documents(spark, sf).select(F.col("doc_id").alias("seq"), F.posexplode(runs).alias("pos", "n"))
    return rows.select("seq", F.col("pos").cast("bigint").alias("pos"), features.parse_number(F.col("n")).cast("double").alias("amount"))


@query("parse_currency", duck.sql(f"SELECT seq, {duck.currency('description')} AS currency FROM bridge", "bridge"))
def parse_currency(spark, sf):
    return raw(spark, sf).select("seq", features.parse_currency(F.col("description")).alias("currency"))


@query("parse_contract_type", duck.sql(f"SELECT seq, {duck.contract('title', 'description')} AS contract_type FROM bridge", "bridge"))
def parse_contract_type(spark, sf):
    return raw(spark, sf).select("seq", features.parse_contract_type(F.col("title"), F.col("description")).alias("contract_type"))


@query("parse_remote_type", duck.sql(f"SELECT seq, {duck.remote_type('location', 'description')} AS remote_type FROM bridge", "bridge"))
def parse_remote_type(spark, sf):
    return raw(spark, sf).select("seq", features.parse_remote_type(F.col("location"), F.col("description")).alias("remote_type"))


@query("parse_country", duck.sql(f"SELECT seq, {duck.country('location', 'description')} AS country FROM bridge", "bridge"))
def parse_country(spark, sf):
    return raw(spark, sf).select("seq", features.parse_country(F.col("location"), F.col("description")).alias("country"))


@query("parse_city", duck.sql(f"SELECT seq, {duck.city('location')} AS city FROM bridge", "bridge"))
def parse_city(spark, sf):
    return raw(spark, sf).select("seq", features.parse_city(F.col("location")).alias("city"))


@query(
    "parse_location",
    duck.sql(
        f"""SELECT seq, remote_type, {duck.country('location', 'description')} AS country, {duck.city('location')} AS city,
            {duck.place_name('location', 'remote_type')} AS normalized_location
            FROM (SELECT *, {duck.remote_type('location', 'description')} AS remote_type FROM bridge)""",
        "bridge",
    ),
)
def parse_location(spark, sf):
    p = raw(spark, sf).select("seq", features.parse_location(F.col("location"), F.col("description")).alias("p"))
    return p.select("seq", "p.*")


LABELLED = "description || CASE WHEN location IS NULL THEN '' ELSE ' | local : ' || location || ' | x' END || CASE WHEN company IS NULL THEN '' ELSE ' Empresa: ' || company || ' • y' END"


@query(
    "labelled_field",
    duck.sql(
        f"""SELECT seq, CASE WHEN regexp_matches(t, '(?i)local\\s*:') THEN location END AS place, company FROM (SELECT *, {LABELLED} AS t FROM bridge)""",
        "bridge",
    ),
)
def labelled_field(spark, sf):
    rows = raw(spark, sf).withColumn("t", F.expr(LABELLED))
    return rows.select(
        "seq",
        features.labelled_field(F.col("t"), ("Localização", "Local")).alias("place"),
        features.labelled_field(F.col("t"), ("Company", "Empresa")).alias("company"),
    )


# --- keys ---------------------------------------------------------------------------------------------


@query("normalize_key", duck.sql(f"SELECT seq, {duck.key('title')} AS title_key, md5({duck.key('description')}) AS description_key_md5 FROM bridge", "bridge"))
def normalize_key(spark, sf):
    both = raw(spark, sf).select("seq", keys.normalize_keys(F.col("title"), F.col("description")).alias("k"))
    return both.select("seq", F.col("k")[0].alias("title_key"), F.md5(F.col("k")[1]).alias("description_key_md5"))


@query("fingerprint", duck.sql("SELECT seq, fingerprint FROM keyed", "keyed"))
def fingerprint(spark, sf):
    return keys.with_keys(postings(spark, sf)).select("seq", "fingerprint")


@query("content_hash", duck.sql("SELECT seq, content_hash FROM keyed", "keyed"))
def content_hash(spark, sf):
    return keys.with_keys(postings(spark, sf)).select("seq", "content_hash")


# --- pages --------------------------------------------------------------------------------------------


@query(
    "visible_text",
    f"SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT page_id, {duck.page_text('html')} AS t FROM pages)",
)
def visible_text(spark, sf):
    t = pages(spark, sf).select("page_id", html.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query(
    "blocked_page_filter",
    "SELECT page_id, ("
    + " OR ".join(f"contains(lower(html), {duck.q(m)})" for m in duck.v.BLOCK_MARKERS)
    + ") AS blocked FROM pages",
)
def blocked_page_filter(spark, sf):
    from postloom.sources.pages import split_blocked

    good, blocked = split_blocked(pages(spark, sf))
    return good.select("page_id", F.lit(False).alias("blocked")).unionByName(
        blocked.select("page_id", F.lit(True).alias("blocked"))
    )


ANCHOR = r"""'<a\s[^>]*>.*?</a\s*>'"""
DROPPED = r"""'<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>'"""


@query(
    "collect_links",
    f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS pos, link FROM
        (SELECT page_id, link, min(pos) AS pos FROM
          (SELECT page_id, pos, {duck.canonical_url('absolute')} AS link FROM
            (SELECT page_id, pos, {duck.resolved('href', 'url')} AS absolute FROM
              (SELECT page_id, url, pos, {duck.unescape('''regexp_extract(a, 'href="([^"]*)"', 1)''')} AS href,
                      {duck.norm(duck.unescape("regexp_replace(a, '<[^>]*>', ' ', 'g')"))} AS label FROM
                (SELECT page_id, url, unnest(anchors) AS a, unnest(range(1, len(anchors) + 1)) AS pos FROM
                  (SELECT page_id, url, regexp_extract_all(regexp_replace(html, {DROPPED}, ' ', 'gsi'), {ANCHOR}, 0, 'si') AS anchors FROM pages)))
             WHERE contains(href, '/') AND length(label) >= 8)) GROUP BY page_id, link)""",
)
def collect_links(spark, sf):
    links = html.listing_links(F.col("html"), F.col("url"), marker="/")
    found = pages(spark, sf).select("page_id", F.posexplode(links).alias("pos", "link"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query(
    "first_of_selectors",
    f"""SELECT page_id, coalesce(nullif(h2, ''), nullif(h1, '')) AS heading FROM (SELECT page_id,
        {duck.norm(duck.unescape("regexp_replace(regexp_extract(html, '<h2[^>]*>(.*?)</h2>', 1, 's'), '<[^>]*>', ' ', 'g')"))} AS h2,
        {duck.norm(duck.unescape("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', ' ', 'g')"))} AS h1 FROM pages)""",
)
def first_of_selectors(spark, sf):
    e = pages(spark, sf).select("page_id", html.page_elements(F.col("html")).alias("e"))
    return e.select("page_id", html.first_of(F.col("e.h2"), F.col("e.h1")).alias("heading"))
