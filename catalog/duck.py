"""Checking SQL, written from the rules and not from the Spark expressions.

Its regular expressions know no look-around, so whole-term tests consume the neighbour character.
"""

from __future__ import annotations

from catalog.bridge import BRIDGE_SQL
from postloom import vocabulary as v
from postloom.profile import MatchProfile, TermDictionary, canonical_term, squeeze

W = r"\p{L}\p{N}_"
S = r"\t-\r\x1c-\x20\x85\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def esc(text: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$/-#" else c for c in text)


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{S}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def text_of(*xs: str) -> str:
    return f"lower({norm('concat_ws(' + repr(' ') + ', ' + ', '.join(xs) + ')')})"


def has_term(x: str, *terms: str) -> str:
    either = "|".join(esc(squeeze(t)) for t in terms)
    return f"regexp_matches({x}, {q(f'(^|[^{W}+#.])({either})($|[^{W}+#.])')})"


def has_word(x: str, words) -> str:
    either = "|".join(esc(w) for w in words)
    return f"regexp_matches({x}, {q(f'(^|[^{W}])({either})($|[^{W}])')})"


def compact(items) -> str:
    return f"list_filter([{', '.join(items)}], lambda z: z IS NOT NULL)"


def detect_stack(x: str) -> str:
    d = TermDictionary.stack()
    return compact(
        f"CASE WHEN {has_term(x, *d.entries[e])} THEN {q(d.name(e))} END" for e in sorted(d.entries)
    )


def seniority(x: str) -> str:
    hits = [
        f"CASE WHEN {has_term(x, w)} THEN {{'at': strpos({x}, {q(w)}), 'rank': {i}, 'level': {q(lvl)}}} END"
        for i, (lvl, words) in enumerate(v.SENIORITY_KEYWORDS.items())
        for w in words
    ]
    return f"list_sort({compact(hits)})[1].level"


def first_word(x: str, groups) -> str:
    whens = " ".join(f"WHEN {has_word(x, words)} THEN {q(n)}" for n, words in groups.items())
    return f"CASE {whens} END"


def contract(*xs: str) -> str:
    return first_word(f"lower(concat_ws(' ', {', '.join(xs)}))", v.CONTRACT_WORDS)


def place_text(loc: str, desc: str) -> str:
    return f"lower(concat_ws(' ', {loc}, {desc}))"


def remote_type(loc: str, desc: str) -> str:
    return first_word(place_text(loc, desc), v.REMOTE_WORDS)


def country(loc: str, desc: str) -> str:
    return (
        f"CASE WHEN {has_word(place_text(loc, desc), v.HOME_COUNTRY_WORDS)} THEN '{v.HOME_COUNTRY}' "
        f"WHEN contains({loc}, ',') THEN nullif({strip(f'list_last(string_split({loc}, {q(chr(44))}))')}, '') END"
    )


def city(loc: str) -> str:
    first = strip(f"regexp_extract({loc}, '^([^,/|-]*)', 1)")
    out = ", ".join(q(w) for w in v.NOT_A_CITY)
    return f"CASE WHEN {first} <> '' AND lower({first}) NOT IN ({out}) THEN left({first}, 120) END"


def place_name(loc: str, remote: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.REMOTE_LABELS.items())
    return f"coalesce(nullif({norm(loc)}, ''), CASE {remote} {cases} END)"


def number(r: str) -> str:
    plain = (
        f"CASE WHEN contains({r}, ',') AND contains({r}, '.') THEN replace(replace({r}, '.', ''), ',', '.') "
        f"ELSE replace({r}, ',', '.') END"
    )
    value = f"TRY_CAST({plain} AS DECIMAL(38,10))"
    scaled = f"CASE WHEN {value} < 100 THEN {value} * 1000 ELSE {value} END"
    # Doubles of this size hold no cents; rounding them would only add noise.
    return f"CASE WHEN {value} >= 1e12 THEN CAST({value} AS DOUBLE) ELSE round_even(CAST({scaled} AS DOUBLE), 2) END"


def numbers(x: str) -> str:
    runs = f"regexp_extract_all(coalesce({x}, ''), '([0-9][0-9.,]{{2,}})', 1)"
    return f"list_filter(list_transform({runs}, lambda r: {number('r')}), lambda z: z IS NOT NULL)"


def currency(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN contains({low}, 'usd') OR contains({low}, 'us$') THEN 'USD' "
        f"WHEN contains({low}, 'brl') OR contains({low}, 'r$') THEN 'BRL' "
        f"WHEN contains({low}, '$') THEN 'USD' END"
    )


def canonical_url(u: str) -> str:
    scheme = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
    rest = f"regexp_replace({u}, '{scheme}', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^(//[^/?#]*)?([^?#]*)', 2), ';[^/]*$', '')"
    short = f"rtrim({path}, '/')"
    query = f"regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1)"
    keys = ", ".join(q(k) for k in v.TRACKING_PARAMETERS)

    def part(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def again(x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    name, value = part("split_part(p, '=', 1)"), part("substr(p, strpos(p, '=') + 1)")
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND {name} NOT IN ({keys}))"
    )
    clean = f"array_to_string(list_transform({kept}, lambda p: {again(name)} || '=' || {again(value)}), '&')"
    head = f"lower(regexp_extract({u}, '{scheme}', 1))"
    host = f"lower(regexp_extract({rest}, '^//([^/?#]*)', 1))"
    return (
        f"(CASE WHEN {head} = '' THEN '' ELSE {head} || ':' END || CASE WHEN {host} = '' THEN '' ELSE '//' || {host} END "
        f"|| CASE WHEN {short} = '' THEN {path} ELSE {short} END "
        f"|| CASE WHEN {clean} = '' THEN '' ELSE '?' || {clean} END)"
    )


def resolved(href: str, base: str) -> str:
    origin = f"regexp_extract({base}, '^([^:]+://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_extract({path}, '^(.*/)', 1), ''), '/')"
    return (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
        f"WHEN {href} LIKE '//%' THEN regexp_extract({base}, '^([^:]+:)', 1) || {href} "
        f"WHEN {href} LIKE '/%' THEN {origin} || {href} "
        f"WHEN {href} LIKE '#%' THEN regexp_extract({base}, '^([^#]*)', 1) || {href} "
        f"WHEN {href} LIKE '?%' THEN {origin} || {path} || {href} "
        f"ELSE {origin} || {folder} || {href} END"
    )


def unescape(x: str) -> str:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&copy;", "©"),
        ("&middot;", "·"),
    ):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"  # this one needs no semicolon


MARKUP = (
    r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"""|<[a-zA-Z/!?]([^"'>]+|"[^"]*"|'[^']*')*>"""
)


def page_text(x: str) -> str:
    return norm(unescape(f"regexp_replace({x}, {q(MARKUP)}, ' ', 'gsi')"))


def key(x: str) -> str:
    t = f"lower(strip_accents(coalesce({x}, '')))"
    # The neighbour is consumed and put back, so repeated neighbours need two passes.
    for level, pattern in (("senior", r"sr"), ("junior", r"jr"), ("pleno", r"mid[- ]?level")):
        for _ in range(2):
            if level != "pleno":
                t = f"regexp_replace({t}, '(^|[^{W}]){pattern}\\.([{W}])', '\\1{level}\\2', 'g')"
            t = f"regexp_replace({t}, '(^|[^{W}]){pattern}($|[^{W}])', '\\1{level}\\2', 'g')"
    return f"trim(regexp_replace({t}, '[^{W}]+', ' ', 'g'))"


def stack_words(x: str) -> str:
    return f"array_to_string(list_sort({x}, 'ASC'), ' ')"


def money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def html(x: str) -> str:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        x = f"replace({x}, {q(char)}, {q(entity)})"
    return x


def format_salary(low: str, high: str, cur: str) -> str:
    unit = html(f"coalesce({cur}, '')")
    return (
        f"CASE WHEN {low} <> 0 AND {high} <> 0 THEN {html(f'trim({unit} || {q(chr(32))} || {money(low)} || {q(chr(32)+chr(45)+chr(32))} || {money(high)})')} "
        f"WHEN {low} <> 0 THEN {html(f'trim({unit} || {q(chr(32))} || {money(low)})')} ELSE {q(v.REPORT_NOT_INFORMED)} END"
    )


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# --- scoring ---------------------------------------------------------------------------------------


def score_columns(p: MatchProfile) -> tuple[str, str, str, str]:
    """SELECT lists of four stages: hits, per-tech scores, context, results."""
    must = [canonical_term(t) for t in p.must_have]
    techs = list(dict.fromkeys([*must, *[canonical_term(t) for t in p.nice_to_have]]))
    d = TermDictionary.of(techs, v.REASON_DISPLAY)
    names = [q(d.name(t)) for t in techs]
    texts = ", ".join(
        f"lower({norm(x)}) AS {n}"
        for n, x in (("s_title", "title"), ("s_stack", "array_to_string(stack, ' ')"), ("s_desc", "description"), ("s_loc", "location"))
    )
    per_tech, best = [], 0.0
    for t in techs:
        m = v.MUST_HAVE_FACTOR if t in must else 1.0
        best += 35.0 * m
        terms = d.entries[t]
        parts = " + ".join(
            f"CASE WHEN {has_term(n, *terms)} THEN {w * m!r}::DOUBLE ELSE 0.0::DOUBLE END"
            for n, w in (("s_title", 18.0), ("s_stack", 12.0), ("s_desc", 5.0))
        )
        per_tech.append(f"least({parts}, {35.0 * m!r}::DOUBLE)")
    tech = f"[{', '.join(per_tech)}]" if per_tech else "[]::DOUBLE[]"
    tech += " AS tech, concat_ws(' ', s_title, s_stack, s_desc, s_loc) AS combined"

    found = "lower(coalesce(nullif(seniority, ''), 'unknown'))"
    wanted = p.seniority
    if wanted == "any":
        factor = "1.0::DOUBLE"
    else:
        matrix = " ".join(f"WHEN {found} = '{k}' THEN {x}" for k, x in v.SENIORITY_FACTORS.get(wanted, {}).items())
        factor = f"CAST(CASE WHEN {found} = 'unknown' THEN 0.85 WHEN {found} = '{wanted}' THEN 1.0 {matrix} ELSE 0.5 END AS DOUBLE)"
    total = " + ".join(f"tech[{i + 1}]" for i in range(len(techs))) or "0.0"
    near = " OR ".join(has_term("combined", x) for x in p.preferred_locations) or "false"
    negative = [(k, has_term("combined", k)) for k in p.negative_keywords]
    missing_must = compact(f"CASE WHEN tech[{techs.index(t) + 1}] <= 0 THEN {q(d.name(t))} END" for t in must) if must else "[]::VARCHAR[]"
    context = f"""
      {compact(f'CASE WHEN tech[{i + 1}] > 0 THEN {n} END' for i, n in enumerate(names))} AS matched,
      {compact(f'CASE WHEN tech[{i + 1}] <= 0 THEN {n} END' for i, n in enumerate(names))} AS missing,
      {missing_must} AS missing_must,
      ({total}) / {best!r} * 100.0 AS base, {factor} AS factor,
      (lower(coalesce(remote_type, '')) IN ('remote', 'remoto') OR contains(combined, 'remot')) AS remote,
      ({near}) AS near,
      (coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0) AS paid,
      [{', '.join(f'CASE WHEN {c} THEN {q(k)} END' for k, c in negative)}]::VARCHAR[] AS bad_words"""
    not_remote = "NOT remote" if p.remote_only else "false"
    bonus = "CASE WHEN remote THEN 7.0 ELSE 0.0 END + CASE WHEN near THEN 4.0 ELSE 0.0 END + CASE WHEN paid THEN 4.0 ELSE 0.0 END"
    penalty = (
        f"CASE WHEN {not_remote} THEN 20.0 ELSE 0.0 END + CASE WHEN paid THEN 0.0 ELSE 3.0 END "
        "+ 12.0 * len(list_filter(bad_words, lambda z: z IS NOT NULL)) + CASE WHEN len(missing_must) > 0 THEN 25.0 ELSE 0.0 END"
    )
    level = f"coalesce(nullif(seniority, ''), '{v.REASON_SENIORITY_UNKNOWN}')"
    positive = compact([
        f"CASE WHEN len(matched) > 0 THEN {q(v.REASON_FOUND)} || array_to_string(matched, ', ') END",
        f"CASE WHEN factor = 1 THEN {q(v.REASON_SENIORITY_FITS)} || {level} END",
        f"CASE WHEN remote THEN {q(v.REASON_REMOTE)} END",
        f"CASE WHEN near THEN {q(v.REASON_LOCATION)} END",
        f"CASE WHEN paid THEN {q(v.REASON_SALARY)} END",
    ])
    negatives = f"""list_concat({compact([
        f"CASE WHEN len(missing) > 0 THEN {q(v.REASON_NOT_FOUND)} || array_to_string(missing, ', ') END",
        f"CASE WHEN len(missing_must) > 0 THEN {q(v.REASON_MISSING_MUST)} || array_to_string(missing_must, ', ') END",
        f"CASE WHEN factor = 0 THEN {q(v.REASON_SENIORITY_MISFIT)} || {level} WHEN factor <> 1 THEN {q(v.REASON_SENIORITY_PENALTY)} || {level} END",
        f"CASE WHEN {not_remote} THEN {q(v.REASON_NOT_REMOTE)} END",
        f"CASE WHEN NOT paid THEN {q(v.REASON_NO_SALARY)} END",
    ])}, list_transform(list_filter(bad_words, lambda z: z IS NOT NULL), lambda z: {q(v.REASON_NEGATIVE)} || z))"""
    results = f"""CAST({bonus} AS DOUBLE) AS bonus, CAST({penalty} AS DOUBLE) AS penalty,
      round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, base * factor + CAST({bonus} AS DOUBLE) - CAST({penalty} AS DOUBLE))), 2) AS score,
      {positive} AS positive, {negatives} AS negative"""
    return texts, tech, context, results


def scored(source: str, p: MatchProfile | None = None) -> str:
    """FROM-able subquery: ``source`` plus all score columns."""
    texts, tech, context, results = score_columns(p or MatchProfile())
    return (
        f"(SELECT *, {results} FROM (SELECT *, {context} FROM (SELECT *, {tech} FROM (SELECT *, {texts} FROM {source}))))"
    )


# --- derived tables ----------------------------------------------------------------------------------

SALARY_NULLS = "CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, CAST(NULL AS VARCHAR) AS remote_type"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bridge": ((), BRIDGE_SQL),
    "texts": (("bridge",), f"SELECT *, {text_of('title', 'description')} AS full_text FROM bridge"),
    "postings": (
        ("texts",),
        f"""SELECT seq, source, {norm('title')} AS title, nullif({norm('company')}, '') AS company,
            nullif({norm('location')}, '') AS location, nullif({norm('description')}, '') AS description,
            {canonical_url('link')} AS link, published_at, {detect_stack('full_text')} AS stack,
            {seniority('full_text')} AS seniority, {SALARY_NULLS} FROM texts""",
    ),
    "key_parts": (
        ("postings",),
        f"""SELECT *, {key('title')} AS k1, {key('company')} AS k2, {key('location')} AS k3,
            {key('seniority')} AS k4, {key(stack_words('list_transform(stack, lambda z: z)'))} AS k5,
            {key('description')} AS k6 FROM postings""",
    ),
    "keyed": (
        ("key_parts",),
        """SELECT * EXCLUDE (k1, k2, k3, k4, k5, k6),
            sha256(k1 || '|' || k2 || '|' || k3 || '|' || k4) AS fingerprint,
            sha256(k1 || '|' || k2 || '|' || k3 || '|' || k5 || '|' || k6) AS content_hash FROM key_parts""",
    ),
    "scored": (("keyed",), f"SELECT * FROM {scored('keyed')}"),
    "parsed": (
        ("scored",),
        f"""SELECT *, {numbers('description')} AS amounts, {currency('description')} AS cur,
            {remote_type('location', 'description')} AS remote_found FROM scored""",
    ),
    "payloads": (
        ("parsed",),
        f"""SELECT seq, left(title, 300) AS title, company, {place_name('location', 'remote_found')} AS location,
            stack, link, source, CAST(NULL AS VARCHAR) AS external_id, fingerprint, content_hash, published_at,
            seniority, score, matched, missing, factor, positive, negative, description,
            CASE WHEN list_min(amounts) < 1e10 THEN list_min(amounts) END AS salary_min,
            CASE WHEN list_max(amounts) < 1e10 THEN list_max(amounts) END AS salary_max,
            CASE WHEN len(amounts) > 0 THEN cur END AS salary_currency,
            {contract('title', 'description')} AS contract_type, remote_found AS remote_type,
            {country('location', 'description')} AS country, {city('location')} AS city, 'active' AS status
            FROM parsed""",
    ),
    # The store: all sightings of a link folded to its latest values.
    "store": (
        ("payloads",),
        """SELECT p.* EXCLUDE (seq), f.id, f.created_at, f.last_seen_at, f.last_seen_at AS updated_at, f.seen_count
            FROM payloads p JOIN (SELECT link, min(seq) AS id, max(seq) AS last_seq, min(published_at) AS created_at,
                max(published_at) AS last_seen_at, count(*) AS seen_count FROM payloads GROUP BY link) f
            ON p.link = f.link AND p.seq = f.last_seq""",
    ),
    # What was stored before (documents with a label) and the batch that arrives (the others).
    "old_payloads": (("payloads",), "SELECT * FROM payloads WHERE seq IN (SELECT doc_id FROM labels)"),
    "new_payloads": (("payloads",), "SELECT * FROM payloads WHERE seq NOT IN (SELECT doc_id FROM labels)"),
    "old_store": (
        ("old_payloads",),
        """SELECT p.* EXCLUDE (seq), f.id, f.created_at, f.last_seen_at, f.last_seen_at AS updated_at, f.seen_count
            FROM old_payloads p JOIN (SELECT link, min(seq) AS id, max(seq) AS last_seq, min(published_at) AS created_at,
                max(published_at) AS last_seen_at, count(*) AS seen_count FROM old_payloads GROUP BY link) f
            ON p.link = f.link AND p.seq = f.last_seq""",
    ),
    "batch": (
        ("new_payloads",),
        "SELECT * FROM new_payloads WHERE seq IN (SELECT max(seq) FROM new_payloads GROUP BY link)",
    ),
    "kept": (
        ("keyed",),
        """SELECT seq FROM (
            WITH RECURSIVE ordered AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, link, fingerprint, content_hash FROM keyed),
            walk AS (
              SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS fs, CAST([] AS VARCHAR[]) AS hs
              UNION ALL
              SELECT n, CASE WHEN dup THEN NULL ELSE oseq END, CASE WHEN dup THEN ls ELSE list_append(ls, link) END,
                     CASE WHEN dup THEN fs ELSE list_append(fs, fingerprint) END, CASE WHEN dup THEN hs ELSE list_append(hs, content_hash) END
              FROM (SELECT o.n, o.seq AS oseq, o.link, o.fingerprint, o.content_hash, w.ls, w.fs, w.hs,
                           list_contains(w.ls, o.link) OR list_contains(w.fs, o.fingerprint) OR list_contains(w.hs, o.content_hash) AS dup
                    FROM walk w JOIN ordered o ON o.n = w.n + 1))
            SELECT seq FROM walk WHERE seq IS NOT NULL)""",
    ),
}


def sql(select: str, *tables: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with the derived tables it names, and theirs, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in CTES[name][0]:
            visit(needed)
        order.append(name)

    for t in tables:
        visit(t)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({s})" for n, s in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
