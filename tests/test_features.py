"""Literal cases of the column functions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.functions import batches, features, html, keys, urls
from postloom.functions import text as tx
from postloom.operators import postings as ops
from postloom.operators import report, scoring
from postloom.profile import MatchProfile, TermDictionary, canonical_term
from tests.samples import evaluate, text


def one(spark, column):
    return evaluate(spark, column)[0]


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("HTTP://Vagas.Example.ORG/oferta/9/?area=ti&utm_medium=mail#topo", "http://vagas.example.org/oferta/9?area=ti"),
        ("  https://a.example/x;p=1;q?b=2&a=1&empty=&novalue  ", "https://a.example/x?b=2&a=1"),
        ("https://a.example/", "https://a.example/"),
        ("https://a.example", "https://a.example"),
        ("https://a.example/x///", "https://a.example/x"),
        ("https://a.example/?q=a%20b+c*~&utm_sourcex=1&UTM_SOURCE=2", "https://a.example/?q=a+b+c%2A~&utm_sourcex=1&UTM_SOURCE=2"),
        ("https://a.example/?q=50%&r=%zz", "https://a.example/?q=50%25&r=%25zz"),
        ("https://a.example/?t=S%C3%A3o&x=a=b", "https://a.example/?t=S%C3%A3o&x=a%3Db"),
        ("/jobs/1?trk=a", "/jobs/1"),
        ("sem endereço", "sem endereço"),
    ],
)
def test_canonicalize_url(spark, url, wanted):
    assert one(spark, urls.canonicalize_url(text(url))) == wanted


@pytest.mark.parametrize(
    "href, wanted",
    [
        ("/a/b", "https://h.example/a/b"),
        ("c", "https://h.example/x/c"),
        ("../c?d=1#e", "https://h.example/c?d=1#e"),
        ("./c/./d/..", "https://h.example/x/c/"),
        ("//o.example/z", "https://o.example/z"),
        ("http://o.example", "http://o.example"),
        ("?p=2", "https://h.example/x/y?p=2"),
        ("#top", "https://h.example/x/y?q=1#top"),
        ("", "https://h.example/x/y?q=1"),
    ],
)
def test_resolve_url(spark, href, wanted):
    assert one(spark, urls.resolve_url(text(href), F.lit("https://h.example/x/y?q=1"))) == wanted


def test_resolve_url_against_a_bare_host(spark):
    assert one(spark, urls.resolve_url(text("jobs/1"), F.lit("https://h.example"))) == "https://h.example/jobs/1"


def test_redact_url(spark):
    got = evaluate(
        spark,
        urls.redact_url(text("mysql+driver://ana:s3nha@db.example:3306/loja")),
        urls.redact_url(text("redis://:pw@Host/0?x=1")),
        urls.redact_url(text("https://example.com/a@b")),
    )
    assert got == ["mysql+driver://ana:***@db.example:3306/loja", "redis://***:***@host/0?x=1", "https://example.com/a@b"]


def test_normalize_text_and_stack(spark):
    got = evaluate(
        spark,
        tx.normalize_text(text(" a \t\n\xa0 b　c ")),
        tx.normalize_text(text(None)),
        tx.normalize_stack(F.array(*[F.lit(x) for x in ("Kafka", "KAFKA", "", " Go ")])),
        tx.title_case(F.lit("rest api-x k8s")),
    )
    assert got == ["a b c", "", ["Kafka", "Go"], "Rest Api-X K8S"]


def test_contains_term(spark):
    got = evaluate(
        spark,
        tx.contains_term(text("Time de Kafka e filas"), "kafka"),
        tx.contains_term(text("mongodb"), "mongo"),
        tx.contains_term(text("with Docker."), "docker"),
        tx.contains_term(text("C++ and C#"), "c"),
        tx.contains_term(text("django \n rest  framework"), "Django Rest Framework"),
        tx.contains_term(text("ESTÁGIO"), "estágio"),
    )
    assert got == [True, False, False, False, True, True]


def detect(text_value, *extra):
    return tx.detect_stack(tx.joined(text(text_value)), TermDictionary.stack(extra or ()))


def test_detect_stack(spark):
    got = evaluate(
        spark,
        detect("Buscamos Django Rest Framework sobre PostgreSQL, com CI CD em Python", "Django"),
        detect("node.js nodejs; Java, javascript and go"),
        detect("docker-compose, mysql and php"),
        detect("we use Postgres and Elm, not elmo", "elm", "postgres"),
        detect(None),
        detect("node js"),
    )
    assert got == [
        ["CI/CD", "Django", "PostgreSQL", "Python", "Rest"],
        ["Go", "Java", "Javascript", "Node.js"],
        ["Docker", "Mysql", "Php"],
        ["Elm", "Postgres", "PostgreSQL"],
        [],
        ["Javascript", "Node.js"],
    ]


def test_terms_that_start_with_other_terms(spark):
    terms = TermDictionary({"python": ("python",), "python backend": ("python backend",)})
    got = evaluate(
        spark,
        tx.detect_stack(F.lit("a python backend"), terms),
        tx.detect_stack(F.lit("a python backends"), terms),
    )
    assert got == [["Python", "Python Backend"], ["Python"]]


def test_seniority(spark):
    def level(value):
        return features.estimate_seniority(tx.joined(text(value)))

    got = evaluate(
        spark, level("Arquiteta sênior"), level("engineer, mid-level"), level("programa de trainee"), level("infraestrutura"),
        level("lead or junior"), level("desrespeito sr junior"), features.seniority_by_priority(text("Senior e JR")), level(None),
    )
    # "sr" stands inside "desrespeito" too, which decides its position once it matches as a term.
    assert got == ["senior", "pleno", "junior", None, "senior", "senior", "junior", None]


@pytest.mark.parametrize(
    "value, low, high, unit",
    [
        ("paga de R$ 7.250,50 até R$ 9.100,00", "7250.50", "9100.00", "BRL"),
        ("USD 6400 monthly", "6400.00", "6400.00", "USD"),
        ("", None, None, None),
        (None, None, None, None),
        ("R$ only", None, None, None),
        ("10.000 a 100.000", "100.00", "10000.00", None),
        ("up to 180k $", "180.00", "180.00", "USD"),
        ("1.000.000 or 10.000.", None, None, None),
        ("123,445 123,455", "123.44", "123.46", None),
    ],
)
def test_parse_salary(spark, value, low, high, unit):
    got = one(spark, features.parse_salary(text(value)))
    money = [None if x is None else Decimal(x) for x in (low, high)]
    assert [got.salary_min, got.salary_max, got.salary_currency] == [*money, unit]


@pytest.mark.parametrize(
    "location, description, wanted",
    [
        (None, "trabalho remoto, time no Brazil", ("remote", "Brazil", None, "Remote")),
        ("Belém, Brasil", "modelo híbrido", ("hybrid", "Brazil", "Belém", "Belém, Brasil")),
        ("Porto, Portugal", "vaga presencial", ("onsite", "Portugal", "Porto", "Porto, Portugal")),
        ("Remote from Brazil", None, ("remote", "Brazil", "Remote from Brazil", "Remote from Brazil")),
        ("Remoto", "", ("remote", None, None, "Remoto")),
        (None, "on site", ("onsite", None, None, "On-site")),
        (None, None, (None, None, None, None)),
    ],
)
def test_parse_location(spark, location, description, wanted):
    assert tuple(one(spark, features.parse_location(text(location), text(description)))) == wanted


def test_contract_type(spark):
    words = ("regime PJ", "vínculo CLT integral", "busca freelancer", "vaga de estágio", "a combinar", "pessoa jurídica")
    got = evaluate(spark, *[features.parse_contract_type(text(w)) for w in words])
    assert got == ["pj", "clt", "freelancer", "internship", None, "pj"]


def test_issue_fields(spark):
    company, place = features.company_from_issue, features.location_from_issue
    got = evaluate(
        spark,
        company(text("Dev @ Casa Ipê | x"), text("")),
        company(text("Dev"), text("a\n  Empresa - Foo  Bar \nb")),
        company(text("Dev"), text("## Company\n\nBaz\n")),
        company(text("Dev"), text("nothing")),
        place(text("[ Remoto ] Dev"), text("Local: X"), text("")),
        place(text("Dev"), text("a\nLocalização: Recife\n"), text("")),
        place(text("Dev"), text("a\nRemoto no Brasil\n"), text("")),
        place(text("Dev"), text("a"), text("Remote ok")),
        place(text("Dev"), text("a"), text("")),
    )
    assert got == ["Casa Ipê", "Foo Bar", "Baz", None, "Remoto", "Recife", "Remoto no Brasil", "Remoto", None]


def test_labelled_field(spark):
    got = evaluate(
        spark,
        features.labelled_field(text("x Local : Recife | y"), ("Localização", "Local")),
        features.labelled_field(text("Local:x"), ("Local",)),
        features.labelled_field(text("empresa: Foo • z"), ("Company", "Empresa")),
    )
    assert got == ["Recife", None, "Foo"]


def test_key_texts_finish_what_is_ascii_once_folded(spark):
    values = ["Sênior  Dev\t(Sr.dev, sr)", "a\u00a0b ﬁm ①", "mid-level_x mid-level", "sr.", "msr jr", "", "ação – Jr", "日本 Sr"]
    done = batches.key_texts(pa.array([values, None, []], pa.list_(pa.string()))).to_pylist()
    assert done[0][:6] == ["senior dev seniordev senior", "a b fim 1", "mid level_x pleno", "senior", "msr junior", ""]
    assert done[0][6:] == ["acao – Jr", "日本 Sr"]  # folded; letters beyond ASCII are told apart in the JVM
    in_jvm = keys._words(keys.fold_accents(F.array(*[text(x) for x in values])))
    both = evaluate(spark, in_jvm, keys.normalize_keys(*[text(x) for x in values]))
    assert list(both[0]) == list(both[1])


def test_tidy_text_is_not_built_anew(spark):
    pattern = tx._LOOSE
    values = ["a b c", "a  b", "a\tb", " a", "a \u2003b", "a\u3000b"]
    assert evaluate(spark, *[text(x).rlike(pattern) for x in values]) == [False, True, True, False, True, True]
    words = tx.loose(tx.NO_WORD)
    assert evaluate(spark, text("one two").rlike(words), text("one, two").rlike(words)) == [False, True]


def test_terms_after_odd_characters(spark):
    values = ["python", "xpython", "éphp", "(php)", "🐍python", "𝒂python", ".php", "c#php", "php php"]
    found = [tx.spellings_in(text(x), ["php", "python"]) for x in values]
    want = [["python"], [], [], ["php"], ["python"], ["python"], [], [], ["php"]]
    assert [list(r) for r in evaluate(spark, *found)] == want


def test_normalize_key(spark):
    values = ("Líder Kafka Sênior", "LÍDER  kafka SR.", "a|b_c", "mid-level x", "Jr.x ﬁ ²", None, "midlevel,mid level")
    got = evaluate(spark, *[keys.normalize_key(text(x)) for x in values])
    assert got == ["lider kafka senior", "lider kafka senior", "a b_c", "pleno x", "juniorx fi 2", "", "pleno pleno"]


def test_safe_datetime(spark):
    values = ("2026-05-01T10:00:00Z", "2026-05-01T10:00:00-03:00", "2026-05-01", "20260501", "1 day ago", "", None)
    got = evaluate(spark, *[ops.safe_datetime(text(x)).cast("string") for x in values])
    assert got == ["2026-05-01 10:00:00", "2026-05-01 13:00:00", "2026-05-01 00:00:00", "2026-05-01 00:00:00", None, None, None]


def test_html_functions(spark):
    page = '<p>a&eacute;b &amp;lt; <b>x</b><script>var t="</p>";</script><!-- <i>c</i> --><i title="1 > 2">y</i></p>'
    got = evaluate(
        spark, html.visible_text(text(page)), html.is_blocked(text("<html>Captcha</html>")), html.is_blocked(text("ok")),
        tx.html_escape(text("<script>\"&'")), html.visible_text(text(None)),
    )
    assert got == ["aéb &lt; x y", True, False, "&lt;script&gt;&quot;&amp;&#x27;", ""]


def test_listing_links(spark):
    page = (
        "<a href='/jobs/1-x/?utm_source=a'>A long <b>label</b></a><a href=/jobs/2>short</a>"
        '<a class="c" href="https://o.example/jobs/3?a=1&amp;b=2">another label</a><a href="/other">another label</a>'
        '<a data-href="/jobs/9" href="/jobs/1-x">the same again</a><!-- <a href="/jobs/8">commented out</a> -->'
    )
    got = one(spark, html.listing_links(text(page), F.lit("https://h.example")))
    assert got == ["https://h.example/jobs/1-x", "https://o.example/jobs/3?a=1&b=2"]


def test_format_salary(spark):
    d = lambda x: F.lit(x).cast("decimal(12,2)")
    got = evaluate(
        spark,
        report.format_salary(d(10000), d(15500), text("BRL")),
        report.format_salary(d(10000), d(None), text(None)),
        report.format_salary(d(0), d(5), text("BRL")),
        report.format_salary(d(None), d(5), text("BRL")),
    )
    assert got == ["BRL 10,000.00 - 15,500.00", "10,000.00", "não informado", "não informado"]


def test_strip_report_html(spark):
    got = one(spark, report.strip_report_html(text('<b>x &amp;lt;</b><br><a href="u">Abrir vaga</a>')))
    assert got == "x &lt;\nu - Abrir vaga"


def test_canonical_tech(spark):
    assert canonical_term("Postgres") == "postgresql" and canonical_term(" Fast  API ") == "fastapi"
    got = evaluate(spark, *[scoring.canonical_tech(text(x)) for x in ("Postgres", " Fast  API ", "Elm")])
    assert got == ["postgresql", "fastapi", "elm"]


def test_seniority_factor(spark):
    f = scoring.seniority_factor
    got = evaluate(spark, f(text("junior"), "senior"), f(text(None), "senior"), f(text("x"), "any"), f(text("lead"), "pleno"))
    assert got == [0.0, 0.85, 1.0, 0.5]


def test_profile_is_checked():
    with pytest.raises(ValueError):
        MatchProfile(seniority="boss")
    with pytest.raises(ValueError):
        MatchProfile(min_score=101)


def test_redact_columns(spark):
    rows = spark.createDataFrame(
        [("t", "", None, "redis://u:p@h/0", "plain", dt.date(2026, 1, 1))],
        "bot_token string, email_password string, app_secret string, redis_url string, title string, token_day date",
    )
    assert tuple(ops.redact_columns(rows).first()) == ("***REDACTED***", "", None, "redis://u:***@h/0", "plain", "***REDACTED***")


def test_elements(spark):
    page = (
        "<h1>a<1 &amp; b&eacute;</h1><h2>x<!-- c -->y</h2><template><p>hidden</p></template>"
        "<li>Python<li>Go</ul><span class='my-tags'>Java</span><p class=tag>Redis</p>"
    )
    got = one(spark, html.page_elements(text(page)))
    assert (got.h1, got.h2) == ("a<1 & bé", "x y") and "hidden" not in got.text
    assert got.chips == ["Python Go Java Redis", "Go Java Redis", "Java", "Redis"]
    assert one(spark, html.page_elements(text(None))).text == ""
