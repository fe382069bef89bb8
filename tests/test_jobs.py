"""Validation, scoring, store, serving, reports, sources, the daily run and the stream."""

from __future__ import annotations

import csv
import dataclasses
import datetime as dt
import json
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postloom.functions import html
from postloom.operators import postings as ops
from postloom.operators import ordering, report, scoring, serve
from postloom.operators import store as state
from postloom.plans.daily_run import RunSettings, numbered, run
from postloom.profile import MatchProfile
from postloom.schema import POSTING_DDL
from postloom.session import materialize, shared_folder
from postloom.sinks import exports
from postloom.sources import issues, pages, registry
from postloom.sources import store as stored
from postloom.sources.store import read_store, write_store
from postloom.streaming import incremental
from tests.samples import CARD, ISSUE, ISSUE_OBJECT, PAGE, PAGE_LINK, POSTING, card, evaluate, postings, text

NOW = dt.datetime(2026, 5, 10, 8)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- validation and scoring ----------------------------------------------------------------------------


def test_validation_rejects_with_reasons(spark):
    df = postings(
        spark,
        {"title": " Analista SQL ", "stack": ["Kafka", "kafka", " "]},
        {"title": "x", "link": "not-url"},
        {"company": "c" * 201, "link": None},
        {"link": "https:///x/y"},
    )
    good, bad = ops.split_valid(df)
    assert rows(good, "title", "stack") == [("Analista SQL", ["Kafka"])]
    assert [r.errors for r in bad.orderBy("seq").collect()] == [
        ["title too short", "link too short", "link is not an absolute http url"],
        ["company too long", "link missing"],
        ["link is not an absolute http url"],
    ]


def score(spark, profile=None, **change):
    return scoring.score_postings(postings(spark, change), profile).first()


def test_score_of_the_sample_posting(spark):
    r = score(spark)
    # By hand: Python 18 * 1.35, PostgreSQL (12 + 5) * 1.35, AWS 18, Docker 12 + 5, Celery 5, of 269.5;
    # 7 more for remote work, 3 less without a salary.
    assert r.score == round(100 * (24.3 + 22.95 + 18 + 17 + 5) / 269.5 + 7 - 3, 2) == 36.37
    assert r.score_reasons.seniority_factor == 1.0
    assert r.score_reasons.matched_techs == ["Python", "PostgreSQL", "Docker", "AWS", "Celery"]
    assert r.score_reasons.positive_reasons == [
        "encontrou Python, PostgreSQL, Docker, AWS, Celery", "senioridade compatível: senior", "vaga remota",
    ]
    assert r.score_reasons.negative_reasons == ["não encontrou FastAPI, Redis", "salário não informado"]


def test_score_explains_and_penalises(spark):
    p = MatchProfile(must_have=("Python",), nice_to_have=("Docker",), negative_keywords=(), preferred_locations=())
    clean = score(spark, p)
    words = MatchProfile(
        must_have=("Python",), nice_to_have=("Docker",), preferred_locations=(),
        negative_keywords=("plantão noturno", "viagens semanais"),
    )
    hit = score(spark, words, description="Serviços em Python; plantão noturno e viagens semanais")
    assert hit.score < clean.score
    assert [r for r in hit.score_reasons.negative_reasons if r.startswith("palavra")] == [
        "palavra negativa encontrada: plantão noturno", "palavra negativa encontrada: viagens semanais",
    ]
    junior = score(spark, seniority="junior", title="Junior Dev", location=None, description="x", stack=["Go"])
    assert junior.score == 0.0 and "faltam tecnologias obrigatórias: Python, PostgreSQL" in junior.score_reasons.negative_reasons
    far = score(spark, MatchProfile(remote_only=True), location="Recife", description="Python")
    assert "vaga não parece remota" in far.score_reasons.negative_reasons


def test_score_without_wishes(spark):
    r = score(spark, MatchProfile(must_have=(), nice_to_have=(" ",)))
    assert r.score == 0.0 and r.score_reasons.negative_reasons == ["stack desejada não configurada"]
    assert score(spark, MatchProfile(must_have=(), nice_to_have=("RabbitMQ",))).score_reasons.missing_techs == ["Rabbitmq"]


def test_score_simple(spark):
    assert scoring.score_simple(postings(spark, {}), ["Python", "Docker", "PostgreSQL"]).first().score > 50


def test_payload_of_the_sample_posting(spark):
    p = scoring.build_payloads(postings(spark, {})).first()
    assert (p.salary_min, p.salary_max, p.salary_currency) == (Decimal("12500.00"), Decimal("14000.00"), "BRL")
    assert (p.contract_type, p.remote_type, p.country, p.city, p.status) == ("clt", "remote", "Brazil", None, "active")
    assert p.score == Decimal("36.37") and p.raw_payload["description"].startswith("Integrações com")


def test_payload_prefers_given_values_but_zero_is_missing(spark):
    p = scoring.build_payloads(
        postings(spark, {"salary_min": Decimal("0"), "salary_max": Decimal("5"), "remote_type": "hybrid", "location": None})
    ).first()
    assert (p.salary_min, p.salary_max, p.remote_type, p.location) == (Decimal("12500.00"), Decimal("5.00"), "hybrid", None)
    huge = scoring.build_payloads(postings(spark, {"description": "call 5511999999999"})).first()
    assert huge.salary_min is None


# --- store -----------------------------------------------------------------------------------------------


def first_snapshot(spark):
    payloads = scoring.build_payloads(postings(spark, {}, {"link": "https://vagas.example.org/oferta/78", "title": "Go Dev"}))
    return state.snapshot_of(payloads.withColumn("seen_at", F.lit(NOW)))


@pytest.mark.parametrize("small", [True, False])
def test_upsert(spark, small):
    before = first_snapshot(spark)
    changed = postings(spark, {"title": "Líder Python"}, {"link": "https://vagas.example.org/oferta/79"})
    batch = scoring.build_payloads(changed).withColumn("id", F.col("seq") + 10).drop("seq")
    later = NOW + dt.timedelta(days=1)
    after = state.upsert_postings(before, batch, later, small)
    assert sorted(rows(after, "id", "link", "title", "seen_count", "created_at", "last_seen_at")) == [
        (0, "https://vagas.example.org/oferta/77", "Líder Python", 2, NOW, later),
        (1, "https://vagas.example.org/oferta/78", "Go Dev", 1, NOW, NOW),
        (11, "https://vagas.example.org/oferta/79", POSTING["title"], 1, later, later),
    ]
    assert rows(state.upsert_counts(before, batch), "affected", "inserted", "updated") == [(2, 1, 1)]
    assert after.schema["score"].dataType == before.schema["score"].dataType


def test_small_upsert_does_not_shuffle_untouched_rows(spark):
    before = materialize(first_snapshot(spark), "before")
    batch = scoring.build_payloads(postings(spark, {})).withColumn("id", F.col("seq")).drop("seq")
    plan = state.upsert_postings(before, batch, NOW, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Union")[1].split("Exchange")[0]


def test_upsert_refuses_a_link_twice(spark):
    batch = scoring.build_payloads(postings(spark, {}, {"title": "other"})).withColumn("id", F.col("seq")).drop("seq")
    with pytest.raises(ValueError):
        state.upsert_postings(first_snapshot(spark), batch, NOW)


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    store = str(tmp_path / "store")
    many = postings(spark, *[{"link": f"https://vagas.example.org/oferta/{i}", "title": f"Vaga {i}"} for i in range(20)])
    payloads = scoring.build_payloads(many).withColumn("id", F.col("seq")).drop("seq")
    empty = state.payload_defaults(payloads, NOW).withColumn("created_at", F.col("updated_at")).limit(0)
    assert stored.current_store(spark, store) is None
    assert stored.upsert_store(spark, store, payloads, empty, NOW, 1, 8) == {"affected": 20, "inserted": 20, "updated": 0}
    first, later = stored.pointer(spark, store), NOW + dt.timedelta(days=1)
    again = payloads.filter("id = 3").unionByName(payloads.filter("id = 4").withColumns({"link": F.lit("https://vagas.example.org/oferta/new"), "id": F.lit(99)}))
    assert stored.upsert_store(spark, store, again, empty, later, 2, 8) == {"affected": 2, "inserted": 1, "updated": 1}
    second = stored.pointer(spark, store)
    hit = {r[0] for r in again.select(F.pmod(stored.by_link(), F.lit(8))).distinct().collect()}
    assert {b for b in {*first, *second} if first.get(b) != second.get(b)} == {(8, b) for b in hit}
    after = {r.id: r for r in stored.current_store(spark, store).collect()}
    assert len(after) == 21 and after[3].seen_count == 2 and after[99].created_at == later and after[5].last_seen_at == NOW
    assert stored.upsert_store(spark, store, again.limit(0), empty, later, 3, 8)["affected"] == 0
    assert stored.pointer(spark, store) == second


def test_two_runs_with_one_version_lose_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    many = postings(spark, *[{"link": f"https://vagas.example.org/oferta/{i}", "title": f"Vaga {i}"} for i in range(20)])
    payloads = scoring.build_payloads(many).withColumn("id", F.col("seq")).drop("seq")
    empty = state.payload_defaults(payloads, NOW).withColumn("created_at", F.col("updated_at")).limit(0)
    stored.upsert_store(spark, store, payloads, empty, NOW, 5, 8)
    (tmp_path / "store" / "pointers" / "v=6").mkdir()  # a pointer whose run did not finish
    for version in (5, 1):
        told = stored.upsert_store(spark, store, payloads.filter("id = 3"), empty, NOW, version, 8)
        assert told == {"affected": 1, "inserted": 0, "updated": 1}
    after = {r.id: r.seen_count for r in stored.current_store(spark, store).collect()}
    assert len(after) == 20 and after.pop(3) == 3 and set(after.values()) == {1}


def test_mark_seen_counts_every_mark(spark):
    later = NOW + dt.timedelta(days=1)
    ids = spark.createDataFrame([(0,), (0,)], "id bigint")
    got = sorted(rows(state.mark_seen(first_snapshot(spark), ids, later), "id", "seen_count", "last_seen_at"))
    assert got == [(0, 3, later), (1, 1, NOW)]


def test_fold_sightings(spark):
    log = spark.createDataFrame(
        [("a", 1, "x", NOW), ("a", 2, "y", NOW), ("b", 3, "z", NOW), ("a", 4, "w", NOW - dt.timedelta(days=1))],
        "link string, seq bigint, title string, seen_at timestamp",
    )
    got = sorted(rows(state.fold_sightings(log), "link", "title", "seen_count", "created_at", "last_seen_at", "first_seq"))
    assert got == [("a", "y", 3, NOW - dt.timedelta(days=1), NOW, 1), ("b", "z", 1, NOW, NOW, 3)]
    plan = state.fold_sightings(log)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_run_log(spark):
    start = spark.createDataFrame([(1, NOW), (2, NOW)], "id bigint, started_at timestamp")
    stats = spark.createDataFrame(
        [(1, 1, "bad", False, None, "blocked"), (1, 0, "good", True, 3, None), (2, 0, "bad", False, None, "boom")],
        "id bigint, source_rank int, source string, ok boolean, found bigint, error string",
    )
    status = state.run_status(stats, "id")
    assert sorted(rows(status, "id", "sources_scraped", "jobs_found", "status", "error_message")) == [
        (1, 1, 3, "success", "bad: blocked"), (2, 0, 0, "failed", "bad: boom"),
    ]
    done = status.filter("id = 1").withColumns({"finished_at": F.lit(NOW), "jobs_new": F.lit(2)})
    log = state.run_log_view(state.run_log_create(start).unionByName(state.run_log_finish(done)))
    assert sorted(rows(log, "id", "status", "jobs_new", "started_at", "finished_at")) == [
        (1, "success", 2, NOW, NOW), (2, "pending", 0, NOW, None),
    ]
    none = state.run_status(stats.filter("id = 3").withColumn("id", F.lit(3)))
    assert rows(none, "status", "error_message") == [("failed", "No source was successfully scraped")]


# --- serve -------------------------------------------------------------------------------------------------


def test_reads(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_store(first_snapshot(spark), folder)
    store = read_store(spark, folder)
    assert [r.id for r in serve.top_jobs(store, 1).collect()] == [0]
    assert serve.top_jobs(store, 500, 36.371).count() == 0 and serve.top_jobs(store, 500, 36.37).count() == 1
    assert [r.title for r in serve.job_by_id(store, 1).collect()] == ["Go Dev"] and serve.job_by_id(store, 7).isEmpty()
    assert rows(serve.metrics_summary(store), "total_jobs", "top_score", "last_seen_at") == [(2, 36.37, NOW)]
    assert rows(serve.metrics_summary(store.limit(0)), "total_jobs", "top_score") == [(0, 0.0)]
    assert serve.recently_seen(store).columns == ["id", "title", "company", "score", "seen_count", "last_seen_at"]
    assert dict(serve.project_job_read(store).dtypes)["score"] == "double"
    assert serve.recent_jobs(store, 100_000).count() == 2
    with pytest.raises(ValueError):
        serve.recent_jobs(store, 0)
    plan = serve.top_jobs(store, 10, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(score,50.00)" in plan


def test_executions_without_start_come_first(spark):
    log = spark.createDataFrame([(1, NOW), (2, None)], "id bigint, started_at timestamp")
    assert [r.id for r in serve.recent_executions(log).collect()] == [2, 1]


def test_cap_per_source_limits_inside_the_map_tasks(spark):
    df = spark.range(1000, numPartitions=4).select(F.col("id").alias("seq"), F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("source"))
    capped = serve.cap_per_source(df, 3)
    assert sorted(r.seq for r in capped.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


# --- reports and exports -------------------------------------------------------------------------------------


def test_report(spark):
    store = first_snapshot(spark).withColumn("title", F.lit("<script>alert(1)</script>")).withColumn("company", F.lit(""))
    got = report.daily_report(serve.top_jobs(store, 10, 0), 1, NOW.date()).first()
    assert got.report.startswith("🤖 <b>Daily Report – 2026-05-10</b>\n\n<b>1. &lt;script&gt;alert(1)&lt;/script&gt;</b>\nEmpresa: Empresa não informada\n")
    assert "Score: 36.37\nMotivos:\n- encontrou" in got.report
    assert got.report.endswith('">Abrir vaga</a>\n\n<b>Total de vagas novas hoje: 1</b>') and got.jobs == 2
    empty = report.daily_report(store.limit(0), 0, NOW.date()).first()
    assert empty.report.split("\n")[2:] == ["Nenhuma vaga nova compatível encontrada nesta execução.", "", "<b>Total de vagas novas hoje: 0</b>"]
    assert evaluate(spark, report.report_gate(F.lit(0)), report.report_gate(F.lit(0), True)) == ["skipped_empty", "sent"]


def packed(message, limit=4096, size=3800):
    """The packing rule, step by step."""
    if len(message) <= limit:
        return [message]
    chunks, current = [], ""
    for line in message.splitlines(keepends=True):
        if current and len(current) + len(line) > size:
            chunks.append(current)
            current = ""
        current += line
    return [*chunks, current] if current else chunks


def test_chunks_equal_the_packing_rule(spark):
    import random

    rng = random.Random(7)
    texts = ["x\n" * 5000, "short", "a" * 5000, "\n" * 20, ""]
    for _ in range(40):
        ends = ["\n", "\r\n", "\r", "\x0b", " ", "\x85", "", "\n\n"]
        texts.append("".join("é" * rng.randrange(9) + rng.choice(ends) for _ in range(rng.randrange(40))))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for limit, size in ((4096, 3800), (20, 15), (5, 3)):
        got = df.select("id", report.chunk_by_lines(F.col("text"), limit, size).alias("c")).collect()
        for r in got:
            assert r.c == packed(texts[r.id], limit, size), (limit, size, texts[r.id])


def part(folder: str, suffix: str) -> list[Path]:
    return sorted(Path(folder).glob(f"part-*{suffix}"))


def test_exports(spark, tmp_path):
    store = first_snapshot(spark).withColumn("company", F.lit('A "quoted", name')).withColumn("location", F.lit(None).cast("string"))
    csv_path = exports.export_jobs(store, str(tmp_path / "c"), "csv")
    records = [r for f in part(csv_path, ".csv") for r in csv.DictReader(f.open(encoding="utf-8"))]
    assert {r["id"] for r in records} == {"0", "1"} and records[0]["company"] == 'A "quoted", name' and records[0]["location"] == ""
    json_path = exports.export_jobs(store, str(tmp_path / "j"), "json")
    found = [json.loads(line) for f in part(json_path, ".json") for line in f.open(encoding="utf-8")]
    one = next(r for r in found if r["id"] == 0)
    assert one["score"] == 36.37 and one["location"] is None and one["created_at"].startswith("2026-05-10T08:00:00")
    md_path = exports.export_jobs(store, str(tmp_path / "m"), "markdown")
    page = "".join(f.read_text(encoding="utf-8") for f in part(md_path, ".txt"))
    assert page.startswith("# Daily Report\n\n## 1. Engenheira Python Sênior para AWS\n\n- Empresa: A \"quoted\", name\n- Local: não informado\n- Score: 36.37\n- Link: https://")
    with pytest.raises(ValueError):
        exports.export_jobs(store, str(tmp_path / "x"), "xml")


# --- sources ---------------------------------------------------------------------------------------------------


def test_issue(spark):
    lines = spark.createDataFrame(
        [(ISSUE,), ('{"id": 1, "pull_request": null, "title": "x"}',), ("{broken",)], "value string"
    )
    parsed = issues.parse_issues(lines)
    assert parsed.filter("corrupt").count() == 1
    p = issues.issue_postings(issues.drop_pull_requests(parsed.filter("NOT corrupt"))).collect()
    assert len(p) == 1
    p = p[0]
    assert (p.company, p.location, p.external_id, p.seniority) == ("Casa Ipê", "Curitiba ou remoto", "318", None)
    assert p.stack == ["Go", "Kafka"] and p.raw_payload["issue_number"] == "318"
    assert p.link == "https://issues.example.org/vagas/318" and p.published_at == dt.datetime(2026, 4, 11, 6, 30)
    pay = scoring.build_payloads(issues.issue_postings(parsed.filter("NOT corrupt AND id > 1")).withColumn("seq", F.lit(0))).first()
    assert (pay.salary_min, pay.salary_max, pay.salary_currency) == (Decimal("8200.00"), Decimal("9700.00"), "BRL")
    assert (pay.contract_type, pay.remote_type, pay.country) == ("clt", "remote", None)
    assert issues.open_since(parsed, dt.datetime(2026, 5, 4, 18, 45), 14).count() == 1
    assert issues.open_since(parsed, dt.datetime(2026, 5, 4, 18, 46), 14).count() == 0


def test_card(spark):
    df = spark.createDataFrame([(CARD,), ("<div><h3>no link</h3></div>",), (None,)], "html string")
    got = pages.card_postings(df).collect()
    assert len(got) == 1
    c = got[0]
    assert (c.title, c.company, c.location, c.external_id) == ("Analista de Dados Pleno", "Rio Fundo", "Recife, Brasil", "4711")
    assert c.link == "https://cartoes.example.org/jobs/view/4711" and c.stack == ["Kubernetes", "Python", "Redis"]
    assert c.published_at == dt.datetime(2026, 4, 21, 12) and c.seniority == "pleno"


def test_all_cards_of_a_page_are_read(spark):
    second = card(4712, "Suporte a login e redes", "Rede Sul", "Lisboa, Portugal", "telas de login e Linux")
    listed = "<ul class='jobs-search__results-list'>" + "".join(f"<li><h3>Vaga {i}</h3><a href='https://e.example/jobs/view/{i}'>x</a></li>" for i in (1, 2, 3)) + "</ul>"
    df = spark.createDataFrame([(f"<body>{CARD}<p>between</p>{second}</body>",), (listed,)], "html string")
    got = pages.card_postings(df).collect()
    assert [(c.external_id, c.title) for c in got] == [
        ("4711", "Analista de Dados Pleno"), ("4712", "Suporte a login e redes"), ("1", "Vaga 1"), ("2", "Vaga 2"), ("3", "Vaga 3"),
    ]
    assert "Rede Sul" not in got[0].description and "Rio Fundo" not in got[1].description


def test_walls_are_kept_as_rejects_and_cards_that_say_login_are_read(spark, tmp_path):
    (tmp_path / "a.html").write_text(CARD + card(9, "Equipe de login", "B", "Natal", "checkpoint de acesso"), encoding="utf-8")
    (tmp_path / "b.html").write_text("<html><form>please sign in</form></html>", encoding="utf-8")
    good, bad = ops.split_valid(pages.read_cards(spark, str(tmp_path)))
    assert sorted(r.external_id for r in good.collect()) == ["4711", "9"]
    wall = bad.first()
    assert bad.count() == 1 and wall.raw_payload == {"parser": "blocked page"} and wall.landed_file.endswith("b.html")


def test_issue_files_of_all_layouts_give_equal_rows(spark, tmp_path):
    records = [{**ISSUE_OBJECT, "number": n, "html_url": f"https://issues.example.org/vagas/{n}"} for n in (1, 2, 3)]
    layouts = {
        "lines": "\n".join(json.dumps(r) for r in records) + "\n\n{broken\n",
        "array": json.dumps(records),
        "pretty": json.dumps(records, indent=2),
    }
    found = {}
    for name, content in layouts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(content, encoding="utf-8")
        read = issues.read_issues(spark, str(tmp_path / name)).orderBy("landed_row")
        found[name] = rows(read.filter("external_id != ''"), "title", "company", "link", "external_id", "stack", "published_at", "raw_payload")
    assert found["lines"] == found["array"] == found["pretty"] and len(found["lines"]) == 3
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.json").write_text(json.dumps(records[0], indent=1), encoding="utf-8")
    assert rows(issues.read_issues(spark, str(tmp_path / "one")), "external_id") == [("1",)]
    _, bad = ops.split_valid(issues.read_issues(spark, str(tmp_path / "lines")))
    assert [r.description for r in bad.collect()] == ["{broken"]


def test_state_and_age_of_issues(spark, tmp_path):
    old = {**ISSUE_OBJECT, "number": 2, "updated_at": "2020-01-01T00:00:00Z"}
    closed = {**ISSUE_OBJECT, "number": 3, "state": "closed"}
    (tmp_path / "x.json").write_text(json.dumps([ISSUE_OBJECT, old, closed]), encoding="utf-8")
    read = issues.read_issues(spark, str(tmp_path), as_of=dt.datetime(2026, 5, 1))
    assert rows(read, "external_id") == [("318",)]


def test_a_folder_of_detail_pages_has_links(spark, tmp_path):
    (tmp_path / "named.html").write_text(PAGE, encoding="utf-8")
    (tmp_path / "listed.html").write_text("<h1>Vaga Redis</h1>", encoding="utf-8")
    manifest = spark.createDataFrame([("listed.html", "https://quadro.example.org/jobs/60-redis")], "file string, link string")
    good, bad = ops.split_valid(pages.read_details(spark, str(tmp_path), manifest=manifest))
    assert sorted(r.link for r in good.collect()) == [PAGE_LINK, "https://quadro.example.org/jobs/60-redis"] and bad.isEmpty()


def test_detail_page(spark):
    df = spark.createDataFrame([(PAGE_LINK, PAGE), (PAGE_LINK, "<h1> Vagas </h1>"), ("https://x.example/jobs/9-go-dev/", "<p>no title</p>")], "link string, html string")
    d, other = pages.detail_postings(df).orderBy("external_id").collect()
    assert (d.title, d.company, d.location, d.seniority) == ("Especialista Django", "Oficina Norte", None, "senior")
    assert d.stack == ["Django", "Redis"] and d.external_id == "55-especialista-django"
    assert (d.salary_min, d.salary_max, d.salary_currency) == (Decimal("16000.00"), Decimal("17500.00"), "BRL")
    assert (d.contract_type, d.remote_type, d.country, d.city) == ("pj", "hybrid", "Brazil", None)
    assert other.title == "Go Dev"
    labelled = pages.detail_postings(df.limit(1), use_labels=True).first()
    assert labelled.location.startswith("Manaus, Brasil")


def test_page_links(spark):
    got = evaluate(spark, html.listing_links(text(PAGE), F.lit("https://quadro.example.org")))
    assert got == [["https://quadro.example.org/jobs/56-analista-de-suporte"]]


def test_company_from_page_lines(spark):
    got = evaluate(
        spark,
        pages.company_from_page(text("Site"), text(""), text("Vaga\nDev\n\n Casa Ipê \nx"), site="site"),
        pages.company_from_page(text(None), text("Empresa: Foo | x"), text(""), use_labels=True),
        pages.company_from_page(text("A"), text(""), text("vaga\nx")),
    )
    assert got == ["Casa Ipê", "Foo", None]


def test_blocked_pages_go_aside(spark):
    df = spark.createDataFrame([("<html>captcha checkpoint</html>",), ("<p>fine</p>",)], "html string")
    good, blocked = pages.split_blocked(df)
    assert good.count() == 1 and blocked.count() == 1


def test_one_failing_source_does_not_stop_the_others(spark):
    registry.register_source(" Good ", lambda s, p: postings(s, {"source": "good"}))

    def broken(s, p):
        raise RuntimeError("blocked")

    registry.register_source("bad", broken)
    assert registry.select_sources(["GOOD ", "nope", "bad"]) == ["good", "bad"]
    union = registry.union_sources(spark, {"good": "", "bad": ""})
    assert union.postings.count() == 1
    stats = rows(state.run_status(union.per_source()), "sources_scraped", "jobs_found", "errors", "status")
    assert stats == [(1, 1, ["bad: blocked"], "success")]
    alone = registry.union_sources(spark, {"bad": ""})
    assert rows(state.run_status(alone.per_source()), "sources_scraped", "errors", "status") == [(0, ["bad: blocked"], "failed")]
    assert rows(serve.per_source_counts(union.postings), "source", "jobs") == [("good", 1)]


# --- runs --------------------------------------------------------------------------------------------------------


def landed(tmp_path):
    (tmp_path / "issues").mkdir()
    (tmp_path / "issues" / "a.json").write_text(ISSUE + "\n" + ISSUE.replace("/318", "/319") + "\n", encoding="utf-8")
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "a.html").write_text(CARD, encoding="utf-8")
    return {"issues": str(tmp_path / "issues"), "cards": str(tmp_path / "cards"), "details": str(tmp_path / "missing")}


def test_daily_run(spark, tmp_path):
    settings = RunSettings(paths=landed(tmp_path), now=NOW, profile=MatchProfile(min_score=0))
    first = run(spark, settings, None)
    done = first.summary.first()
    assert (done.sources_scraped, done.jobs_found, done.affected, done.inserted, done.status) == (2, 3, 2, 2, "success")
    assert done.error_message.startswith("details: ")
    assert sorted(rows(first.snapshot, "source", "seen_count")) == [("cards", 1), ("issues", 1)]
    again = run(spark, dataclasses.replace(settings, now=NOW + dt.timedelta(days=1)), first.snapshot)
    assert rows(again.summary, "affected", "inserted", "updated") == [(2, 0, 2)]
    assert {r.seen_count for r in again.snapshot.collect()} == {2}
    told = again.report.first()
    assert told.notification_status == "sent" and "Total de vagas novas hoje: 2" in told.report
    dry = run(spark, settings, None, dry_run=True)
    assert dry.snapshot is None and dry.summary.first().status == "dry_run" and dry.top.count() >= 1


def test_daily_run_on_a_store(spark, tmp_path):
    """Versions, log and filters; a run that fails leaves the store as it was and closes its log entry."""
    folder, places = str(tmp_path / "store"), landed(tmp_path)
    settings = RunSettings(
        paths=places, now=NOW, profile=MatchProfile(min_score=0), store=folder, run_id=1, finished=NOW,
        reader_options={"issues": {"as_of": dt.datetime(2026, 4, 30)}, "cards": {"as_of": dt.datetime(2026, 4, 22)}},
    )
    first = run(spark, settings)
    assert rows(first.summary, "affected", "inserted", "status") == [(2, 2, "success")]
    (tmp_path / "issues" / "b.json").write_text(json.dumps([{**ISSUE_OBJECT, "number": 7, "state": "closed", "html_url": "https://issues.example.org/7"}]), encoding="utf-8")
    again = run(spark, dataclasses.replace(settings, now=NOW + dt.timedelta(days=1), run_id=2))
    assert rows(again.summary, "affected", "inserted", "updated") == [(2, 0, 2)]
    assert {r.seen_count for r in stored.current_store(spark, folder).collect()} == {2}

    def broken(text):
        raise RuntimeError("no report today")

    before = stored.pointer(spark, folder)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("postloom.plans.daily_run.upsert_store", lambda *a: broken(a))
        with pytest.raises(RuntimeError):
            run(spark, dataclasses.replace(settings, run_id=3))
    assert stored.pointer(spark, folder) == before
    log = {r.id: r for r in stored.read_log(spark, folder).collect()}
    assert [(log[i].status, log[i].jobs_new) for i in (1, 2, 3)] == [("success", 2), ("success", 2), ("failed", 0)]
    assert log[1].error_message.startswith("details: ") and "no report today" in log[3].error_message
    assert log[1].finished_at == NOW


def test_a_damaged_file_fails_its_source_alone(spark, tmp_path):
    places = landed(tmp_path)
    (tmp_path / "pages.parquet").mkdir()
    spark.createDataFrame([(PAGE_LINK, PAGE)], "link string, html string").write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    whole = next((tmp_path / "pages.parquet").glob("part-*"))
    (tmp_path / "pages.parquet" / "part-x.parquet").write_bytes(whole.read_bytes()[:-40])
    result = run(spark, RunSettings(paths={**places, "details": str(tmp_path / "pages.parquet")}, now=NOW))
    done = result.summary.first()
    assert (done.sources_scraped, done.jobs_found, done.status) == (2, 3, "success") and done.error_message.startswith("details: ")


def test_order_of_arrival_is_that_of_the_files(spark, tmp_path):
    """Sizes and packing of files do not matter: a.json comes before a much larger b.json."""
    record = lambda n: json.dumps({**ISSUE_OBJECT, "number": n, "html_url": f"https://issues.example.org/{n}", "title": f"Vaga {n}"})
    (tmp_path / "a.json").write_text(record(1), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n".join(record(n) for n in range(2, 500)), encoding="utf-8")
    read = issues.read_issues(spark, str(tmp_path))
    numbers = numbered(read.withColumn("source_rank", F.lit(0))).orderBy("seq").select("external_id").collect()
    assert [int(r.external_id) for r in numbers] == list(range(1, 500))


def test_stream_does_not_depend_on_the_files_per_batch(spark, tmp_path):
    """Three files with duplicates among them: one batch for all, or one each."""
    source = str(tmp_path / "in")
    for changes in (
        [{}, {"link": "https://v.example/2", "title": "Dev B"}],
        [{"link": "https://v.example/3"}, {"title": "Dev C"}],  # same content; same link
        [{"link": "https://v.example/4", "title": "Dev B"}, {"link": "https://v.example/5", "title": "Dev D"}],
    ):
        postings(spark, *changes).coalesce(1).drop("seq").write.mode("append").parquet(source)
    files = sorted(Path(source).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    for i, file in enumerate(files):  # names in the order of landing
        file.rename(file.with_name(f"f{i}.parquet"))
    got = {}
    for files_per_batch in (1, 100):
        store = str(tmp_path / f"store{files_per_batch}")
        stream = incremental.read_landed(spark, source, POSTING_DDL, files_per_batch)
        incremental.incremental_ingest(stream, store, str(tmp_path / f"progress{files_per_batch}"), now=NOW)
        got[files_per_batch] = sorted(rows(incremental.current(spark, store), "link", "title", "score", "seen_count"))
    assert got[1] == got[100] and [r[1] for r in got[1]] == ["Dev B", "Dev D", POSTING["title"]]
    now = incremental.current(spark, str(tmp_path / "store1"))
    assert serve.project_job_dict(now).count() == serve.project_job_read(now).count() == now.select("id").distinct().count() == 3


def test_stream_applies_every_batch_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    stream = lambda: incremental.read_landed(spark, source, POSTING_DDL)
    postings(spark, {}, {"title": "x"}).write.parquet(source)
    incremental.incremental_ingest(stream(), store, str(tmp_path / "progress"), now=NOW)
    postings(spark, {"title": "Senior Python Lead"}, {"link": "https://vagas.example.org/oferta/2", "company": "B"}).write.mode("append").parquet(source)
    later = NOW + dt.timedelta(days=1)
    incremental.incremental_ingest(stream(), store, str(tmp_path / "progress"), now=later)
    got = sorted(rows(incremental.current(spark, store), "link", "title", "seen_count", "created_at", "last_seen_at"))
    assert got == [
        ("https://vagas.example.org/oferta/2", POSTING["title"], 1, later, later),
        ("https://vagas.example.org/oferta/77", "Senior Python Lead", 2, NOW, later),
    ]
    # A retry of the last batch overwrites its own folder only.
    batch = spark.read.schema(POSTING_DDL).parquet(source).filter("title = 'Senior Python Lead' OR company = 'B'")
    incremental.apply_batch(batch, 1, store, later)
    assert sorted(rows(incremental.current(spark, store), "link", "title", "seen_count", "created_at", "last_seen_at")) == got
    assert spark.read.parquet(f"{store}/rejects").count() == 1


def session_with(folder: str | None, master: str):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )


def test_shared_folder(spark):
    assert shared_folder(session_with("hdfs://shared/x/", "spark://host:7077")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        shared_folder(session_with(None, "spark://host:7077"))
    local = session_with(None, "local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 7).repartition(6)
    placed = ordering.number_rows(rows, "n", F.desc("k"), "id", start=1)
    want = sorted(((i % 7, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.id) for r in placed.orderBy("n").collect()] == want
    assert sorted(r.n for r in placed.collect()) == list(range(1, 5001))
    assert ordering.number_rows(rows.where("false"), "n", "id").collect() == []


def test_markdown_sections_do_not_meet_in_one_task(spark, tmp_path):
    jobs = spark.range(3000).select(
        F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("location"),
        F.lit(1.0).alias("score"), F.format_string("https://x/%05d", "id").alias("link"), F.lit(NOW).cast("timestamp").alias("created_at"),
    )
    sections = exports.markdown_sections(jobs.repartition(8))
    assert "SinglePartition" not in sections._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    # Only the counts of the ranges pass a window.
    assert sections._jdf.queryExecution().executedPlan().toString().count("SinglePartition") == 1
    path = exports.export_markdown(jobs.repartition(8), str(tmp_path / "page"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "page").glob("part-*")))
    heads = [line for line in text.splitlines() if line.startswith("#")]
    assert heads == ["# Daily Report", *[f"## {i + 1}. t{i}" for i in range(3000)]] and path


def landed_batch(spark, links, version):
    rows = postings(spark, *[{"link": f"https://vagas.example.org/oferta/{i}", "title": f"Vaga {i} v{version}", "company": f"C{i}", "description": f"texto {i} {version}"} for i in links])
    return rows.drop("seq")


def test_compacted_sightings_are_the_fold_of_all(spark, tmp_path):
    stores = {name: str(tmp_path / name) for name in ("plain", "compacted")}
    days = [range(0, 6), range(3, 9), range(0, 2), range(8, 12)]
    columns = "link", "id", "title", "seen_count", "created_at", "last_seen_at"
    for number, links in enumerate(days):
        for name, store in stores.items():
            batch = materialize(landed_batch(spark, links, number), "landed")
            # The third batch is seen at an earlier time than the second.
            seen = NOW + dt.timedelta(days=(0, 2, 1, 3)[number])
            incremental.apply_batch(batch, number, store, seen, run=f"day {number}")
            if name == "compacted" and number in (1, 2):
                assert incremental.compact(spark, store) == number - 1
    got = {name: sorted(map(str, incremental.current(spark, store).select(*columns).collect())) for name, store in stores.items()}
    assert got["plain"] == got["compacted"] and len(got["plain"]) == 12
    compacted = stores["compacted"]
    assert incremental.compact(spark, compacted, 3) == 3 == incremental.compact(spark, compacted, 2)
    assert sorted(map(str, incremental.current(spark, compacted).select(*columns).collect())) == got["plain"]
    read = incremental.current(spark, compacted).inputFiles()
    assert read and all("/base/upto=3" in f for f in read)
    # A later batch is folded onto the base, and a retry of it changes nothing.
    for _ in range(2):
        incremental.apply_batch(materialize(landed_batch(spark, [0, 50], 9), "landed"), 4, compacted, NOW + dt.timedelta(days=9), run="day 9")
    after = {r.link[-3:]: r for r in incremental.current(spark, compacted).collect()}
    assert len(after) == 13 and after["a/0"].seen_count == 3 and after["a/0"].title == "Vaga 0 v9"
    assert len({r.id for r in after.values()}) == 13


def test_a_micro_batch_reads_only_the_keys_of_its_run(spark, tmp_path):
    store = str(tmp_path / "store")
    for number, run_name in enumerate(["old/1", "old/1", "new 2"]):
        incremental.apply_batch(materialize(landed_batch(spark, [number], number), "landed"), number, store, NOW, run=run_name)
    kept = incremental._kept_before(spark, store, 3, "new 2")
    assert kept.columns == ["link", "fingerprint", "content_hash"] and kept.count() == 1
    assert all("run=new%202/batch=2/" in f.replace("%2520", "%20") for f in kept.inputFiles())
    assert incremental._kept_before(spark, store, 2, "new 2") is None
    assert incremental._kept_before(spark, store, 1, "old/1").count() == 1
