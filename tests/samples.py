"""Small literal inputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postloom.schema import as_postings

POSTING = {
    "title": "Engenheira Python Sênior para AWS",
    "company": "Lumen Rota",
    "location": "Remoto, Brasil",
    "stack": ["PostgreSQL", "Docker"],
    "link": "https://vagas.example.org/oferta/77",
    "source": "mural",
    "seniority": "senior",
    "description": "Integrações com Celery e Docker, banco PostgreSQL, vínculo CLT, faixa R$ 12.500,00 a R$ 14.000,00",
}
FIELDS = "seq bigint, title string, company string, location string, stack array<string>, link string, source string, seniority string, description string, remote_type string, salary_min decimal(12,2), salary_max decimal(12,2)"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def postings(spark, *changes: dict):
    """One posting per dict of changes to the sample posting, numbered in order."""
    rows = []
    for seq, change in enumerate(changes or ({},)):
        row = {**POSTING, "seq": seq, **change}
        rows.append(tuple(row.get(n) for n in NAMES))
    return as_postings(spark.createDataFrame(rows, ", ".join(FIELDS.split(", "))))


def evaluate(spark, *columns):
    """Values of constant expressions, through one row."""
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def text(value):
    return F.lit(value).cast("string")


ISSUE_OBJECT = {
    "id": 9081726, "number": 318, "state": "open",
    "title": "[Curitiba ou remoto] Pessoa desenvolvedora Golang plena @ Casa Ipê",
    "body": "Empresa: Casa Ipê\nLocal: Curitiba\nVamos cuidar de filas em Kafka e serviços em Golang\nFaixa: R$ 8.200 a R$ 9.700, CLT",
    "html_url": "https://issues.example.org/vagas/318", "created_at": "2026-04-11T06:30:00Z",
    "updated_at": "2026-04-20T18:45:00Z", "comments": 0, "labels": [{"name": "Golang"}, {"name": "Kafka"}],
}
ISSUE = json.dumps(ISSUE_OBJECT, ensure_ascii=False)


def card(number: int, title: str, company: str, place: str, words: str) -> str:
    """One listing card; the class names are the ones the reader looks for."""
    return (
        f'<div class="base-search-card result"><div><h3>{title}</h3></div><h4>{company}</h4>'
        f'<p><span class="job-search-card__location">{place}</span> <time datetime="2026-04-2{number % 10}T12:00:00Z">há pouco</time></p>'
        f'<blockquote>{words}</blockquote><a href="https://cartoes.example.org/jobs/view/{number}?refId=zz&utm_campaign=w">ver</a></div>'
    )


CARD = card(4711, "Analista de Dados Pleno", "Rio Fundo", "Recife, Brasil", "SQL, Python e Kubernetes; também Redis")
PAGE = """<html><head><link rel="canonical" href="https://quadro.example.org/jobs/55-especialista-django"></head><body>
<h1>Especialista Django</h1><div><img src="l.png" alt="Oficina Norte"></div><ul><li>Django</li><li>Redis</li></ul>
<p>Localização: Manaus, Brasil</p><p>Contratação PJ, modelo híbrido, de R$ 16.000 a R$ 17.500</p>
<a href="https://quadro.example.org/jobs/56-analista-de-suporte">Analista de suporte</a></body></html>"""
PAGE_LINK = "https://quadro.example.org/jobs/55-especialista-django"
