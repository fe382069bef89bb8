"""Postings derived from the ``documents`` table.

The documents hold invented prose without job words, so title, company, place and a closing
phrase are added by rules on the document's own columns.  Every row and the whole text take part.
The SQL is the same text in Spark and in the checking engine.  Exact copies of a document get
equal keys, documents of one length and language share a fingerprint, neighbours share a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEVELS = ("Senior ", "Sênior ", "Sr. ", "Pleno ", "Jr ", "")
TECHS = (
    "Python", "Java", "Django Rest Framework", "FastAPI", "Node.js", "Golang", "C++", "PHP",
    "React", "Data", "Python & PostgreSQL",
)
LOCATIONS = ("Remote Brazil", "Recife, Brasil", "Porto, Portugal", None, "Curitiba/PR - híbrido")
PHRASES = (
    "Faixa de R$ 8.250,50 a R$ 12.900,75 por mês, PJ, trabalho 100% remoto.",
    "Pay: USD 7300 a month, remote contractor; Python with PostgreSQL",
    "CLT híbrido com Docker.",
    "Estágio presencial; Django Rest Framework, CI CD",
    "Anywhere. FastAPI, Redis, Celery, AWS; pessoa jurídica",
    "frontend only presencial obrigatório, node.js and C++",
    "Kubernetes, Kafka e RabbitMQ em empresa brasileira, salário 180k",
    "",
    "Postgres, fast api, golang / restful; especialista",
)


def _pick(number: str, values) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if x is None else "'" + x.replace("'", "''") + "'")
        for i, x in enumerate(values)
    )
    return f"CASE {number} % {len(values)} {cases} END"


BRIDGE_SQL = f"""
SELECT doc_id AS seq,
       source,
       lang,
       {_pick('n_chars', LEVELS)} || {_pick('n_chars', TECHS)} || ' Engineer ' || CAST(n_chars AS STRING) AS title,
       CASE WHEN n_chars % 7 = 0 THEN NULL
            ELSE 'Company ' || upper(lang) || ' ' || CAST(n_chars % 40 AS STRING) END AS company,
       {_pick('n_chars', LOCATIONS)} AS location,
       text || ' ' || {_pick('n_chars', PHRASES)} AS description,
       'HTTPS://Boards.Example.com/jobs/' || CAST(doc_id - doc_id % 3 AS STRING)
           || '/?utm_source=feed&ref=' || lang || '#top' AS link,
       CAST('2026-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE AS published_at
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spark.sql(BRIDGE_SQL.replace("FROM documents", "FROM {documents}"), documents=documents)
