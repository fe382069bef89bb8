"""Dictionaries, word lists and texts of the listing domain.

Everything in this module is a FIXED VALUE: results are only right when these words, numbers
and formats are used as they stand.  No logic lives here.
"""

from __future__ import annotations

# --- fixed values: technologies and the spellings that count as each of them -----------------
TECH_ALIASES: dict[str, tuple[str, ...]] = {
    "python": ("python", "python3"),
    "django": ("django", "django rest framework", "drf"),
    "fastapi": ("fastapi", "fast api"),
    "flask": ("flask",),
    "postgresql": ("postgresql", "postgres", "postgre sql"),
    "mysql": ("mysql", "mariadb"),
    "mongodb": ("mongodb", "mongo db"),
    "redis": ("redis",),
    "celery": ("celery",),
    "docker": ("docker", "docker-compose", "docker compose"),
    "kubernetes": ("kubernetes", "k8s"),
    "aws": ("aws", "amazon web services", "lambda", "ecs", "eks", "s3"),
    "gcp": ("gcp", "google cloud"),
    "azure": ("azure",),
    "sqlalchemy": ("sqlalchemy", "sql alchemy"),
    "pytest": ("pytest", "py test"),
    "rest": ("rest", "restful", "api rest"),
    "graphql": ("graphql", "graph ql"),
    "rabbitmq": ("rabbitmq", "rabbit mq"),
    "kafka": ("kafka", "apache kafka"),
    "linux": ("linux", "unix"),
    "git": ("git", "github", "gitlab"),
    "ci/cd": ("ci/cd", "ci cd", "continuous integration", "continuous delivery"),
    "javascript": ("javascript", "js"),
    "typescript": ("typescript", "ts"),
    "node.js": ("node.js", "nodejs", "node js"),
    "java": ("java",),
    "go": ("golang", "go"),
    "php": ("php",),
}

# --- fixed values: names that are not simply title-cased -------------------------------------
STACK_DISPLAY: dict[str, str] = {
    "aws": "AWS",
    "gcp": "GCP",
    "ci/cd": "CI/CD",
    "node.js": "Node.js",
    "sqlalchemy": "SQLAlchemy",
    "postgresql": "PostgreSQL",
    "graphql": "GraphQL",
    "rabbitmq": "RabbitMQ",
    "fastapi": "FastAPI",
}
# The explanation texts of the score know one name less: "rabbitmq" is title-cased there.
REASON_DISPLAY: dict[str, str] = {k: v for k, v in STACK_DISPLAY.items() if k != "rabbitmq"}

# --- fixed values: terms looked for in addition to the dictionary ----------------------------
DEFAULT_USER_TERMS: tuple[str, ...] = (
    "Python", "Django", "FastAPI", "PostgreSQL", "Docker", "AWS", "Celery", "Redis", "SQLAlchemy",
)

# --- fixed values: seniority ------------------------------------------------------------------
SENIORITY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "junior": ("junior", "júnior", "jr", "trainee", "estagio", "estágio", "entry level"),
    "pleno": ("pleno", "mid-level", "mid level", "midlevel", "intermediario", "intermediário"),
    "senior": (
        "senior", "sênior", "sr", "especialista", "specialist", "lead", "staff", "principal",
    ),
}
SENIORITY_PRIORITY: dict[str, tuple[str, ...]] = {
    "junior": ("júnior", "junior", "jr"),
    "pleno": ("pleno",),
    "senior": ("sênior", "senior", "sr", "especialista"),
}
SENIORITY_FACTORS: dict[str, dict[str, float]] = {
    "senior": {"junior": 0.0, "pleno": 0.65},
    "pleno": {"junior": 0.35, "senior": 0.85},
    "junior": {"pleno": 0.55, "senior": 0.35},
}
SENIORITY_UNKNOWN_FACTOR = 0.85
SENIORITY_OTHER_FACTOR = 0.5

# --- fixed values: contract, work model, country ---------------------------------------------
CONTRACT_WORDS: dict[str, tuple[str, ...]] = {
    "pj": ("pj", "pessoa jurídica", "pessoa juridica"),
    "clt": ("clt",),
    "freelancer": ("freela", "freelancer", "contractor"),
    "internship": ("estágio", "estagio", "internship"),
}
REMOTE_WORDS: dict[str, tuple[str, ...]] = {
    "remote": ("remoto", "remote", "home office", "anywhere"),
    "hybrid": ("híbrido", "hibrido", "hybrid"),
    "onsite": ("presencial", "on-site", "on site", "onsite"),
}
REMOTE_LABELS: dict[str, str] = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "On-site"}
HOME_COUNTRY = "Brazil"
HOME_COUNTRY_WORDS = ("brasil", "brazil", "br")
NOT_A_CITY = ("remoto", "remote", "brasil", "brazil")

# --- fixed values: URLs and secrets ------------------------------------------------------------
TRACKING_PARAMETERS: tuple[str, ...] = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "trk", "trackingId", "refId", "position", "pageNum",
)
SECRET_NAME_WORDS: tuple[str, ...] = (
    "token", "password", "secret", "basic_auth", "database_url", "redis_url",
)
REDACTED = "***REDACTED***"

# --- fixed values: pages -------------------------------------------------------------------------
BLOCK_MARKERS: tuple[str, ...] = ("captcha", "sign in", "login", "authwall", "checkpoint")
LISTING_PATH_MARKER = "/jobs/"
MIN_ANCHOR_TEXT = 8

# --- fixed values: score ---------------------------------------------------------------------------
TITLE_WEIGHT, STACK_WEIGHT, DESCRIPTION_WEIGHT = 18.0, 12.0, 5.0
MUST_HAVE_FACTOR = 1.35
REMOTE_BONUS, NOT_REMOTE_PENALTY = 7.0, 20.0
LOCATION_BONUS = 4.0
SALARY_BONUS, NO_SALARY_PENALTY = 4.0, 3.0
NEGATIVE_KEYWORD_PENALTY = 12.0
MISSING_MUST_PENALTY = 25.0

# --- fixed values: texts of the score explanation -------------------------------------------------
REASON_NO_STACK = "stack desejada não configurada"
REASON_FOUND = "encontrou "
REASON_NOT_FOUND = "não encontrou "
REASON_MISSING_MUST = "faltam tecnologias obrigatórias: "
REASON_SENIORITY_FITS = "senioridade compatível: "
REASON_SENIORITY_MISFIT = "senioridade incompatível: "
REASON_SENIORITY_PENALTY = "senioridade com penalidade: "
REASON_SENIORITY_UNKNOWN = "não informada"
REASON_REMOTE = "vaga remota"
REASON_NOT_REMOTE = "vaga não parece remota"
REASON_LOCATION = "localização aderente à preferência"
REASON_SALARY = "salário informado"
REASON_NO_SALARY = "salário não informado"
REASON_NEGATIVE = "palavra negativa encontrada: "

# --- fixed values: texts of the report and of the exports -------------------------------------------
REPORT_EMPTY = "Nenhuma vaga nova compatível encontrada nesta execução."
REPORT_TOTAL = "Total de vagas novas hoje: "
REPORT_NO_TITLE = "Sem título"
REPORT_NO_COMPANY = "Empresa não informada"
REPORT_NO_LOCATION = "Local não informado"
REPORT_NOT_INFORMED = "não informado"
REPORT_LINK_TEXT = "Abrir vaga"
MARKDOWN_NO_COMPANY = "não informada"
MARKDOWN_NO_LOCATION = "não informado"
NO_SOURCE_WORKED = "No source was successfully scraped"
REPORT_ROWS = 10
MESSAGE_LIMIT, CHUNK_SIZE = 4096, 3800
CSV_COLUMNS = ("id", "title", "company", "location", "source", "score", "seniority", "link")
