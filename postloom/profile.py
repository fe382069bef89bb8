"""What a posting is matched against, and the term dictionary used to read its text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from postloom import vocabulary as v


@dataclass(frozen=True)
class MatchProfile:
    """Wishes a posting is scored against."""

    must_have: tuple[str, ...] = ("Python", "PostgreSQL")
    nice_to_have: tuple[str, ...] = ("FastAPI", "Docker", "AWS", "Redis", "Celery")
    negative_keywords: tuple[str, ...] = ("estágio", "frontend only", "presencial obrigatório")
    preferred_locations: tuple[str, ...] = ("remote", "brazil")
    seniority: str = "senior"
    remote_only: bool = False
    min_score: float = 50.0

    def __post_init__(self) -> None:
        if self.seniority.strip().lower() not in {"junior", "pleno", "senior", "any"}:
            raise ValueError("seniority must be junior, pleno, senior or any")
        if not 0.0 <= self.min_score <= 100.0:
            raise ValueError("min_score must lie between 0 and 100")


def squeeze(text: str) -> str:
    return " ".join(text.lower().split())


def canonical_term(name: str, aliases: Mapping[str, Iterable[str]] = v.TECH_ALIASES) -> str:
    """Dictionary entry a configured name stands for; the squeezed name itself if there is none."""
    wanted = squeeze(name)
    owners = (entry for entry, spellings in aliases.items() if wanted in {entry, *spellings})
    return next(owners, wanted)


@dataclass(frozen=True)
class TermDictionary:
    """Entries (canonical name -> spellings) with the name shown for each entry."""

    entries: Mapping[str, tuple[str, ...]]
    display: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def stack(cls, user_terms: Iterable[str] = v.DEFAULT_USER_TERMS) -> TermDictionary:
        """The technology dictionary plus the user's own terms, each under its own name."""
        wanted = set(v.TECH_ALIASES) | {t.strip().lower() for t in user_terms if t.strip()}
        return cls.of(sorted(wanted), v.STACK_DISPLAY)

    @classmethod
    def of(cls, names: Iterable[str], display: Mapping[str, str]) -> TermDictionary:
        return cls({n: tuple(v.TECH_ALIASES.get(n, (n,))) for n in names}, display)

    def name(self, entry: str) -> str:
        return self.display.get(entry, entry.title())

    def spellings(self) -> list[str]:
        return sorted({squeeze(s) for group in self.entries.values() for s in group})
