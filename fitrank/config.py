"""Typed arguments of the ingest and scoring plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from fitrank.functions.fixed_values import FILTER_NAMES


@dataclass(frozen=True)
class FilterRules:
    """Keyword lists of the ingest filters; an empty list switches its filter off."""

    company_blocklist: tuple[str, ...] = ()
    title_blocklist: tuple[str, ...] = ()
    title_allowlist: tuple[str, ...] = ()
    required_locations: tuple[str, ...] = ()
    excluded_locations: tuple[str, ...] = ()
    description_blocklist: tuple[str, ...] = ()
    description_allowlist: tuple[str, ...] = ()
    is_remote: bool | None = None
    disabled: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        unknown = set(self.disabled) - set(FILTER_NAMES)
        if unknown:
            raise ValueError(f"unknown filter names {sorted(unknown)}; valid: {FILTER_NAMES}")


@dataclass(frozen=True)
class Search:
    """One search over the posting pool.  An empty text means "no restriction".

    ``hours_old`` is the first window of this search; ``rules`` replace the common ones for it.
    """

    search_no: int
    search_term: str = "software engineer"
    location: str = "United States"
    is_remote: bool = True
    hours_old: int = 24
    results_per_source: int = 50
    job_type: str = "fulltime"
    rules: FilterRules | None = None

    def at_hours(self, hours_old: int) -> Search:
        return replace(self, hours_old=hours_old)


@dataclass(frozen=True)
class Lookback:
    """Widening of the time window, in hours, until ``minimum`` postings survive (0 = one pass)."""

    start: int = 24
    step: int = 24
    limit: int = 168
    minimum: int = 0

    def __post_init__(self) -> None:
        if self.step <= 0:
            raise ValueError("the widening step must be positive")

    @property
    def last_pass(self) -> int:
        return max(0, (self.limit - self.start) // self.step)


@dataclass(frozen=True)
class ScoreStep:
    """A scorer by registry name, the column it writes and its weight in the composite."""

    name: str
    column: str
    weight: float = 1.0
    enabled: bool = True
    options: dict = field(default_factory=dict)


# The shipped scoring steps and weights.
DEFAULT_STEPS = (
    ScoreStep("keyword_match", "keyword_match_score", 0.10),
    ScoreStep("tfidf_cosine", "tfidf_cosine_score", 0.10),
    ScoreStep("semantic_score", "semantic_score", 0.35, options={"model": "bge-large"}),
    ScoreStep("cross_encoder_score", "cross_encoder_score", 0.45, enabled=False),
    ScoreStep("llm_fit_score", "llm_fit_score", 0.45),
)
