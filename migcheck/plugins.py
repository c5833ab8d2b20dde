"""Extension points: functions that a project registers by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Plugins:
    """Readers by source type, data-quality rules and aggregates by dataset, validators by phase, score adjusters, callbacks.

    A rule is a SQL predicate that no row should meet; a validator takes (spark, legacy, modern, config)
    and returns a result; an adjuster takes (phase, score, results) and returns a score or None.  An observer check
    takes (spark, name, table) and returns findings as those of the observer; a drift callback takes (check, finding),
    a load callback (table, status), and a report section the run, for which it returns lines.  A glossary enricher
    takes and returns a glossary, an override of a normalisation plan (by dataset) its part of it; recommendations
    and load strategies are by dataset.
    """

    readers: dict[str, Callable] = field(default_factory=dict)
    column_overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    quality_rules: dict[str, dict[str, str]] = field(default_factory=dict)
    aggregates: dict[str, list[dict]] = field(default_factory=dict)
    validators: dict[str, list[Callable]] = field(default_factory=lambda: {"pre": [], "post": []})
    score_adjusters: list[Callable] = field(default_factory=list)
    on_drift: list[Callable] = field(default_factory=list)
    observer_checks: list[Callable] = field(default_factory=list)
    post_ingest: list[Callable] = field(default_factory=list)
    report_sections: list[Callable] = field(default_factory=list)
    glossary_enrichers: list[Callable] = field(default_factory=list)
    normalization_overrides: dict[str, Callable] = field(default_factory=dict)
    rationalization_overrides: dict[str, str] = field(default_factory=dict)
    ingest_strategies: dict[str, str] = field(default_factory=dict)

    def adjusted(self, phase: str, score: float, results: list) -> float:
        """The score after all adjusters; the last that returns a number counts."""
        given = [s for f in self.score_adjusters if (s := f(phase, score, results)) is not None]
        return float(given[-1]) if given else score
