"""Thresholds and defaults, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualityRules:
    min_volume: float = 1.0
    min_book_depth: float = 1.0
    min_liquidity: float = 10.0
    max_spread: float = 0.4


@dataclass(frozen=True)
class FeeRates:
    """Taker fee rates by venue; the fee of a leg is rate * p * (1 - p)."""

    a: float = 0.0
    b: float = 0.07


@dataclass(frozen=True)
class MatchRules:
    limit: int | None = 300
    per_market: int = 3
    min_similarity: float = 0.5
    markets_per_batch: int = 15
    concurrent_batches: int = 3
    batches_per_wave: int = 60
    answer_seconds: float = 120.0
    tries: int = 2
    min_confidence: float = 0.6
    consensus_share: float = 0.6
    rules_chars: int = 400


@dataclass(frozen=True)
class Engine:
    quality: QualityRules = field(default_factory=QualityRules)
    fees: FeeRates = field(default_factory=FeeRates)
    match: MatchRules = field(default_factory=MatchRules)
    prune_stale: bool = True
    sweep_seconds: int = 60
    max_pages: int = 50
    price_buckets: int = 10
    history_hours: int = 24
    typeahead_rows: int = 12
    typeahead_chars: int = 2


DEFAULTS = Engine()
