"""Parameters and fixed values of the labelling domain."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# The eight items in their order, conditions, splits, assertions, severity buckets.
ITEMS = ("anhedonia", "depressed_mood", "sleep", "fatigue", "appetite", "guilt", "concentration", "psychomotor")
CONDITIONS = ("control", "mdd")
SPLITS = ("train", "dev", "test")
ASSERTIONS = ("present", "denied", "possible", "not_mentioned")
BUCKETS = {"0-4": (0, 4), "5-9": (5, 9), "10-14": (10, 14), "15-19": (15, 19), "20-24": (20, 24)}
VIEWS = ("client_qa", "client_only")
TOTAL = "__total__"
MAX_EVIDENCE_WORDS, MAX_EVIDENCE_CHARS, MAX_EVIDENCE_SNIPPETS = 50, 400, 3
MAX_UTTERANCE_WORDS, MAX_UTTERANCE_CHARS = 200, 4000
MAX_PREFIX_CHARS, MAX_BRACKET_CHARS = 32, 200
MAX_ERROR_CHARS = 500

# The quality gates.
GATES = {"alpha": 0.67, "cronbach": 0.70, "arbitration_rate": 0.30, "cohens_d": 0.5, "p_value": 0.01, "item_coverage": 0.50, "na_rate": 0.25, "min_coverage_rate": 0.90}


@dataclass(frozen=True)
class ScoringConfig:
    """What decides a run's results. Physical settings stay out, so that changing them never blocks a resume."""

    prompt_version: str = "v2.0.0"
    dialogue_view: str = "client_qa"
    limit: int | None = None
    alpha: float = 0.5
    range_threshold: int = 2
    total_std_threshold: float = 2.0
    max_prob_threshold: float = 0.60
    entropy_threshold: float = 1.2
    ambiguity_band: tuple[float, float] = (0.4, 0.6)
    na_count_threshold: int | None = 2
    na_rate_threshold: float | None = None
    jurors: tuple[tuple[str, int], ...] = field(default=(("model-a", 1), ("model-a", 2), ("model-b", 1), ("model-b", 2), ("model-c", 1), ("model-c", 2)))

    def __post_init__(self) -> None:
        if self.dialogue_view not in VIEWS:
            raise ValueError(f"unknown dialogue_view {self.dialogue_view!r}")
        if self.ambiguity_band[0] > self.ambiguity_band[1]:
            raise ValueError("ambiguity_band: low must not be above high")
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")
        if len(set(self.jurors)) != len(self.jurors) or any(run < 1 for _, run in self.jurors):
            raise ValueError("jurors must be distinct, with runs from 1")

    def fingerprint(self) -> str:
        return sha_of(asdict(self))


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def sha_of(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
