"""Pass rules of the studies' hypotheses, over plain figures; all bounds are inclusive but the return's."""

from __future__ import annotations

import math
from dataclasses import dataclass


# Thresholds of the studies. Coverage and near_share are derived from prices where they are None.
@dataclass(frozen=True)
class Limits:
    coverage: float | None = None
    near: float = 0.90
    near_share: float | None = None
    accepted: float = 0.70
    rho: float = 0.50
    gap_coverage: float = 0.10
    gap_near: float = 0.05
    gap_accepted: float = 0.25
    lift: float = 0.10
    quality: float = 0.60
    same_median: float = 0.60
    same_share: float = 0.30
    recurring_cos: float = 0.85
    recurring: float = 0.30
    cold_start: float = 0.15
    agreement: float = 0.80
    fewest: int = 50
    fewest_conversations: int = 30


def concentrated(h: dict, limits: Limits) -> bool:
    """H1: the sweep is separable, not degenerate, covers enough and beats its control."""
    covers = h["coverage_median"] >= limits.coverage and h["gap"] >= limits.gap_coverage
    return bool(h["separable"] and not h["degenerate"] and covers)


def near_enough(h: dict, limits: Limits) -> bool:
    """H3: enough prompts have a near neighbour, and more than the scrambled ones."""
    return h["fraction"] >= limits.near_share and h["fraction"] - h["control"] >= limits.gap_near


def correlated(h: dict, limits: Limits) -> bool:
    """H4: like prompts have like responses; an undefined correlation does not pass."""
    return not math.isnan(h["spearman"]) and h["spearman"] >= limits.rho


def accepted(h: dict, limits: Limits) -> bool:
    """H5: a band calibrates, its best rate is enough, and beats the best control of any band."""
    return h["s3"] is not None and h["best"] >= limits.accepted and h["best"] - h["control"] >= limits.gap_accepted


def lifted(h: dict, limits: Limits) -> bool:
    """HP1 of study C: a retriever beats chance."""
    return h["best_lift"] >= limits.lift


def served(h: dict, limits: Limits) -> bool:
    """HP2: at some serve threshold answers are good enough."""
    return any(r["quality"] >= limits.quality for r in h["quality"])


def same_session(h: dict, limits: Limits) -> bool:
    """HP3 of study C: consecutive prompts of a conversation are alike."""
    return h["median"] >= limits.same_median and h["ge_70"] >= limits.same_share


def recurs(h: dict, limits: Limits) -> bool:
    """HP1 of study D."""
    return h["fraction"] >= limits.recurring


def early(h: dict, limits: Limits) -> bool:
    """HP3 of study D: first prompts recur from the start."""
    return h["fraction"] >= limits.cold_start
