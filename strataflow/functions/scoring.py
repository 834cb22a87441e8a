"""Decay, retrieval and strategy scores."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600 * 10**9
#: Half-lives of claims in days, by type. Other types count as facts.
CLAIM_HALF_LIVES = {
    "intention": 3.0, "belief": 14.0, "avoidance": 14.0, "preference": 30.0, "bugfix": 90.0, "capability": 180.0, "apicontract": 180.0, "fact": 365.0, "codepattern": 365.0,
}
#: Utility of an outcome, and novelty, utility, difficulty, reuse and redundancy weights.
OUTCOME_UTILITY = {"Success": 1.0, "Partial": 0.7, "Failure": 0.8, "Interrupted": 0.4}


def age_hours(then: Column, now: Column) -> Column:
    return F.greatest(now - then, F.lit(0)) / float(HOUR)


def temporal_decay(hours: Column, half_life: float) -> Column:
    return F.exp(F.lit(-log(2.0)) * hours / F.lit(half_life))


def importance_decay(hours: Column, importance: Column, half_life: float, mu: float = 1.0) -> Column:
    """Decay whose rate falls with importance: rate * exp(-mu * importance)."""
    return F.exp(-(F.lit(log(2.0) / half_life) * F.exp(-F.lit(mu) * importance)) * hours)


def claim_weight(hours: Column, kind: Column) -> Column:
    """2 ** (-age / half-life of the claim's type)."""
    table = F.create_map(*[F.lit(x) for kv in CLAIM_HALF_LIVES.items() for x in kv])
    name = F.regexp_replace(F.lower(kind), "_", "")
    return F.pow(F.lit(2.0), -hours / (24.0 * F.coalesce(F.try_element_at(table, name), F.lit(CLAIM_HALF_LIVES["fact"]))))


def claim_score(similarity: Column, weight: Column, outcome: Column) -> Column:
    return similarity * (F.lit(0.6) + F.lit(0.4) * weight) * (F.lit(0.6) + F.lit(0.8) * outcome)


def strategy_eligibility(seen: Column, outcome: Column, events: Column, bucket: Column, redundancy: Column, weights=(0.2, 0.3, 0.2, 0.2, 0.1)) -> Column:
    """Weighted novelty, utility, difficulty and reuse, less redundancy, within [0, 1]."""
    novelty, use, hard, reuse, redundant = (F.lit(w) for w in weights)
    utility = F.create_map(*[F.lit(x) for kv in OUTCOME_UTILITY.items() for x in kv])
    total = (
        novelty / (1 + seen) + use * F.coalesce(utility[outcome], F.lit(0.0)) + hard * F.least(events / 10.0, F.lit(1.0)) + reuse * F.least(bucket / 10.0, F.lit(1.0)) - redundant * redundancy
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def support_confidence(support: Column) -> Column:
    return 1 - F.exp(-support / 3.0)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the texts' distinct lower-case words."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    both = F.size(F.array_intersect(words(a), words(b)))
    either = F.size(F.array_union(words(a), words(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def posterior(successes: Column, failures: Column, prior_success: float = 1.0, prior_failure: float = 3.0) -> Column:
    return (successes + prior_success) / (successes + prior_success + prior_failure + failures)


def observation_confidence(n: Column) -> Column:
    return F.least(n / (n + 10.0), F.lit(0.95))
