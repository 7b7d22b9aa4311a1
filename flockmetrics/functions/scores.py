"""Scores, tier ladders and week-over-week differences as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from flockmetrics.settings import TierRule, Weights


def weighted_score(likes: Column, recasts: Column, replies: Column, weights: Weights) -> Column:
    """NULL as soon as one part is NULL: a missing reaction count is not a zero."""
    return likes * weights.likes + recasts * weights.recasts + replies * weights.replies


def _climb(rules: Sequence[TierRule], measures: Mapping[str, Column], outcome) -> Column:
    """Highest rung first. The ground rung asks for nothing and takes whatever is left."""
    *rungs, ground = sorted(rules, key=lambda rule: -rule.level)
    if not rungs:
        return F.lit(outcome(ground))
    ladder = F
    for rung in rungs:
        reached = reduce(and_, (measures[name] >= least for name, least in rung.at_least.items()))
        ladder = ladder.when(reached, F.lit(outcome(rung)))
    return ladder.otherwise(F.lit(outcome(ground)))


def tier_level(rules: Sequence[TierRule], measures: Mapping[str, Column]) -> Column:
    """Level of the highest rung reached; unknown measures reach none."""
    return _climb(rules, measures, lambda rule: rule.level)


def tier_label(rules: Sequence[TierRule], measures: Mapping[str, Column]) -> Column:
    return _climb(rules, measures, lambda rule: rule.label)


def label_of_level(rules: Sequence[TierRule], level: Column) -> Column:
    names = F
    for rule in rules:
        names = names.when(level == rule.level, F.lit(rule.label))
    return names


def change(now: Column, before: Column, missing_before: int | None = None) -> Column:
    """Week-over-week difference; ``missing_before`` replaces an absent earlier value."""
    if missing_before is not None:
        before = F.coalesce(before, F.lit(missing_before))
    return now - before


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_where(condition: Column, value: Column) -> Column:
    """Rows outside the condition add 0; a NULL value inside it adds nothing."""
    return F.sum(F.when(condition, value).otherwise(0))


def sum_only_where(condition: Column, value: Column) -> Column:
    """NULL when no row meets the condition."""
    return F.sum(F.when(condition, value))


def max_where(condition: Column, value: Column) -> Column:
    """NULL when no row meets the condition."""
    return F.max(F.when(condition, value))


def avg_where(condition: Column, value: Column) -> Column:
    """Mean over the rows that meet the condition."""
    return F.avg(F.when(condition, value))
