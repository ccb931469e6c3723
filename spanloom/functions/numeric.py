"""Scores of linear chains and arithmetic on the sphere, on array columns; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import dot, once


def log_sum_exp(values: Column) -> Column:
    return once(values, lambda v: once(F.array_max(v), lambda m: m + F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))))


def chain_normaliser(scores: Column, moves: list[list[float]], starts: list[float], ends: list[float]) -> Column:
    """The logarithm of the sum over all tag paths of exp(their score); null where there are no steps. `scores` is an array of steps by tag."""
    into = F.lit([[row[j] for row in moves] for j in range(len(starts))])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    step = lambda held, row: F.zip_with(into, row, lambda m, x: log_sum_exp(add(held, m)) + x)
    begun = add(F.lit(starts), F.get(scores, F.lit(0)))
    rest = F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
    return F.when(F.size(scores) > 0, log_sum_exp(add(F.aggregate(rest, begun, step), F.lit(ends))))


def chain_score(scores: Column, tags: Column, moves: list[list[float]], starts: list[float], ends: list[float]) -> Column:
    """The score of one path of tag numbers: steps, moves between them, start and end; null where there are no steps."""
    steps = F.zip_with(scores, tags, lambda row, t: F.get(row, t))
    go = F.transform(tags, lambda t, i: F.when(i == 0, F.get(F.lit(starts), t)).otherwise(F.get(F.get(F.lit(moves), F.get(tags, i - 1)), t)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(tags) > 0, total(steps) + total(go) + F.get(F.lit(ends), F.element_at(tags, -1)))


def slerp(a: Column, b: Column, t: float) -> Column:
    """The vector at t on the arc from a to b; on the line between them where either has no length or they point the same way."""
    length = lambda v: F.sqrt(dot(v, v))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (length(a) * length(b))))
    straight = (length(a) < 1e-12) | (length(b) < 1e-12)

    def mixed(w: Column) -> Column:
        line = straight | (w < 1e-7)
        p = F.when(line, 1 - t).otherwise(F.sin((1 - t) * w) / F.sin(w))
        q = F.when(line, t).otherwise(F.sin(t * w) / F.sin(w))
        return F.zip_with(a, b, lambda x, y: p * x + q * y)

    return once(F.when(straight, 0.0).otherwise(F.acos(cosine)), mixed)
