"""Parts of the 0-100 screening score as native expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteglass.functions.cleaning import is_filled

# Points of the score. In each list the first match wins.
CAPACITY_BANDS = ((1000.0, 35), (500.0, 28), (100.0, 20), (20.0, 12))
CAPACITY_REST = 5
STATUS_POINTS = (("operational", 35), ("construction", 30), ("planning granted", 25), ("planning", 15))
STATUS_REST = 8
TECHNOLOGY_POINTS = (
    ("wind offshore", 20),
    ("battery", 18),
    ("storage", 18),
    ("solar", 15),
    ("wind onshore", 15),
)
TECHNOLOGY_REST = 10
POINTS_PER_FIELD = 2
COMPLETENESS_LIMIT = 10
SCORE_LIMIT = 100


def _first_match(cases: list[tuple[Column, int]], rest: int) -> Column:
    chain = F
    for condition, points in cases:
        chain = chain.when(condition, F.lit(points))
    return chain.otherwise(F.lit(rest))


def _text_points(text: Column, words: tuple[tuple[str, int], ...], rest: int) -> Column:
    return _first_match([(text.contains(word), points) for word, points in words], rest)


def capacity_points(capacity: Column) -> Column:
    return _first_match([(capacity >= F.lit(low), points) for low, points in CAPACITY_BANDS], CAPACITY_REST)


def status_points(status: Column) -> Column:
    """Points of a status in lower case."""
    return _text_points(status, STATUS_POINTS, STATUS_REST)


def technology_points(technology: Column) -> Column:
    """Points of a technology in lower case."""
    return _text_points(technology, TECHNOLOGY_POINTS, TECHNOLOGY_REST)


def completeness_points(cells: list[Column]) -> Column:
    if not cells:
        return F.lit(0)
    filled = reduce(add, [F.when(is_filled(cell), F.lit(1)).otherwise(F.lit(0)) for cell in cells])
    return F.least(F.lit(COMPLETENESS_LIMIT), filled * F.lit(POINTS_PER_FIELD))


def total_points(*parts: Column) -> Column:
    return F.least(F.lit(SCORE_LIMIT), reduce(add, parts))
