"""Arithmetic on the closed set of severity levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import strings
from spoorline.schema import LEVEL_RANK, LEVELS


def level_rank(level: Column) -> Column:
    """0 for info (and for anything unknown) up to 4 for crit."""
    place = F.array_position(strings(LEVELS), level).cast("int")
    return F.coalesce(F.greatest(place - 1, F.lit(0)), F.lit(0))


def level_name(rank: Column) -> Column:
    return F.get(strings(LEVELS), rank)


def clamp_level(level: Column) -> Column:
    """Unknown levels become info."""
    return F.when(level.isin(*LEVELS), level).otherwise(F.lit("info"))


def rank_lit(level: str) -> Column:
    return F.lit(LEVEL_RANK[level])


def raised(rank: Column, steps: Column, ceiling: str = "med") -> Column:
    """``rank`` plus ``steps``, stopping at ``ceiling`` and never going down."""
    return F.greatest(rank, F.least(rank + steps, rank_lit(ceiling)))
