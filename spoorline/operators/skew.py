"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    rows: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` joined to ``facts`` (one row per key), a hot key cut in ``salts`` parts.

    ``spread`` names row columns whose hash picks the part; it depends on the
    row alone, so a retried task repeats it. Facts are repeated once per part:
    keep them narrow and filtered. At run time Spark still turns the join into
    a broadcast when the facts' measured size is small.
    """
    salt = "__salt"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)
