"""Correlations over ordered rows, parameterized by column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.running import RunningSum, running
from spoorline.operators.skew import salted_join


def success_after_failure(
    df: DataFrame,
    *,
    scope: Sequence[str],
    source: str,
    account: str,
    order: str,
    failed: Column,
    accepted: Column,
    exempt: Column,
    chunk: Column,
) -> DataFrame:
    """Accepted logins that follow failures of the same source and account.

    Adds ``attempt`` (failures of the source so far, this row included),
    ``prior_failures`` (before this row, any account) and ``cracked``: accepted,
    not exempt, and the same account failed earlier from the same source.
    """
    flag = F.when(failed, 1).otherwise(0)
    counted = running(
        df,
        [*scope, source],
        [order],
        chunk,
        prior_failures=RunningSum(flag),
    ).withColumn("attempt", F.col("prior_failures") + flag)
    first_failure = (
        df.filter(failed)
        .groupBy(*scope, source, account)
        .agg(F.min(order).alias("__first_failure"))
    )
    joined = salted_join(counted, first_failure, [*scope, source, account], [order])
    cracked = accepted & ~exempt & F.coalesce(F.col("__first_failure") < F.col(order), F.lit(False))
    return joined.withColumn("cracked", cracked).drop("__first_failure")


def connection_flood(
    df: DataFrame,
    *,
    keys: Sequence[str],
    at: str,
    minimum: int = 200,
    window_seconds: int = 600,
) -> DataFrame:
    """Groups with at least ``minimum`` rows whose whole span fits in the window."""
    micros = F.unix_micros(F.col(at))
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connections"),
        F.min(at).alias("first_time"),
        F.max(at).alias("last_time"),
        ((F.max(micros) - F.min(micros)) / 1_000_000.0).alias("__span"),
    )
    seconds = F.greatest(F.col("__span"), F.lit(1.0))
    return (
        grouped.filter(
            (F.col("connections") >= minimum) & (F.col("__span") <= window_seconds)
        )
        .withColumn("window_seconds", F.round(seconds, 1))
        .withColumn("rate_per_second", F.round(F.col("connections") / seconds, 1))
        .withColumn("span_seconds", seconds)
        .drop("__span")
    )


def distinct_time_flags(
    df: DataFrame, times: Mapping[str, str], at: str = "at", flags: str = "flags"
) -> DataFrame:
    """One row per distinct non-null time of a row, with the letters it stands for.

    ``times`` maps a letter to a timestamp column, in the order letters are shown.
    """
    each = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in times.values()])))
    rows = df.withColumn(at, F.explode(each))
    letters = [
        F.when(F.col(c) == F.col(at), F.lit(letter)).otherwise(F.lit("."))
        for letter, c in times.items()
    ]
    return rows.withColumn(flags, F.concat(*letters))


def notable_events(
    events: DataFrame,
    *,
    levels: Sequence[str] = ("crit", "high", "med"),
    per_type: int = 4,
    limit: int = 60,
) -> DataFrame:
    """The rows to read first: worst level first, a few per event type.

    The row-number filter lets every map task keep only its best few rows per
    type, so a type that dominates the table never reaches one reducer whole.
    """
    best = Window.partitionBy("event_type").orderBy(
        F.col("sev_rank").desc(), "ts_epoch", "id"
    )
    picked = (
        events.filter(F.col("severity").isin(*levels))
        .withColumn("__place", F.row_number().over(best))
        .filter(F.col("__place") <= per_type)
        .drop("__place")
    )
    return picked.orderBy(F.col("sev_rank").desc(), "ts_epoch", "id").limit(limit)


def notable_total(
    events: DataFrame, levels: Sequence[str] = ("crit", "high", "med")
) -> DataFrame:
    """How many notable rows there are in all, one row."""
    return events.filter(F.col("severity").isin(*levels)).agg(
        F.count(F.lit(1)).alias("notable_total")
    )
