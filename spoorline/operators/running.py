"""Running state over long ordered groups without putting a group in one task.

A plain window with an unbounded frame sends a whole group (one log file, one
address) through a single task. Here every group is cut into chunks that follow
its order. Each chunk is summed up first, the few chunk summaries of a group are
scanned in order, and what they carry over is joined back to the rows. The
windows that see rows never span more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES = 1 << 20
CHUNK = "__chunk"


def line_chunks(line_no: str = "line_no", lines: int = CHUNK_LINES) -> Column:
    return F.floor(F.col(line_no) / lines).cast("long")


def time_chunks(epoch_micros: str = "ts_epoch", seconds: int = 3600) -> Column:
    return F.floor(F.col(epoch_micros) / (seconds * 1_000_000)).cast("long")


@dataclass(frozen=True)
class RunningSum:
    """Sum of the rows before this one, or up to and including it."""

    value: Column
    inclusive: bool = False

    def summary(self, order: Column) -> Column:
        return F.sum(self.value)

    def carry(self, chunk: Column, window) -> Column:
        return F.coalesce(F.sum(chunk).over(window), F.lit(0))

    def row(self, carried: Column, order) -> Column:
        inside = F.coalesce(F.sum(self.value).over(order(self.inclusive)), F.lit(0))
        return carried + inside


@dataclass(frozen=True)
class RunningMin:
    """Smallest value of the rows before this one; null when there are none."""

    value: Column

    def summary(self, order: Column) -> Column:
        return F.min(self.value)

    def carry(self, chunk: Column, window) -> Column:
        return F.min(chunk).over(window)

    def row(self, carried: Column, order) -> Column:
        return F.least(carried, F.min(self.value).over(order(False)))


@dataclass(frozen=True)
class LastKnown:
    """Latest non-null value up to this row (or strictly before it)."""

    value: Column
    inclusive: bool = True

    def summary(self, order: Column) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def carry(self, chunk: Column, window) -> Column:
        return F.last(chunk, ignorenulls=True).over(window)

    def row(self, carried: Column, order) -> Column:
        inside = F.last(self.value, ignorenulls=True).over(order(self.inclusive))
        return F.coalesce(inside, carried)


@dataclass(frozen=True)
class FirstKnown:
    """Earliest non-null value up to this row."""

    value: Column

    def summary(self, order: Column) -> Column:
        return F.min_by(self.value, F.when(self.value.isNotNull(), order))

    def carry(self, chunk: Column, window) -> Column:
        return F.first(chunk, ignorenulls=True).over(window)

    def row(self, carried: Column, order) -> Column:
        return F.coalesce(carried, F.first(self.value, ignorenulls=True).over(order(True)))


@dataclass(frozen=True)
class Previous:
    """The value on the row right before this one, null included."""

    value: Column

    def summary(self, order: Column) -> Column:
        return F.max_by(F.struct(self.value.alias("v")), order)

    def carry(self, chunk: Column, window) -> Column:
        return F.last(chunk, ignorenulls=True).over(window)

    def row(self, carried: Column, order) -> Column:
        boxed = F.last(F.struct(self.value.alias("v"))).over(order(False))
        return F.coalesce(boxed, carried)["v"]


@dataclass(frozen=True)
class GroupTotal:
    """Sum over the whole group, on every row of it."""

    value: Column

    def summary(self, order: Column) -> Column:
        return F.sum(self.value)

    def carry(self, chunk: Column, window) -> Column:
        return F.sum(chunk).over(window.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        ))

    def row(self, carried: Column, order) -> Column:
        return carried


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    **columns,
) -> DataFrame:
    """``df`` plus one column per spec, evaluated per group in the given order.

    ``chunk`` must not decrease along ``order`` and must be a plain expression
    of the row, so that a recomputed task cuts the group in the same places.
    Keys must not be null: the join, and the windows after it, share one shuffle.
    """
    keyed = df.withColumn(CHUNK, chunk)
    cells = [*keys, CHUNK]
    position = F.struct(*[F.col(name) for name in order])
    summary = keyed.groupBy(*cells).agg(
        *[spec.summary(position).alias(name) for name, spec in columns.items()]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        *cells,
        *[spec.carry(F.col(name), before).alias(f"__c_{name}") for name, spec in columns.items()],
    )
    within = Window.partitionBy(*cells).orderBy(*order)

    def frame(inclusive: bool):
        last = Window.currentRow if inclusive else -1
        return within.rowsBetween(Window.unboundedPreceding, last)

    joined = keyed.join(carried, cells)
    return joined.select(
        *df.columns,
        *[spec.row(F.col(f"__c_{name}"), frame).alias(name) for name, spec in columns.items()],
    )
