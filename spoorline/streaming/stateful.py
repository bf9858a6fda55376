"""Correlation while lines still arrive: state per key, in event time.

Lines of a source may come in any order within a delay. They wait in the state of their
key until the watermark has passed them, are then taken in order of time and line, and the
running counts go on from where they stood. Rows behind the watermark are dropped by
Spark, which counts them: see :func:`late_rows`. Rules need no state: ``match_book`` and
``match_rules`` take a stream as they take a table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Executors get this module with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "source string, account string, line_no long, event_time timestamp, attempt long, prior_failures long, cracked boolean"
#: Waiting rows lie in the state as packed columns, so many to a value: the state is asked per
#: batch and per account, never per row.
WAITING = "line_nos binary, times binary, flags binary, accounts array<string>"
PACKED_ROWS = 10_000
FAILED, ACCEPTED, EXEMPT = 1, 2, 4


def packed_rows(line_no: np.ndarray, at: np.ndarray, flags: np.ndarray, account: np.ndarray) -> list[tuple]:
    """The rows as values of the waiting state."""
    cuts = [slice(i, i + PACKED_ROWS) for i in range(0, len(at), PACKED_ROWS)]
    return [(line_no[c].tobytes(), at[c].tobytes(), flags[c].tobytes(), account[c].tolist()) for c in cuts]


class LoginCounter(StatefulProcessor):
    """Failures so far of a source, and the accounts that failed from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.failures = handle.getValueState("failures", "n long")
        self.failed_accounts = handle.getMapState("accounts", "account string", "line_no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            at = batch["event_time"].astype("datetime64[us]").to_numpy().view(np.int64)
            flags = sum(
                batch[name].eq(True).to_numpy(dtype=np.uint8) * np.uint8(bit)
                for name, bit in (("failed", FAILED), ("accepted", ACCEPTED), ("exempt", EXEMPT))
            )
            account = batch["account"].to_numpy(dtype=object)
            for value in packed_rows(batch["line_no"].to_numpy(dtype=np.int64), at, flags, account):
                self.waiting.appendValue(value)
            latest = max([latest, *at.tolist()])
        # Due as soon as the watermark has passed the last of these rows.
        self.handle.registerTimer(latest // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        values = list(self.waiting.get())
        line_no = np.frombuffer(b"".join(v[0] for v in values), dtype=np.int64)
        at = np.frombuffer(b"".join(v[1] for v in values), dtype=np.int64)
        flags = np.frombuffer(b"".join(v[2] for v in values), dtype=np.uint8)
        account = np.array([a for v in values for a in v[3]], dtype=object)
        later = at > passed
        if later.all():
            return
        self.waiting.clear()
        for value in packed_rows(line_no[later], at[later], flags[later], account[later]):
            self.waiting.appendValue(value)
        due = np.flatnonzero(~later)
        due = due[np.lexsort((line_no[due], at[due]))]
        line_no, at, flags, account = line_no[due], at[due], flags[due], account[due]
        failed = (flags & FAILED) > 0
        stored = self.failures.get()
        before = (stored[0] if stored else 0) + np.cumsum(failed) - failed
        self.failures.update((int(before[-1] + failed[-1]),))
        entered = (flags & (ACCEPTED | EXEMPT)) == ACCEPTED
        # The place of each account's first failure here; -1 if it failed before.
        code, names = pd.factorize(account, use_na_sentinel=False)
        first = np.full(len(names), len(due))
        np.minimum.at(first, code[failed], np.flatnonzero(failed))
        for i in np.unique(code[failed | entered]).tolist():
            name = None if pd.isna(names[i]) else names[i]
            if self.failed_accounts.containsKey((name,)):
                first[i] = -1
            elif first[i] < len(due):
                self.failed_accounts.updateValue((name,), (int(line_no[first[i]]),))
        yield pd.DataFrame(
            {
                "source": [key[0]] * len(due),
                "account": account,
                "line_no": line_no,
                "event_time": at.view("datetime64[us]"),
                "attempt": before + failed,
                "prior_failures": before,
                "cracked": entered & (np.arange(len(due)) > first[code]),
            }
        )

    def close(self) -> None:
        pass


def logins_as_they_come(lines: DataFrame, delay: str) -> DataFrame:
    """(source, account, line_no, event_time, attempt, prior_failures, cracked) of a stream.

    ``lines``: (source, account, line_no, event_time, failed, accepted, exempt), at most
    ``delay`` out of order. ``source`` names the key whole, its file or host included. Each
    line comes out once, when the watermark has passed it. Needs ``STATE_STORE``.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        lines.select("source", "account", "line_no", "event_time", "failed", "accepted", "exempt")
        .withWatermark("event_time", delay)
        .groupBy("source")
        .transformWithStateInPandas(LoginCounter(), COUNTED, outputMode="Append", timeMode="EventTime")
    )


def flood_sessions(
    rows: DataFrame, *, keys: Sequence[str], at: str, gap: str, minimum: int, delay: str | None = None
) -> DataFrame:
    """Sessions of at least ``minimum`` rows, none further than ``gap`` from the one before.

    On a table and, with ``delay``, on a stream alike; there a session comes out when the
    watermark has passed its end.
    """
    late = rows.withWatermark(at, delay) if delay else rows
    grouped = late.groupBy(*keys, F.session_window(at, gap)).agg(
        F.count(F.lit(1)).alias("connections"), F.min(at).alias("first_time"), F.max(at).alias("last_time")
    )
    return grouped.where(F.col("connections") >= minimum).drop("session_window")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the query's known progress."""
    return sum(
        int(state.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there now into a table and stops."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query


def arriving(spark, folder: str, like: DataFrame) -> DataFrame:
    """Files of a folder as a stream, one a batch, in the order in which they came."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def delayed(at: Column, slices: int, first: Column, last: Column) -> Column:
    """Which of so many equal slices of time a row belongs to, from 0."""
    share = (F.unix_micros(at) - F.unix_micros(first)) * slices / (F.unix_micros(last) - F.unix_micros(first) + 1)
    return F.floor(share).cast("int")
