"""Streams with state against the same operators on tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoorline.operators.correlate import success_after_failure
from spoorline.operators.rulebook import compile_book, evaluate_book
from spoorline.streaming import stateful

T0 = datetime(2024, 3, 1)


def lines(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        failed = rng.random() < 0.6
        rows.append((f"10.0.0.{rng.randrange(5)}", f"u{rng.randrange(8)}", i, T0 + timedelta(seconds=30 * i), failed, not failed, rng.random() < 0.2))
    return spark.createDataFrame(rows, "source string, account string, line_no long, event_time timestamp, failed boolean, accepted boolean, exempt boolean")


def arrive(rows, folder, parts):
    """Each part of the rows as one file, in this order."""
    for part in parts:
        rows.filter(part).orderBy(F.xxhash64("line_no")).coalesce(1).write.mode("append").parquet(folder)


FLUSH = "select 'flush' source, '' account, 10000L line_no, timestamp'2024-06-01' event_time, false failed, false accepted, false exempt"


def test_shuffled_stream_equals_the_table(spark, tmp_path):
    table = lines(spark)
    parts = [f"line_no >= {n} and line_no < {n + 100}" for n in range(0, 400, 100)]
    # The first part comes after the second: forty minutes late, within the delay.
    arrive(table, str(tmp_path / "in"), [parts[1], parts[0], parts[2], parts[3]])
    late = table.filter("line_no = 399").withColumn("event_time", F.lit(T0)).withColumn("line_no", F.lit(-1).cast("long"))
    arrive(late, str(tmp_path / "in"), ["true"])
    for day in ("2024-06-01", "2024-07-01"):
        arrive(spark.sql(FLUSH.replace("2024-06-01", day)), str(tmp_path / "in"), ["true"])
    stream = stateful.logins_as_they_come(stateful.arriving(spark, str(tmp_path / "in"), table), "90 minutes")
    query = stateful.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("source <> 'flush'")
    want = success_after_failure(
        table, scope=[], source="source", account="account", order="line_no", failed=F.col("failed"), accepted=F.col("accepted"),
        exempt=F.col("exempt"), chunk=F.floor(F.col("line_no") / 50).cast("long"))
    columns = ["source", "account", "line_no", "attempt", "prior_failures", "cracked"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert want.filter("cracked").count() > 10
    assert stateful.late_rows(query) == 1


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    table = lines(spark).filter("line_no % 100 < 60")
    arrive(table, str(tmp_path / "in"), ["line_no < 200", "line_no >= 200"])
    arrive(spark.sql(FLUSH), str(tmp_path / "in"), ["true"])
    how = dict(keys=["source"], at="event_time", gap="10 minutes", minimum=5)
    stream = stateful.flood_sessions(stateful.arriving(spark, str(tmp_path / "in"), table), **how, delay="1 hour")
    stateful.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = sorted(map(tuple, stateful.flood_sessions(table, **how).collect()))
    assert len(want) > 4
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


@pytest.mark.parametrize("size", [3])
def test_rules_take_a_stream(spark, tmp_path, size):
    from spoorline.operators.normalize import normalize

    rows = [(i, T0, f"run tool{i % 5}") for i in range(50)]
    events = normalize(spark.createDataFrame(rows, "id long, event_time timestamp, message string"))
    events.write.parquet(str(tmp_path / "in"))
    book = compile_book([{"title": f"t{i}", "detection": {"s": {"Message|contains": f"tool{i}"}, "condition": "s"}} for i in range(size)])
    hits = evaluate_book(stateful.arriving(spark, str(tmp_path / "in"), events), book).select("id", "rule")
    stateful.run_to_end(hits, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, evaluate_book(events, book).select("id", "rule").collect()))
    assert len(got) == 30


class FakeState:
    """A list, value or map state that counts how often it is asked."""

    def __init__(self):
        self.items, self.one, self.of, self.calls = [], None, {}, 0

    def appendValue(self, value):
        self.calls += 1
        self.items.append(value)

    def get(self):
        self.calls += 1
        return iter(self.items) if self.items else self.one

    def clear(self):
        self.calls += 1
        self.items = []

    def update(self, value):
        self.calls += 1
        self.one = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.of

    def updateValue(self, key, value):
        self.calls += 1
        self.of[key] = value


def test_state_is_asked_per_batch_not_per_row():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.states = [FakeState() for _ in range(3)]
            self.left = list(self.states)

        def getListState(self, *args):
            return self.left.pop(0)

        getValueState = getMapState = getListState

        def registerTimer(self, at):
            pass

    class Passed:
        def getCurrentWatermarkInMs(self):
            return int(T0.timestamp() * 1000) + 10**9

    n = 25_000
    rows = pd.DataFrame({
        "account": [f"u{i % 5}" if i % 7 else None for i in range(n)], "line_no": range(n),
        "event_time": [pd.Timestamp(T0)] * n, "failed": [i % 3 == 0 and i > 100 for i in range(n)],
        "accepted": [i % 3 == 1 for i in range(n)], "exempt": [None if i % 2 else i % 11 == 0 for i in range(n)]})
    counter, handle = stateful.LoginCounter(), Handle()
    counter.init(handle)
    shuffled = rows.sample(frac=1, random_state=3)
    got = []
    for part in (shuffled[: n // 2], shuffled[n // 2 :]):
        list(counter.handleInputRows(("s",), iter([part]), None))
    for frame in counter.handleExpiredTimer(("s",), Passed(), None):
        got += list(frame[["account", "line_no", "attempt", "prior_failures", "cracked"]].itertuples(index=False, name=None))
    seen, count, want = set(), 0, []
    for r in rows.itertuples():
        cracked = r.accepted and r.exempt is not True and r.account in seen
        want.append((r.account, r.line_no, count + r.failed, count, cracked))
        count += r.failed
        seen |= {r.account} if r.failed else set()
    assert got == want
    assert sum(s.calls for s in handle.states) < 60
