"""Headline queries, seconds each: warm, median of three, one JSON line.

The tables come as one file with one row group each, which one task reads. Before the
clock starts they are written again as a file per core, as a cluster's tables would be;
`tables_as_given` has one warm run of each query on the tables as they come.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from spoorline.plans import catalog  # noqa: E402
from spoorline.session import local_session  # noqa: E402

HEADLINE = (
    "timeline_floor",
    "search_regex",
    "facet_users",
    "rare_values",
    "spawn_bursts",
    "rarity_promote",
    "success_after_failure",
    "rule_hits",
    "rule_corpus",
    "rule_corpus_mixed",
    "indicators",
    "indicators_pages",
    "classify_documents",
    "signature_hits",
    "syslog_events",
    "mongod_events",
    "bodyfile_events",
    "windows_events",
    "document_artifacts",
    "timeline_rows",
)


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def split(spark, folder: str, cores: int) -> str:
    """The same tables in `cores` files each."""
    out = tempfile.mkdtemp(prefix="spark-bench-")
    for path in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(cores).write.parquet(f"{out}/{path.name}")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    tables = split(spark, folder, cores)
    timings, given = {}, {}
    for name in HEADLINE:
        seconds(spark, name, tables)
        timings[name] = round(
            statistics.median(seconds(spark, name, tables) for _ in range(3)), 3
        )
        given[name] = round(seconds(spark, name, folder), 3)
        print(name, timings[name], given[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "tables_as_given_total": round(sum(given.values()), 3),
                "tables_as_given": given,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "events": rows,
                "rule_events_per_second": round(rows / timings["rule_corpus"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
