"""What a host has never done before: rare binaries, rare pairs, spawn bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.levels import level_name, raised
from spoorline.functions.text import basename, entry, or_blank, payload, put
from spoorline.operators.skew import salted_join
from spoorline.schema import LEVEL_RANK

# The thresholds of the profile.
RARE_DAYS, RARE_RUNS, RARE_PAIR = 1, 25, 2
BURST_CHILDREN, BURST_SECONDS, BURST_DAYS = 8, 60, 1
WHY_LIMIT = 600


def process_names(events: DataFrame) -> DataFrame:
    """Adds ``image`` and ``parent``: the bare names of a process event."""
    data = F.col("data")
    image = basename(or_blank(entry(data, "new_process_name", "image")))
    parent = basename(
        or_blank(
            entry(data, "parent_process_name", "parent_image", "creator_process_name")
        )
    )
    return events.withColumn("image", image).withColumn("parent", parent)


def value_profile(
    df: DataFrame, value: str, day: str = "event_date", at: str = "ts", by: Sequence[str] = ()
) -> DataFrame:
    """Per value: runs, distinct days, first and last time."""
    return (
        df.filter(F.col(value) != "")
        .groupBy(*by, value, day)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.min(at).alias("first_ts"),
            F.max(at).alias("last_ts"),
        )
        .groupBy(*by, value)
        .agg(
            F.sum("runs").alias("runs"),
            F.count(day).alias("days"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )


def rare_values(
    df: DataFrame,
    value: str,
    day: str = "event_date",
    at: str = "ts",
    by: Sequence[str] = (),
    max_days: int = RARE_DAYS,
    max_runs: int = RARE_RUNS,
) -> DataFrame:
    return value_profile(df, value, day, at, by).filter(
        (F.col("days") <= max_days) & (F.col("runs") <= max_runs)
    )


def pair_counts(
    df: DataFrame, parent: str, child: str, by: Sequence[str] = ()
) -> DataFrame:
    return (
        df.filter((F.col(parent) != "") & (F.col(child) != ""))
        .groupBy(*by, parent, child)
        .agg(F.count(F.lit(1)).alias("seen"))
    )


def rare_pairs(
    df: DataFrame,
    parent: str,
    child: str,
    by: Sequence[str] = (),
    max_seen: int = RARE_PAIR,
) -> DataFrame:
    return pair_counts(df, parent, child, by).filter(F.col("seen") <= max_seen)


def spawn_bursts(
    df: DataFrame,
    parent: str,
    at: str = "ts_epoch",
    day: str = "event_date",
    by: Sequence[str] = (),
    min_children: int = BURST_CHILDREN,
    window_seconds: int = BURST_SECONDS,
    max_days: int | None = BURST_DAYS,
) -> DataFrame:
    """Parents whose whole history is one day and which started many children at once.

    Gives the largest number of children inside any window of that length
    (both ends included) and where that window starts. Rows are first counted
    per parent and microsecond; a parent's time line is then cut in slices, and
    a row near the end of a slice is repeated as look-back of the next one, so
    no task holds more than one slice.
    """
    keys = [*by, parent]
    width = window_seconds * 1_000_000
    rows = df.filter((F.col(parent) != "") & F.col(at).isNotNull())
    # ``days`` counts set days only up to what the filter needs to know.
    qualified = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(day).alias("__d0"), F.max(day).alias("__d1")
    )
    if max_days == 1:
        qualified = qualified.filter(
            (F.col("__n") >= min_children) & F.col("__d0").eqNullSafe(F.col("__d1"))
        )
    else:
        qualified = qualified.filter(F.col("__n") >= min_children)
        if max_days is not None:
            per_day = rows.groupBy(*keys, day).agg(F.lit(1).alias("one"))
            few = per_day.groupBy(*keys).agg(F.count(day).alias("__days"))
            qualified = qualified.join(
                few.filter(F.col("__days") <= max_days).select(*keys), keys, "left_semi"
            )
    ticks = rows.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("__ticks"))
    ticks = salted_join(ticks, qualified.select(*keys), keys, [at], how="inner")

    slice_width = 10 * width
    own = F.floor(F.col(at) / slice_width).cast("long")
    looks_ahead = F.col(at) + width >= (own + 1) * slice_width
    cells = ticks.withColumn("__own", own).withColumn(
        "__slice",
        F.explode(F.when(looks_ahead, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    window = (
        Window.partitionBy(*keys, "__slice").orderBy(at).rangeBetween(-width, Window.currentRow)
    )
    counted = (
        cells.withColumn("__count", F.sum("__ticks").over(window))
        .withColumn("__start", F.min(at).over(window))
        .filter(F.col("__slice") == F.col("__own"))
    )
    best = counted.groupBy(*keys).agg(
        F.max(F.struct(F.col("__count"), (-F.col(at)).alias("late"), F.col("__start"))).alias("b")
    )
    return best.select(
        *keys,
        F.col("b.__count").alias("children"),
        F.col("b.__start").alias("window_start"),
    ).filter(F.col("children") >= min_children)


def once(df: DataFrame, **columns) -> DataFrame:
    """The columns behind a generator: each is worked out once a row, however often it is read.

    The optimizer would otherwise copy an expensive expression of the input into every
    filter and key that reads it, and a plan on a normalizer would not end.
    """
    one = F.array(F.struct(*(c.alias(name) for name, c in columns.items())))
    return df.select(F.explode(one).alias("__once")).select("__once.*")


def pair_facts(profiled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per parent and image: times seen, and the history of the image and of the parent.

    One aggregation of the rows; all else is worked out on its result. A history of one
    day is one whose first day is its last.
    """
    pairs = profiled.groupBy(*by, "parent", "image").agg(
        F.count(F.lit(1)).alias("seen"),
        F.min("event_date").alias("d0"),
        F.max("event_date").alias("d1"),
    )
    of_image = Window.partitionBy(*by, "image")
    of_parent = Window.partitionBy(*by, "parent")
    dated = F.when(F.min("d0").over(of_image).isNull(), 0).otherwise(1)
    told = (
        pairs.withColumn("runs", F.sum("seen").over(of_image))
        .withColumn("days", dated)
        .withColumn("one_day", ~(F.min("d0").over(of_image) < F.max("d1").over(of_image)))
        .withColumn("children_in_all", F.sum("seen").over(of_parent))
        .withColumn(
            "parent_one_day",
            F.min("d0").over(of_parent).eqNullSafe(F.max("d1").over(of_parent)),
        )
    )
    rare_image = (F.col("runs") <= RARE_RUNS) & F.coalesce("one_day", F.lit(True))
    rare_pair = (F.col("parent") != "") & (F.col("seen") <= RARE_PAIR)
    may_burst = (F.col("parent") != "") & F.col("parent_one_day") & (F.col("children_in_all") >= BURST_CHILDREN)
    return told.select(
        *by, "parent", "image",
        F.when(rare_image, F.col("runs")).alias("runs"),
        F.col("days"),
        F.when(rare_pair, F.col("seen")).alias("seen"),
        may_burst.alias("may_burst"),
    ).filter(F.col("runs").isNotNull() | F.col("seen").isNotNull() | F.col("may_burst"))


def rarity_promote(
    events: DataFrame, by: Sequence[str] = (), keep_tags: bool = False
) -> DataFrame:
    """Process events with rare behaviour lifted one level per signal, up to med.

    Other rows, and rows whose level would not change, pass through untouched
    (``keep_tags`` still notes the signals on the latter). The signals are facts of a
    parent and an image; rows that can be lifted are joined with them once, salted, and
    all other rows are not joined at all.
    """
    columns = events.columns
    is_process = F.col("event_type") == "process_created"
    named = process_names(events)
    profiled = once(
        named,
        kept=is_process & (F.col("image") != ""),
        **{c: F.col(c) for c in (*by, "image", "parent", "event_date", "ts_epoch")},
    ).filter("kept")
    facts = pair_facts(profiled, by)
    suspects = facts.filter("may_burst").select(*by, "parent").distinct()
    ticks = salted_join(
        profiled.select(*by, "parent", "event_date", "ts_epoch"), suspects, [*by, "parent"], ["ts_epoch"], how="inner"
    )
    bursts = spawn_bursts(ticks, "parent", by=by, max_days=None).select(*by, "parent", "children")
    facts = facts.join(bursts, [*by, "parent"], "left").filter(
        F.col("runs").isNotNull() | F.col("seen").isNotNull() | F.col("children").isNotNull()
    )

    # The row as it is, behind the generator; a row that no signal can change stands apart.
    can_change = is_process & (F.col("image") != "") & (F.lit(keep_tags) | (F.col("sev_rank") < LEVEL_RANK["med"]))
    staged = once(
        named,
        open=F.coalesce(can_change, F.lit(False)),
        __image=F.col("image"),
        __parent=F.col("parent"),
        **{c: F.col(c) for c in columns},
    )
    renamed = facts.withColumnRenamed("image", "__image").withColumnRenamed("parent", "__parent").drop("may_burst")
    joined = salted_join(staged.filter("open"), renamed, [*by, "__parent", "__image"], ["id"])
    changed_rows = _with_signals(joined.withColumnRenamed("__image", "image").withColumnRenamed("__parent", "parent"), columns, keep_tags)
    return changed_rows.unionByName(staged.filter("not open").select(*columns))


def _with_signals(rows: DataFrame, columns: Sequence[str], keep_tags: bool) -> DataFrame:
    """The signals of the facts beside each row, applied to it."""
    signals = F.array_compact(
        F.array(
            F.when(
                F.col("runs").isNotNull(),
                F.struct(
                    F.lit("rare_binary").alias("tag"),
                    F.concat(
                        "image", F.lit(" ran "), F.col("runs").cast("string"), F.lit("x on "),
                        F.col("days").cast("string"), F.lit(" day(s) in the whole case"),
                    ).alias("why"),
                ),
            ),
            F.when(
                F.col("seen").isNotNull(),
                F.struct(
                    F.lit("rare_parent_child").alias("tag"),
                    F.concat(
                        "parent", F.lit(" -> "), "image", F.lit(" happened "),
                        F.col("seen").cast("string"), F.lit("x in the whole case"),
                    ).alias("why"),
                ),
            ),
            F.when(
                F.col("children").isNotNull(),
                F.struct(
                    F.lit("spawn_burst").alias("tag"),
                    F.concat(
                        "parent", F.lit(" spawned "), F.col("children").cast("string"),
                        F.lit(f" children within {BURST_SECONDS}s and has never spawned "
                              "anything on another day"),
                    ).alias("why"),
                ),
            ),
        )
    )
    found = F.when(F.size(signals) > 0, signals)
    joined = rows.withColumn("__signals", found)

    rank = raised(F.col("sev_rank"), F.coalesce(F.size("__signals"), F.lit(0)))
    changed = rank != F.col("sev_rank")
    noted = F.col("__signals").isNotNull() & (changed | F.lit(keep_tags))
    why = F.left(
        F.concat_ws(
            "; ",
            F.nullif(F.col("data")["why"], F.lit("")),
            F.array_join(F.transform("__signals", lambda s: s["why"]), "; "),
        ),
        F.lit(WHY_LIMIT),
    )
    updated = {
        "severity": F.when(changed, level_name(rank)).otherwise(F.col("severity")),
        "sev_rank": rank,
        "tags": F.when(
            noted, F.array_union("tags", F.transform("__signals", lambda s: s["tag"]))
        ).otherwise(F.col("tags")),
        "data": F.when(noted, put(F.col("data"), payload(why=why))).otherwise(F.col("data")),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in columns])


def score_against(
    events: DataFrame, baseline: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Process events whose binary another host's baseline has never seen.

    ``baseline`` is the other host's process events. Adds ``unknown_binary``.
    """
    known = (
        process_names(baseline).filter(F.col("image") != "").select(*by, "image").distinct()
        .withColumn("__known", F.lit(True))
    )
    rows = salted_join(process_names(events), known, [*by, "image"], ["id"])
    return rows.withColumn(
        "unknown_binary", (F.col("image") != "") & F.col("__known").isNull()
    ).drop("__known")
