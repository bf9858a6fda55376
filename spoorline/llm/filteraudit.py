"""How filters interact: what each removes, alone and after others, in every order.

Every document fails a set of the filters, a mask. Counts of documents (all, good, toxic) by
part and mask are all that the orders depend on. For each part the subsets of filters are
walked in Gray-code order: one filter is switched on or off at a time, every cell whose mask
holds it moves its counter of active failures, and a cell that goes from none to one leaves
the running survivors, or comes back at none. The survivors of all 2^n subsets are stored;
a step of an order is the difference of two of them.

Texts are read once, into one narrow row each. A document repeats another if its text has
a smaller id elsewhere: the least id of a text is an aggregate that is combined before the
shuffle, and it meets the rows by text and id together, so a text that a third of all
documents share puts no load on one task.

Inputs: a null text is empty; a null source is the part ''; a null id repeats nothing and
has no labels; of equal ids with equal texts the smallest fail no more than one alone does.
Labels of an id are joined to one row (quality or toxic if any row says so). Other columns
are ignored. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Fixed values of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT = 50, 65, 5
SPACE, UPPER, MARKS = r"[\x20\x09-\x0D]+", r"[^A-Z]+", r"[#$%&*|]"
MEASURES = ("n", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters A to D; `text` is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, UPPER, ""))
    few = F.size(words) < LEAST_WORDS
    poor = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words)
    loud = 100 * upper > MOST_UPPER_PCT * F.length(text)
    return [few, poor, loud, text.rlike(MARKS)]


def mask_of(failed: list[Column]) -> Column:
    bits = [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole + bit
    return whole


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, salt, part, mask): the filters that each document fails, repeats among them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Null ids match nothing; the number of their task keeps them from meeting in one.
    salt = F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0)
    read = docs.select("doc_id", salt.alias("salt"), F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = read.select(
        "doc_id", "salt", "part", F.sha2("t", 256).alias("mark"), mask_of(failures(F.col("t"))).alias("mask")
    )
    least = rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    known = least.select("mark", "doc_id", F.lit(0).alias("salt"), F.lit(True).alias("is_first"))
    repeat = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(known, ["mark", "doc_id", "salt"], "left").select(
        "doc_id", "salt", "part", (F.col("mask") + F.when(repeat, 1 << 4).otherwise(0)).alias("mask")
    )


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail the same filters."""
    told = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
        )
        .withColumn("salt", F.lit(0))
    )
    both = masks.join(told, ["doc_id", "salt"], "left")
    return both.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"),
    )


def survivors(counts: np.ndarray) -> np.ndarray:
    """What is left under every set of filters: (parts, masks, measures) to (parts, sets, measures)."""
    parts, masks, measures = counts.shape
    filters = masks.bit_length() - 1
    holds = [np.flatnonzero(np.arange(masks) >> f & 1) for f in range(filters)]
    active = np.zeros(masks, dtype=np.int64)
    running = counts.sum(axis=1)
    states = np.empty((parts, masks, measures), dtype=np.int64)
    chosen = 0
    states[:, chosen] = running
    for step in range(1, masks):
        f = (step & -step).bit_length() - 1  # the bit in which Gray codes of step - 1 and step differ
        chosen ^= 1 << f
        cell = holds[f]
        if chosen >> f & 1:
            active[cell] += 1
            running = running - counts[:, cell[active[cell] == 1]].sum(axis=1)
        else:
            active[cell] -= 1
            running = running + counts[:, cell[active[cell] == 0]].sum(axis=1)
        states[:, chosen] = running
    return states


def steps(states: np.ndarray, letters: str) -> pd.DataFrame:
    """All orders and steps of each part (`at` numbers the parts), as differences of states."""
    parts, every = len(states), len(letters)
    full = (1 << every) - 1
    orders = list(permutations(range(every)))
    before = np.zeros((len(orders), every), dtype=np.int64)
    which = np.array(orders, dtype=np.int64)
    np.cumsum((1 << which)[:, :-1], axis=1, out=before[:, 1:])
    after = before | (1 << which)
    lost = states[:, before] - states[:, after]
    fails = states[:, [0]] - states[:, 1 << np.arange(every)]
    alone = states[:, full ^ (1 << np.arange(every))] - states[:, [full]]
    shapley = np.zeros((parts, every), dtype=np.int64)
    for f in range(every):
        shapley[:, f] = lost[:, :, :, 0][:, which == f].sum(axis=1)
    shape = (parts, *which.shape)
    flat = lambda x: np.broadcast_to(x, shape).reshape(-1)
    names = np.array(["".join(letters[f] for f in o) for o in orders], dtype=object)
    return pd.DataFrame(
        {
            "at": flat(np.arange(parts)[:, None, None]),
            "filter_order": flat(names[None, :, None]),
            "step": flat(np.arange(1, every + 1)[None, None, :]).astype(np.int32),
            "kept": flat(states[:, after, 0]),
            "removed": flat(lost[..., 0]),
            "redundant": flat(fails[:, which, 0] - lost[..., 0]),
            "unique_fails": flat(alone[:, which, 0]),
            "good_lost": flat(lost[..., 1]),
            "toxic_lost": flat(lost[..., 2]),
            "shapley": flat(shapley[:, which]),
        }
    )


def audit(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every part, order of filters and step, from (part, mask, n, good, toxic)."""
    masks = 1 << len(letters)
    listed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # So many parts at a time that their rows stay small.
            for start in range(0, len(batch), 64):
                piece = batch.iloc[start : start + 64]
                counts = np.zeros((len(piece), masks, len(MEASURES)), dtype=np.int64)
                for i, found in enumerate(piece["cells"]):
                    for cell in found:
                        counts[i, cell["mask"]] += [cell[m] for m in MEASURES]
                out = steps(survivors(counts), letters)
                out.insert(0, "part", piece["part"].to_numpy()[out.pop("at")])
                yield out

    return listed.mapInPandas(walk, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over all documents, by source."""
    return audit(cells(document_masks(docs), labels))


#: The same from plain definitions, for tables `documents` and `labels`.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
first_of AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
w AS (SELECT d.doc_id, part, d.t, least, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS words
      FROM d JOIN first_of ON first_of.t = d.t),
m AS (SELECT doc_id, part,
  CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT '' AS filter_order, 0 AS used, 0 AS step, 0 AS before, 0 AS f UNION ALL
      SELECT filter_order || substr('ABCDE', (f.f + 1)::INT, 1), (used + (1 << f.f))::INT, step + 1, used, f.f::INT
      FROM o JOIN f ON (used >> f.f) & 1 = 0 WHERE step < 5),
whole AS (SELECT filter_order FROM o WHERE step = 5),
place AS (SELECT whole.filter_order, o.step, o.before, o.f, o.used FROM whole JOIN o
          ON o.step > 0 AND starts_with(whole.filter_order, o.filter_order)),
r AS (SELECT part, filter_order, step, place.f,
  sum(CASE WHEN mask & used = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND (mask >> place.f) & 1 = 1 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND (mask >> place.f) & 1 = 1 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = (1 << place.f) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND (mask >> place.f) & 1 = 1 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND (mask >> place.f) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN place GROUP BY part, filter_order, step, place.f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
