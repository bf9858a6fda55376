"""Spelling variants: words one character apart, found on the sorted rotations of all words.

A word w closed by a mark has the rotations `tail $ head`, one for each place of a cut. The
words that differ from w in the character at a place all have a rotation that begins with
what follows that place, the mark and what precedes it: the prefix of the query skips the
edited character. The word without that character is this prefix itself. So the rotations
are stored as (prefix, skipped character), next to each word's plain rotations with nothing
skipped; sorted by prefix, every group is a set of words each one edit from the others. A
group holds one word for each character of the alphabet, and one without it: its size does
not grow with the table.

A pair that differs by one replaced character meets in one group. A pair where one word has
a character more meets once for every character of the run it belongs to ("helo", "hello"):
only the first place of a run counts. So the numbers of neighbours add up over groups, and a
scan gives each row of a group the number and the best of the others without writing pairs.

Inputs of `word_counts`: a null text has no words, a null id counts as empty in the hash;
repeated rows count each time; other columns, whatever their names, are ignored; an empty
table gives no words. Texts are read whole. Ties of frequency go to the smallest word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, after A-Z are lower-cased.
RUN = "[a-z\\u00C0-\\u00FF]+"
#: Closes a word in its rotations; no letter.
MARK = "$"
#: One run in so many loses a character.
TYPO_RATE = 199
LEAST_CHARS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5


def runs_of(text: Column) -> Column:
    """All runs of letters of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), 0)


def with_typos(doc_id: Column, run: Column, rate: int = TYPO_RATE) -> Column:
    """The run, or in one case of `rate`, chosen by id and run, the run without a character."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    place = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(h % rate == 0, shorter).otherwise(run)


def word_counts(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, rate: int = TYPO_RATE
) -> DataFrame:
    """(word, n) of all texts: counted per task first, so no frequent word is hot."""
    runs = docs.select(F.col("doc_id"), F.explode(runs_of(F.col("text"))).alias("run"))
    words = runs.where(F.length("run") >= least_chars).select(
        with_typos(F.col("doc_id"), F.col("run"), rate).alias("word")
    )
    return (
        words.where(F.length("word") >= least_chars)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count)
    )


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, counts, word, n): each rotation whole, and each with one character skipped.

    `counts`: whether a pair with the shorter word of the group is counted here, or at an
    earlier character of the same run.
    """
    word, at, size = F.col("word"), F.col("at"), F.length("word")
    char = F.substr(word, at + 1, F.lit(1))
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    head, rest = F.substring(word, F.lit(1), at), F.substr(word, at + 1)
    both = F.array(
        F.struct(F.concat(rest, F.lit(MARK), head).alias("prefix"), F.lit(None).cast("string").alias("skipped")),
        F.when(
            at < size,
            F.struct(
                F.concat(F.substr(word, at + 2), F.lit(MARK), head).alias("prefix"), char.alias("skipped")
            ),
        ),
    )
    first = (at == 0) | (F.substr(word, at, F.lit(1)) != char)
    return (
        cuts.select("word", "n", first.alias("counts"), F.explode(F.array_compact(both)).alias("r"))
        .select("r.prefix", "r.skipped", "counts", "word", "n")
    )


def scanned(words: DataFrame) -> DataFrame:
    """Every rotation with its group's size, its neighbours there and the best of them.

    (word, n_near, best (fewer, word)) of groups of two rows and more; `best` orders by
    falling frequency, then by the word.
    """
    group = Window.partitionBy("prefix")
    in_order = group.orderBy(F.col("n").desc(), "word").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    whole = F.col("skipped").isNull().cast("long")
    rank = F.struct((-F.col("n")).alias("fewer"), F.col("word").alias("word"))
    rows = (
        rotations(words)
        .withColumn("wholes", F.sum(whole).over(in_order))
        .withColumn("rows", F.count(F.lit(1)).over(in_order))
        .withColumn("counted", F.sum((F.col("skipped").isNotNull() & F.col("counts")).cast("long")).over(in_order))
        .withColumn("top", F.first(rank).over(in_order))
        .withColumn("second", F.nth_value(rank, 2).over(in_order))
        .where("rows > 1")
    )
    replaced = F.col("rows") - F.col("wholes") - 1
    longer = F.when(F.col("counts"), F.col("wholes")).otherwise(0)
    return rows.select(
        "word",
        F.when(F.col("skipped").isNull(), F.col("counted")).otherwise(replaced + longer).alias("n_near"),
        F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top")).alias("best"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) of all pairs one edit apart, each in both directions and once."""
    rows = rotations(words)
    left = rows.select("prefix", "word", "skipped", "counts")
    right = rows.select("prefix", F.col("word").alias("near"), F.col("skipped").alias("other"), F.col("counts").alias("far"))
    longer = F.col("other").isNull() & F.col("skipped").isNotNull() & F.col("counts")
    shorter = F.col("skipped").isNull() & F.col("other").isNotNull() & F.col("far")
    replaced = F.col("skipped").isNotNull() & F.col("other").isNotNull() & (F.col("skipped") != F.col("other"))
    return left.join(right, "prefix").where(longer | shorter | replaced).select("word", "near")


def forms(words: DataFrame, ratio: int = LEAST_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its commonest neighbour, if common enough."""
    best = (
        scanned(words)
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    )
    common = -F.col("best.fewer")
    clear = common >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(clear, F.col("best.word")).alias("form"),
        F.when(clear, common).cast("long").alias("form_n"),
    )


def with_roots(rows: DataFrame) -> DataFrame:
    """Adds `root`: the last word of the chain of forms; the word itself where it has no form.

    Each round doubles the steps that a link spans. A form is a multiple more frequent than
    its word, so a chain is as long as the logarithm of the largest count.
    """
    links = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("last")), "forms")
    while True:
        onward = links.select(F.col("word").alias("last"), F.col("last").alias("further"))
        links = written(
            links.join(onward, "last", "left").select(
                "word", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved")
            ),
            "forms",
        )
        moved = links.where("moved").limit(1).count()
        links = links.select("word", "last")
        if not moved:
            break
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("last", "word")).drop("last")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents."""
    words = written(word_counts(docs), "words")
    found = written(forms(words), "variants")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


#: The same from plain definitions, for the table `documents`: CRC-32 by its table, pairs by
#: shared words with a character less.
VARIANTS_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
dr AS (SELECT doc_id, run, count(*) AS c, encode(doc_id || ':' || run) AS b
       FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295],
    list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::BIGINT)),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS h
  FROM dr CROSS JOIN tab),
typed AS (
  SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, place, substr(word, 1, place) || substr(word, place + 2) AS rest
        FROM (SELECT word, unnest(range(length(word)))::INT AS place FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
  UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
ranked AS (
  SELECT p.word, p.near, f.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, p.near) AS rn
  FROM pairs p JOIN words f ON f.word = p.near),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND rn = 1),
chain AS (
  SELECT word, word AS root, form AS onward FROM formed UNION ALL
  SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.onward)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain ON chain.word = formed.word AND onward IS NULL
"""
