"""Removal of passages that repeat across documents, in chunks of lines.

A text is cut into lines, and lines into chunks at places that the lines themselves
choose: between two lines whose rolled hash is a multiple of `divisor`, and around a line
of more than `words` words. What is inserted before a passage so moves no cut inside it.
Chunks whose hash occurs more than once are compared by their bytes; the first place, by
id and line, keeps its text. Later places of adjacent repeated chunks form a passage, and
passages of more than `words` words are removed. Words are counted as spaces plus one.
Lines at a passage's edges may share a chunk with the lines outside, which hides them; with
`whole`, the shortest ranges of more than `words` words from and to each line are searched too,
compared by SHA-256, and every repeated passage of several lines goes with its edges.

Only DataFrame functions are used. The texts cross the network twice by id, and once more
the repeated chunks alone; counts and places are narrow rows. Nulls: a null text stays
null; a null id comes first. Rows equal in id and text are treated alike. An empty text
is one empty line. An empty table gives an empty result. Extra columns are kept; one named
as a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoorline.llm.common import packed, unpacked, written

ROLL = 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines")
    )


def with_cuts(rows: DataFrame, divisor: int, words: int) -> DataFrame:
    """Adds `starts`, the numbers of the lines that begin a chunk, and each line's words."""
    hashed = rows.withColumn("h", F.transform("lines", line_hash)).withColumn("w", F.transform("lines", n_words))

    def begins(i: Column) -> Column:
        rolled = F.get("h", i - 1) * ROLL + F.get("h", i)
        long_ = (F.get("w", i) > words) | (F.get("w", i - 1) > words)
        return (i == 0) | (rolled % divisor == 0) | long_

    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    return hashed.withColumn("starts", F.filter(numbers, begins))


def chunk_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start), "\n")


def chunks(docs: DataFrame, id: str, text: str, divisor: int, words: int) -> DataFrame:
    """Rows (id, mark, start, end, words, hash), one per chunk."""
    cut = with_cuts(keyed(docs, id, text).where("lines is not null"), divisor, words)

    def chunk(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("lines"))
        total = F.aggregate(F.slice("w", start + 1, end - start), F.lit(0), lambda a, x: a + x)
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            total.alias("words"),
            F.xxhash64(chunk_text(F.col("lines"), start, end)).alias("hash"),
        )

    return cut.select("id", "mark", F.explode(F.transform("starts", chunk)).alias("c")).select("id", "mark", "c.*")


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id_"]) & (a["mark"] == b["mark_"])


def marked(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "id_").withColumnRenamed("mark", "mark_")


def windows(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """Rows (id, mark, start, end, hash): the shortest ranges of more than `words` words.

    For each line the one that begins there and the one that ends there. A longer range that
    occurs twice is covered by those inside it, which occur twice as well. Ranges of a single
    line are left out, as those are chunks. No line has less than one word, so none is longer
    than `words` + 1 lines.
    """
    rows = keyed(docs, id, text).where(F.size("lines") > 1)
    rows = rows.withColumn("w", F.transform("lines", lambda x: n_words(x).cast("long")))
    rows = rows.withColumn("v", F.reverse("w")).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    size = F.size("lines")

    def reach(counts: str, i: Column) -> Column:
        """How many lines from i on it takes, null where all are too few."""
        more = lambda a, x: F.when(F.shiftright(a, 20) > words, a).otherwise(a + F.shiftleft(x, 20) + 1)
        total = F.aggregate(F.slice(counts, i + 1, words + 1), F.lit(0).cast("long"), more)
        return F.when(F.shiftright(total, 20) > words, total.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))

    def place(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    numbers = F.sequence(F.lit(0), size - 1)
    after = F.transform(numbers, lambda i: place(i, i + reach("w", i)))
    before = F.transform(numbers, lambda i: place(size - i - reach("v", i), size - i))
    long_ = F.filter(F.array_union(after, before), lambda p: p["end"] - p["start"] > 1)
    found = rows.select("id", "mark", "hashes", F.explode(long_).alias("p"))
    part = F.slice("hashes", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return found.select("id", "mark", "p.start", "p.end", F.xxhash64(part).alias("hash"))


def later_places(narrow: DataFrame, docs: DataFrame, id: str, text: str, form: Callable[[Column], Column]) -> DataFrame:
    """The rows of `narrow` whose lines, in the given form, stand at an earlier place as well."""
    often = written(narrow.groupBy(F.col("hash").alias("often")).count().where("count > 1").select("often"), "often")
    places = written(narrow.join(often, narrow["hash"] == often["often"]).drop("often", "hash"), "places")
    per_doc = marked(places.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("found")))
    rows = keyed(docs, id, text)
    held = rows.join(per_doc.hint("merge"), same_text(rows, per_doc))
    texts = held.select("id", "mark", "lines", F.explode("found").alias("c")).select(
        F.struct("id", "c.start", "mark", "c.end").alias("place"),
        form(chunk_text(F.col("lines"), F.col("c.start"), F.col("c.end"))).alias("bytes"),
    )
    first = texts.groupBy("bytes").agg(F.min("place").alias("place")).select("place.*")
    first = first.select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), F.col("start").alias("start_"), F.col("end").alias("end_"))
    first = written(first, "first")
    same = same_text(places, first) & (places["start"] == first["start_"]) & (places["end"] == first["end_"])
    return places.join(first, same, "left_anti").distinct()


def repeated_windows(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """Rows (id, mark, start, end): ranges of several lines that stand at an earlier place."""
    narrow = written(windows(docs, id, text, words), "windows")
    return later_places(narrow, docs, id, text, lambda x: F.sha2(x, 256))


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges that overlap or touch as one."""
    by_doc = Window.partitionBy("id", "mark").orderBy("start", "end")
    reached = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("fresh", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "mark", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def repeated_passages(docs: DataFrame, id: str, text: str, divisor: int = 2, words: int = 50) -> DataFrame:
    """Rows (id, mark, start, end): line ranges that repeat an earlier place."""
    narrow = written(chunks(docs, id, text, divisor, words), "chunks")
    later = later_places(narrow, docs, id, text, lambda x: x)
    by_doc = Window.partitionBy("id", "mark").orderBy("start")
    fresh = (F.col("start") != F.lag("end", 1, -1).over(by_doc)).cast("int")
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_doc))
    passages = runs.groupBy("id", "mark", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words")
    )
    return passages.where(F.col("words") > words).select("id", "mark", "start", "end")


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", divisor: int = 2, words: int = 50, whole: bool = False
) -> DataFrame:
    """The documents with repeated passages removed; adds `n_lines` and `n_removed`.

    With `whole`, also every passage of several lines wherever the chunks are cut.
    """
    found = repeated_passages(docs, id, text, divisor, words)
    if whole:
        found = merged(found.union(repeated_windows(docs, id, text, words)))
    gone = marked(
        written(found, "passages").groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("gone_"))
    )
    rows = packed(
        docs,
        F.col(id).cast("long").alias("id"),
        F.xxhash64(text).alias("mark"),
        F.split(text, "\n", -1).alias("lines"),
    )
    joined = rows.join(gone.hint("merge"), same_text(rows, gone), "left")
    kept = F.filter("lines", lambda line, i: ~F.exists("gone_", lambda g: (i >= g["start"]) & (i < g["end"])))
    removed = F.aggregate("gone_", F.lit(0), lambda a, g: a + g["end"] - g["start"])
    old = F.col("row").getField(text)
    new = {
        text: F.when(F.col("gone_").isNull(), old).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(old.isNull(), 0).otherwise(F.size("lines")),
        "n_removed": F.coalesce(removed, F.lit(0)),
    }
    return unpacked(joined, docs, **new)


#: The same result said in SQL. MD5 stands for the hash that finds equal chunks there.
REPEATED_SQL = r"""
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {docs} WHERE text IS NOT NULL),
meas AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h,
         length(line) - length(replace(line, ' ', '')) + 1 AS w FROM line),
edge AS (SELECT *, CASE WHEN i = 0 OR (lag(h) OVER d * 31 + h) % 2 = 0 OR w > 50 OR lag(w) OVER d > 50
         THEN 1 ELSE 0 END AS cut FROM meas WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numb AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM edge),
chunk AS (SELECT doc_id, c, min(i) AS s, max(i) + 1 AS e, sum(w) AS words,
          string_agg(line, chr(10) ORDER BY i) AS bytes FROM numb GROUP BY doc_id, c),
later AS (SELECT doc_id, s, e, words FROM
          (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, s) AS place FROM chunk) WHERE place > 1),
fresh AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS f FROM later),
runs AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM fresh),
gone AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM runs GROUP BY doc_id, run HAVING sum(words) > 50),
kept AS (SELECT l.doc_id, l.i, l.line, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.i >= g.s AND l.i < g.e) AS out
         FROM line l),
clean AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
          coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '') AS text FROM kept GROUP BY doc_id)
"""
