"""Log lines and file inventories from storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.text import any_of, file_name
from spoorline.sources.files import digests, list_files, numbered, ranges, read_table



def plain_path(uri: Column) -> Column:
    """The path a file URI stands for."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")), r"^file:/+", "/")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, line_no, value, mtime) of text files of any name, plain or gz/bz2 by extension.

    Bad bytes become replacement characters. Files are read once, by ranges, into a table;
    the lines of a range are numbered there from the counts of the ranges before. Files that
    cannot be read give no line here; :func:`unreadable` lists them.
    """
    listed = list_files(spark, paths).where("error IS NULL").drop("error")
    lines = numbered(read_table(ranges(listed)))
    return lines.where("value IS NOT NULL").select("path", "line_no", "value", "mtime")


def unreadable(lines: DataFrame) -> DataFrame:
    """(path, error): files whose reading ended with an error, from a table of lines."""
    return lines.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))


# Leading bytes (hex) and the kind they name; first match wins.
MAGIC = (
    ("72656766", "registry"),
    ("456C6646696C6500", "evtx"),
    ("46494C4530", "mft"),
    ("42414144", "mft"),
    ("53514C69746520666F726D6174203300", "sqlite"),
    ("4D414D04", "prefetch"),
    ("D4C3B2A1", "pcap"),
    ("A1B2C3D4", "pcap"),
    ("4D3CB2A1", "pcap"),
    ("A1B23C4D", "pcap"),
    ("0A0D0D0A", "pcapng"),
    ("1F8B", "gzip"),
    ("425A68", "bzip2"),
    ("FD377A585A00", "xz"),
    ("504B0304", "zip"),
    ("4D5A", "pe"),
    ("7F454C46", "elf"),
    ("25504446", "pdf"),
    ("D0CF11E0", "ole"),
    ("7668647866696C65", "vhdx"),
    ("636F6E6563746978", "vhd"),
    ("6378737061727365", "vhd"),
    ("455646090D0AFF00", "ewf"),
    ("4C5646090D0AFF00", "ewf"),
    ("4B444D56", "vmdk"),
    ("514649FB", "qcow2"),
)
LNK_HEADER, LNK_CLASS = "4C000000", "0114020000000000C000000000000046"
SYSLOG_MARKERS = ("sshd[", "sudo:", "systemd[", "cron[", "kernel:", "CRON[")


def file_kind(header: Column) -> Column:
    """Kind of a file from its first 512 bytes: magic, shortcut, text or binary."""
    hexed = F.hex(header)
    kind: Column | None = None
    for magic, name in MAGIC:
        test = hexed.startswith(magic)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    text = F.decode(header, "ISO-8859-1")
    size = F.length(header)
    printable = F.length(F.regexp_replace(text, r"[^\x09-\x0d\x20-\x7e]", ""))
    is_text = ~text.contains("\u0000") & (printable / F.nullif(size, F.lit(0)) > 0.85)
    return (
        kind.when(F.substring(hexed, 9, 8) == "53434341", "prefetch")
        .when(hexed.startswith(LNK_HEADER) & F.substring(hexed, 1, 64).contains(LNK_CLASS), "lnk")
        .when(size == 0, "empty")
        .when(is_text & any_of([text.contains(m) for m in SYSLOG_MARKERS]), "syslog")
        .when(is_text, "text")
        .otherwise("binary")
    )


def inventory(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file: path, sha256, kind, size, mtime, header, error.

    The bytes pass by for the digest and are not kept; a file that cannot be read has its
    error and no digest.
    """
    found = digests(list_files(spark, paths)).filter(~F.col("path").contains("/__pycache__/"))
    return found.select(
        "path", "sha256", file_kind(F.col("header")).alias("kind"), "size", "mtime", "header", "error"
    )


def inventory_of(files: DataFrame) -> DataFrame:
    """The same for any table with path, content, length, modificationTime."""
    header = F.substring(F.col("content"), 1, 512)
    return (
        files.filter(~F.col("path").contains("/__pycache__/"))
        .withColumn("sha256", F.sha2(F.col("content"), 256))
        .withColumn("header", header)
        .withColumn("kind", file_kind(F.col("header")))
        .select(
            "path",
            "sha256",
            "kind",
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"),
            "header",
            "content",
        )
        .dropDuplicates(["path", "sha256"])
    )


# Names each reader claims, and how sure it is.
MAGIC_CONFIDENCE, KIND_CONFIDENCE, NAME_CONFIDENCE = 1.0, 0.9, 0.6
HISTORY_NAMES = (
    ".bash_history", "bash_history", ".sh_history", ".zsh_history", "zsh_history",
    ".ksh_history", ".history", ".zhistory", ".local_history",
    ".mysql_history", ".psql_history", ".sqlite_history", ".dbshell",
    ".rediscli_history", ".mongorc_history", "mongosh_repl_history",
    ".python_history", ".node_repl_history", ".irb_history", ".php_history",
    ".lesshst", ".viminfo",
)
SYSLOG_TOKENS = ("sshd[", "sudo:", "systemd[", "cron[", "kernel:")
SYSLOG_NAMES = ("auth.log", "secure", "syslog", "messages")
NOT_A_HIVE = (".log", ".log1", ".log2", ".blf")
HIVE_NAMES = ("ntuser.dat", "usrclass.dat", "system", "software", "sam", "security", "amcache.hve")
MONGOD_NAMES = r"^(?:mongod\.log(?:\..*)?|mongodb\.log|mongos\.log)$"
BODYFILE_NAMES = r"^(?:bodyfile\.txt|bodyfile|.*\.body)$"


def config_handler(path: Column) -> Column:
    """Which configuration reader covers a file; blank when none does."""
    text = F.lower(F.translate(path, "\\", "/"))
    name = F.substring_index(text, "/", -1)
    return (
        F.when(
            name.isin("mongod.conf", "mongodb.conf", "redis.conf", "postgresql.conf"), "service"
        )
        .when(name == "sshd_config", "sshd")
        .when(name == "passwd", "passwd")
        .when(name == "shadow", "shadow")
        .when((name == "sudoers") | text.contains("/sudoers.d/"), "sudoers")
        .when(name.startswith("authorized_keys"), "authorized_keys")
        .when(
            (name == "crontab") | text.contains("/cron.") | text.contains("/spool/cron/"), "cron"
        )
        .when(name == "ld.so.preload", "preload")
        .otherwise("")
    )


def route(artifacts: DataFrame) -> DataFrame:
    """Adds the best ``parser`` and its ``confidence``; ties go to the first name."""
    from spoorline.functions.paths import is_collector_noise
    from spoorline.sources.bodyfile import bodyfile_fields

    path, kind = F.col("path"), F.col("kind")
    name = F.lower(file_name(path))
    header = F.decode(F.col("header"), "ISO-8859-1")
    head = F.lower(header)
    first = F.substring_index(header, "\n", 1)
    is_hive = ~any_of([name.endswith(s) for s in NOT_A_HIVE])
    body = bodyfile_fields(first)
    is_body = (F.size(F.split(first, r"\|")) >= 11) & (
        F.coalesce(body["a"], body["m"], body["c"], body["b"]).isNotNull()
    )
    textual = kind.isin("text", "syslog")
    size = F.length(F.col("header"))
    printable = F.length(F.regexp_replace(header, r"[^\x09-\x0d\x20-\x7e]", ""))
    plain = (size > 0) & ~header.contains("\u0000") & (printable / F.nullif(size, F.lit(0)) > 0.85)
    claims = {
        "bodyfile": F.when(is_body, MAGIC_CONFIDENCE).when(
            name.rlike(BODYFILE_NAMES), NAME_CONFIDENCE
        ),
        "evtx": F.when(kind == "evtx", MAGIC_CONFIDENCE).when(
            name.endswith(".evtx"), NAME_CONFIDENCE
        ),
        "generic_text": F.when(is_collector_noise(path), None)
        .when(textual, 0.2)
        .when(plain, 0.15),
        "linux_config": F.when(config_handler(path) != "", 0.75),
        "linux_syslog": F.when(any_of([head.contains(t) for t in SYSLOG_TOKENS]), 0.85)
        .when(any_of([name.startswith(n) for n in SYSLOG_NAMES]), 0.7)
        .when(kind == "syslog", 0.65),
        "mongodb": F.when(
            header.startswith("{")
            & F.left(header, F.lit(400)).contains('"$date"')
            & F.left(header, F.lit(400)).contains('"ctx"'),
            MAGIC_CONFIDENCE,
        ).when(name.rlike(MONGOD_NAMES), NAME_CONFIDENCE),
        "registry": F.when(is_hive & (kind == "registry"), MAGIC_CONFIDENCE).when(
            is_hive & (name.isin(*HIVE_NAMES) | name.endswith(".hve")), NAME_CONFIDENCE
        ),
        "shell_history": F.when(name.isin(*HISTORY_NAMES), 0.85),
    }
    # Smallest (-confidence, name) is the surest, first-named claim.
    ranked = F.array_compact(
        F.array(
            *[
                F.when(
                    sure.isNotNull(),
                    F.struct((-sure).cast("double").alias("order"), F.lit(parser).alias("parser")),
                )
                for parser, sure in claims.items()
            ]
        )
    )
    best = F.array_min(ranked)
    return artifacts.withColumn("parser", best["parser"]).withColumn(
        "confidence", -best["order"]
    )


def lines_of(table: DataFrame, path: Column, text: Column, mtime: Column) -> DataFrame:
    """A lines table from rows that each hold a whole text."""
    return table.select(
        path.alias("path"),
        mtime.cast("timestamp").alias("mtime"),
        F.posexplode(F.split(text, "\n")).alias("__at", "value"),
    ).select("path", (F.col("__at") + 1).cast("long").alias("line_no"), "value", "mtime")


