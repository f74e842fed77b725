"""Quality rules with column expressions alone, and cross-document line frequency by host.

Base rules look at one document. The line rule looks at a host's documents together: lines are normalised and hashed
with their host, the distinct documents that hold each are counted, lines above the limit are removed, and documents
that keep too little are rejected. Exact copies of a text are one document for the count, so that a document
is no boilerplate merely because it was crawled often.

Lines are hashed once, into a table of hashes that all later steps read. Counting distinct documents of every line would
shuffle every line twice. Rows are counted first, which adds up before the shuffle; only lines whose rows pass the limit can pass it
in distinct documents, and only those are counted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import let
from millrace.session import written

# ASCII white space, and the signs that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate of a host if it is in more distinct texts than both this many and this share of the host's.
MAX_LINE_DOCS, MAX_LINE_SHARE = 20, 0.05
#: Shorter normalised lines are never removed.
MIN_LINE = 10
#: A document is depleted if what stays has fewer words, or a smaller share of its characters in lines.
MIN_KEPT_WORDS, MIN_KEPT_SHARE = 10, 0.3
#: Boilerplate lines up to this many are broadcast (8 bytes each, some 50 in a hash table); more are joined by a shuffle.
MAX_BROADCAST_LINES = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE[1:], " " * 5), " ", -1), "")


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, each word once.

    Windows are compared by 64-bit hashes of their words' hashes. If all differ, as in most texts, none is sorted.
    """
    zero = F.lit(0).cast("bigint")
    long = lambda n: F.lit(n).cast("bigint")

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            at = F.sequence(F.lit(0), F.size(s) - 1)
            twice = F.filter(at, lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < F.size(s) - 1, same(i, i + 1)).otherwise(False))
            return F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))

        def length(starts: Column) -> Column:
            start = F.struct(long(-WINDOW).alias("at"), zero.alias("n"))
            step = lambda acc, i: F.struct(i.cast("bigint").alias("at"), (acc["n"] + F.least(long(WINDOW), i - acc["at"])).alias("n"))
            return F.aggregate(starts, start, step, lambda acc: acc["n"])

        return length(let(ordered, places))

    def judged(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(covered(hashes))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= WINDOW, zero).otherwise(let(hashes, judged))


def base_columns(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; a null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # a line of nothing but white space has no word
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    return [
        counts.alias("counts"),
        F.length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        n_dup.cast("bigint").alias("n_dup_lines"),
    ]


def _with_verdict(own: DataFrame, keep: list[str]) -> DataFrame:
    n, repeated = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    return own.select(*keep, n, "word_chars", "n_symbols", "n_dup_lines", repeated, failed.alias("base_failed"))


def normalised(line: Column) -> Column:
    """ASCII white space stripped, A-Z lower-cased, runs of digits as one 0."""
    bare = F.trim(F.translate(line, SPACE[1:] + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " " * 5 + "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_replace(bare, "[0-9]+", "0")


def line_hash(host: Column, line: Column) -> Column:
    """The hash of a host's normalised line; null for a line too short to be judged."""
    return let(normalised(line), lambda x: F.when(F.length(x) >= MIN_LINE, F.xxhash64(host, x)))


def _line_table(own: DataFrame, unit: str) -> DataFrame:
    """``(host, key, unit, i, h)`` for each judged line of each row of ``(host, key, text, unit)`` that is long enough for one, or a row without ``i`` and ``h``: a written table."""
    hashed = let(F.struct("host", F.split("text", "\n", -1).alias("lines")), lambda d: F.transform(d["lines"], lambda x, i: F.struct(i.alias("i"), line_hash(d["host"], x).alias("h"))))
    judged = F.filter(hashed, lambda x: x["h"].isNotNull())
    some = own.where(F.length("text") >= MIN_LINE)
    rows = some.select("host", "key", F.col(unit).alias("unit"), F.explode_outer(judged).alias("line"))
    return written(rows.select("host", "key", "unit", "line.i", "line.h"), "line-hashes")


def frequent_lines(lines: DataFrame) -> DataFrame:
    """Hashes ``h`` of boilerplate lines of a line table, as a written table."""
    hosts = lines.select("host", "unit").distinct().groupBy("host").agg(F.count("unit").alias("units"))
    most = F.greatest(F.lit(MAX_LINE_DOCS), F.floor(F.col("units") * MAX_LINE_SHARE)).alias("most")
    hosts = written(hosts.select(F.col("host").alias("owner"), most), "hosts")
    own = lines.where(F.col("h").isNotNull())
    often = own.groupBy("h").agg(F.count("*").alias("n"), F.min("host").alias("host")).where(F.col("n") > MAX_LINE_DOCS)
    often = written(often.join(hosts, F.col("host") == F.col("owner")).where(F.col("n") > F.col("most")).select("h", "most"), "often")
    units = own.select("h", "unit").join(often, "h").groupBy("h", "most").agg(F.count_distinct("unit").alias("units"))
    return written(units.where(F.col("units") > F.col("most")).select("h"), "boilerplate")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False, copies_count: bool = False) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for each row of ``docs``.

    ``kept`` is false for documents that fail a base rule or are depleted of lines. A line's and a host's documents are counted
    by their texts, or with ``copies_count`` by their ids, so that copies of a text count one by one (rows with a null id do not
    count then). With ``carry``, ``row`` holds the other columns and ``kept_text`` the text without boilerplate lines (null for a
    null text). A null or empty text has no words and fails. Rows with a null host share one host. Rows are judged one by one, so
    repeated rows and ids and null ids come out as they went in; an empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    own = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{host_col}`").cast("string")).alias("host"),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if carry else []),
    )
    # what a document loses follows from its host and text, so these name it, whatever order rows come in
    own = own.withColumn("key", F.unhex(F.md5(F.concat_ws(" ", "host", "text"))))
    lines = _line_table(own, "id" if copies_count else "key")
    bad = frequent_lines(lines)
    n_bad = bad.count()
    extra = ["row", "kept_text"] if carry else []
    lead = ["id", *(["row"] if carry else [])]
    if not n_bad:
        out = own.select(*lead, *([F.col("text").alias("kept_text")] if carry else []), *base_columns(F.col("text")))
        out = _with_verdict(out, ["id", *extra])
        return out.withColumn("kept", ~F.col("base_failed"))
    parts = F.transform(
        F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.length(F.translate(x, SPACE, "")).cast("bigint").alias("chars"))
    )
    if n_bad <= MAX_BROADCAST_LINES:
        bad = F.broadcast(bad)
    hit = lines.select("key", "i", "h").where(F.col("h").isNotNull()).join(bad, "h")
    # one text's removed lines meet, bounded by the text; equal texts name the same ones
    lost = written(hit.groupBy(F.col("key").alias("loser")).agg(F.collect_set("i").alias("gone")), "lost")
    joined = own.join(lost.hint("shuffle_hash"), F.col("key") == F.col("loser"), "left")
    stay = let(
        F.struct(parts.alias("parts"), "gone"),
        lambda d: F.transform(F.array_except(F.transform(d["parts"], lambda p: p["i"]), d["gone"]), lambda i: F.get(d["parts"], i)),
    )
    stay = F.when(F.col("gone").isNotNull(), stay)
    summed = let(
        stay,
        lambda s: F.struct(
            F.array_join(F.transform(s, lambda p: p["line"]), "\n").alias("text"), F.aggregate(s, F.lit(0).cast("bigint"), lambda a, p: a + p["chars"]).alias("chars")
        ),
    )
    out = joined.select(*lead, "gone", "text", summed.alias("after"), *base_columns(F.col("text")))
    kept_words = F.size(words_of(F.col("after.text")))
    depleted = F.when(F.col("gone").isNotNull(), (kept_words < MIN_KEPT_WORDS) | (F.col("after.chars") < MIN_KEPT_SHARE * F.col("word_chars"))).otherwise(False)
    out = out.select(*lead, F.coalesce("after.text", "text").alias("kept_text"), depleted.alias("depleted"), "counts", "word_chars", "n_symbols", "n_dup_lines")
    out = _with_verdict(out, ["id", *extra, "depleted"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("depleted")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept rows of ``docs``, without boilerplate lines; ``chars_col``, where there is one, is counted anew.

    Null and empty texts go, as they have no words; rows with null or repeated ids and null hosts are judged like any other; an
    empty table gives an empty table. Columns of any name are carried.
    """
    done = judge(docs, id_col, text_col, host_col, carry=True).where("kept")
    named = {id_col: F.col("id"), text_col: F.col("kept_text")}
    if chars_col in docs.columns:
        named[chars_col] = F.length("kept_text").cast(docs.schema[chars_col].dataType)
    return done.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
