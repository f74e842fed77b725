"""Secret scanning with column expressions alone: no shuffle, no Python on the executors.

Three kinds of patterns find secrets by their form. Beyond them, candidate strings that mix letters and digits are
judged by the Shannon entropy of a window that slides over them, in the alphabet of their character class. The
counts of the window's characters are kept and changed by the character that comes in and the one that goes out, so
a step costs the same at any window length. Candidates of well-known harmless forms are suppressed, and so are those
within a span of the patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import cut_spans, last, let, match_spans, running_max

# The patterns of the three kinds and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

KINDS = ["assign", "access", "hex", "entropy"]
#: Characters of a window.
WINDOW = 24
#: Windows that are looked at before it is asked whether one was enough.
BLOCK = 2048
#: Character classes in the order of their test: name, pattern of a whole candidate, alphabet, entropy in bits that the
#: window must reach. A random window has about 3.4 bits of hexadecimal digits and 4.3 bits of base-64 ones.
CLASSES = [
    ("hex", r"^(?:0[xX])?[0-9A-Fa-f]+$", "0123456789abcdefx", 3.0),
    ("base64", r"^[A-Za-z0-9+/=_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 4.0),
]
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Candidates that mix: without all of these a window can't be a key.
MIXED = [r"[0-9]", r"[A-Za-z]"]
#: Equal characters in a row that no key has.
RUN = 12
#: Harmless forms: UUIDs, digests that say so, placeholders (not in a name that something is assigned to) and runs, paths of words, words joined by signs, long numbers.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^(?i:sha1|sha256|sha384|sha512|md5)[-=_]",
    r"(?i:example|sample|placeholder|dummy|changeme|xxxx|0123456789|123456789|abcdefgh)[^=]*={0,2}$",
    rf"(.)\1{{{RUN - 1}}}",
    r"^(/?[A-Za-z0-9]{1,12}){0,1}([/_=+-]+[A-Za-z]*[0-9]{0,4}){2,}$",
]



def peak_entropy(candidate: Column, alphabet: str) -> Column:
    """The highest entropy, in bits, of a window of WINDOW characters in ``candidate``, all of them from ``alphabet``.

    With counts c, W * entropy = W * log2 W - sum of c * log2 c; the sum is what a step changes. Counts are packed, eight
    of 5 bits in a long, so a step writes a few numbers and not one for each character of the alphabet.
    """
    weights = F.array(*[F.lit(w) for w in [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]])
    units = F.array(*[F.lit(1 << 5 * k).cast("bigint") for k in range(8)])
    shift = lambda x, by: F.call_function("shiftright", x, by)
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)

    def run(at: Column, table: Column, unit: Column) -> Column:
        change = lambda c, by: F.get(table, c + by) - F.get(table, c)
        count = lambda counts, code: shift(F.get(counts, shift(code, F.lit(3))), code.bitwiseAND(F.lit(7)) * 5).bitwiseAND(F.lit(31)).cast("int")

        def step(state: Column, i: Column) -> Column:
            counts, total, least = state["counts"], state["total"], state["least"]
            pair = F.struct(F.get(at, i).alias("come"), F.when(i >= WINDOW, F.get(at, i - WINDOW)).otherwise(F.lit(-1)).alias("go"))

            def moved(p: Column) -> Column:
                come, go = p["come"], p["go"]
                places = F.struct(
                    shift(come, F.lit(3)).alias("to"), F.get(unit, come.bitwiseAND(F.lit(7))).alias("more"),
                    shift(go, F.lit(3)).alias("off"), F.when(go >= 0, F.get(unit, go.bitwiseAND(F.lit(7)))).otherwise(F.lit(0).cast("bigint")).alias("less"),
                )
                after = let(places, lambda q: F.transform(counts, lambda c, j: c + F.when(j == q["to"], q["more"]).otherwise(F.lit(0)) - F.when(j == q["off"], q["less"]).otherwise(F.lit(0))))
                left = F.when(go < 0, F.lit(0.0)).otherwise(change(count(counts, go) + F.when(go == come, 1).otherwise(0), -1))
                return let(
                    total + change(count(counts, come), 1) + left,
                    lambda now: F.struct(after.alias("counts"), now.alias("total"), F.when(i >= WINDOW - 1, F.least(least, now)).otherwise(least).alias("least")),
                )

            return let(pair, moved)

        zero = F.array_repeat(F.lit(0).cast("bigint"), -(-len(alphabet) // 8))
        start = F.struct(zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(float(WINDOW * 64)).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step, lambda s: F.lit(math.log2(WINDOW)) - s["least"] / WINDOW)

    return let(weights, lambda table: let(units, lambda unit: let(codes, lambda at: run(at, table, unit))))


def reaches(candidate: Column, alphabet: str, bits: float) -> Column:
    """Whether a window of ``candidate`` has an entropy of ``bits``: block by block up to the first such window.

    A window of so many bits has 2 to that power of different characters at least.
    """
    starts = F.sequence(F.lit(0), F.length(candidate) - WINDOW, F.lit(BLOCK))
    found = F.exists(starts, lambda s: peak_entropy(F.substring(candidate, s + 1, F.lit(BLOCK + WINDOW - 1)), alphabet) >= bits)
    return F.when(F.size(F.array_distinct(F.split(candidate, ""))) >= math.ceil(2**bits - 1e-9), found).otherwise(F.lit(False))


def is_random(candidate: Column) -> Column:
    """Whether a window of a candidate reaches its class's entropy and no allow-list form suppresses it."""
    mixed = F.lit(True)
    for pattern in MIXED:
        mixed &= candidate.rlike(pattern)
    for pattern in ALLOWED:
        # a possessive group is matched in a loop and not by recursion, which long candidates would exhaust; what it takes, no other way could leave
        mixed &= ~candidate.rlike(pattern.replace("{2,}$", "{2,}+$"))
    verdict = F.lit(False)
    for _, whole, alphabet, bits in reversed(CLASSES):
        own = F.lower(candidate) if alphabet == alphabet.lower() else candidate
        verdict = F.when(candidate.rlike(whole), reaches(own, alphabet, bits)).otherwise(verdict)
    return F.when(mixed, verdict).otherwise(False)


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans ``(start, end)`` of the three pattern kinds, in code points, end exclusive."""

    def assigned(hits: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
        both = F.zip_with(match_spans(text, ASSIGN, hits), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
        return F.transform(F.filter(both, lambda s: s["n"] >= LEAST_VALUE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # longest runs only: shorter ones neither count nor stand in the way of another
    access, digits = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", f"[0-9a-f]{{{LEAST_HEX},}}"
    assign = let(F.regexp_extract_all(text, F.lit(ASSIGN), 0), lambda hits: F.when(F.size(hits) > 0, assigned(hits)).otherwise(none))
    return (
        assign,
        let(F.regexp_extract_all(text, F.lit(access), 0), lambda hits: match_spans(text, access, hits)),
        let(F.regexp_extract_all(text, F.lit(digits), 0), lambda hits: match_spans(text, digits, hits)),
    )


def scan(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a column ``into``: an array of ``(start, kind, end)`` by start and kind, kind a place in KINDS.

    A null or empty text has none. Every row is judged by its own text, so repeated rows and nulls elsewhere change
    nothing, and an empty table gives an empty table. An existing column of that name is replaced.
    """
    return docs.withColumn(into, secret_spans(F.col(f"`{text_col}`")))


def secret_spans(text: Column) -> Column:
    """The spans of ``scan``. A candidate is within a span of the patterns if one that begins no later ends no earlier."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def every(known: Column, hits: Column) -> Column:
        own = F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("").alias("hit")))
        fresh = F.zip_with(match_spans(text, CANDIDATE, hits), hits, lambda s, h: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), h.alias("hit")))

        def kept(spans: Column) -> Column:
            covered = running_max(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0).cast("bigint"))))
            told = F.zip_with(spans, covered, lambda s, c: F.struct(s.alias("s"), c.alias("c")))
            stay = F.filter(told, lambda x: F.when(x["s"]["kind"] < 3, F.lit(True)).when(x["c"] >= x["s"]["end"], F.lit(False)).otherwise(is_random(x["s"]["hit"])))
            return F.transform(stay, lambda x: bare(x["s"]))

        return F.when(F.size(hits) > 0, let(F.array_sort(F.concat(own, fresh)), kept)).otherwise(F.array_sort(F.transform(known, bare)))

    assign, access, digits = base_spans(text)
    base = F.concat(_kind(assign, 0), _kind(access, 1), _kind(digits, 2))
    return let(base, lambda known: let(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda hits: every(known, hits)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)`` for each row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scan(own, "text", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select(
        "id", count(0), count(1), count(2), count(3), F.sha2(listed(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping or touching spans in the text replaced with ``mark``; ``chars_col`` is counted anew.

    Null and empty texts and texts without a secret stay as they are, with what ``chars_col`` said. All rows stay, whatever
    repeats or is null; columns of any name are carried; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), secret_spans(F.col(f"`{text_col}`")).alias("spans"))
    text = F.col(f"row.`{text_col}`")

    def gaps(ends: Column, spans: Column) -> Column:
        """What lies before, between and after the runs; between two of them only where there is something."""
        gap = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
        inner = F.transform(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.when(i > 0, gap(F.get(ends, i - 1), F.get(spans, i)["start"])))
        return F.concat(F.array(gap(F.lit(0), F.get(spans, F.lit(0))["start"])), F.filter(inner, lambda g: g["end"] > g["start"]), F.array(gap(last(ends), F.length(text))))

    kept = let(running_max(F.transform("spans", lambda s: s["end"])), lambda ends: gaps(ends, F.col("spans")))
    clean = F.when(F.size("spans") > 0, F.array_join(cut_spans(text, kept), mark)).otherwise(text)
    out = rows.select("row", F.size("spans").alias("n"), clean.alias("clean"))
    named = {text_col: F.col("clean")}
    if chars_col in docs.columns:
        named[chars_col] = F.when(F.col("n") > 0, F.length("clean").cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"row.`{chars_col}`"))
    return out.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
