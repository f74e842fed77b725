"""Scalar functions of the key/value half: tokens, numbers as text, escapes, hashes (P2, P3, P5, F-*, A1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word boundary that knows ASCII words only, in Java's syntax.
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
WORD = ASCII_BOUNDARY + r"[\p{L}\p{N}']+" + ASCII_BOUNDARY

# Fixed value: the characters with the White_Space property of Unicode, in a syntax that Java and RE2 read alike.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Fixed values of 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def word_tokens(line: Column) -> Column:
    """Words of the lower-cased line, in order."""
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), 0)


def fields(line: Column) -> Column:
    """The lower-cased line's parts between Unicode white space."""
    return F.filter(F.split(F.lower(line), f"{SPACE}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """S3 within a value: split at LF, one trailing CR stripped; what follows a final LF is no line."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))


def atoi(text: Column) -> Column:
    """F-atoi: a whole number of digits with an optional sign, else null; no spaces."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def itoa(number: Column) -> Column:
    return number.cast("string")


def escape(text: Column) -> Column:
    """F-escape: backslash, tab, LF and CR as two characters each."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def is_escaped(text: Column) -> Column:
    """Whether no unknown escape and no trailing backslash is in the text."""
    return ~F.contains(F.regexp_replace(text, r"\\[\\tnr]", ""), F.lit("\\"))


def unescape(text: Column) -> Column:
    """F-unescape: double backslashes cut the text, so a part's escapes are those of tab, LF and CR alone."""

    def part(p: Column) -> Column:
        for shown, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            p = F.replace(p, F.lit(shown), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def unescape_strict(text: Column) -> Column:
    """``unescape`` that raises on what no writer makes."""
    return F.when(is_escaped(text), unescape(text)).otherwise(F.raise_error(F.concat(F.lit("record: bad escape in "), text)))


def fnv1a32(text: Column) -> Column:
    """F-fnv: the hash of the UTF-8 bytes, as a long."""
    one_a_byte = F.split(F.decode(text.cast("binary"), "ISO-8859-1"), "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c)) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text == "", F.lit(FNV_OFFSET)).otherwise(F.aggregate(one_a_byte, F.lit(FNV_OFFSET).cast("bigint"), step))


def partition_id(key: Column, partitions: int) -> Column:
    """A1: FNV-1a modulo the number of partitions; 0 for one or fewer."""
    return (fnv1a32(key) % partitions).cast("int") if partitions > 1 else F.lit(0)


def thousands(number: Column) -> Column:
    """F-thousands: 1,234."""
    return F.format_number(number, 0)


def record_size(key: Column, value: Column) -> Column:
    """Bytes of a record: both texts and two separators."""
    return (F.octet_length(key) + F.octet_length(value) + 2).cast("bigint")
