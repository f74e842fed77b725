"""Licence scan by canonical digests, with column expressions alone.

A unit of text is brought to a canonical form: lower case, copyright lines left out, punctuation as spaces,
equivalent spellings as one, white space collapsed. The SHA-256 of the form is joined to the digests of the known
licences: entire texts by a hash join with the known table, which is a fixed list of this package of some kilobytes and so
is broadcast. Entire lines are units too; few can be known, as each known text has one of a few words, and those are
looked up in place. Nothing is shuffled and each text is brought to its form once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.columns import let
from millrace.llm.licence_texts import DIGESTS, TEXTS

# Patterns that Java and RE2 read alike, of a lower-cased line.
#: A line that begins with a copyright sign, or with the word and a year, a sign or a place for one.
SIGNED = r"^[^a-z0-9]*(copyright [0-9<(©]|copyright: |\(c\) |© ?)"
_WORD = r"^[^a-z0-9]*(?:(?:some |other )?(?:portions|parts|modifications|additions|contributions)(?: (?:are|of this software are))?[ \t,:]+)?copyright[ \t:,]+"
#: A line that states a copyright by name.
NAMED = _WORD + r"[^ \t:,\r]"
#: But not what a sentence of a licence may go on with after the word.
SENTENCE = (
    _WORD + r"(?:notices?|holders?|owners?|licen[sc]es?|licen[sc]ed|laws?|statements?|interests?|disclaimers?|treaty|permission|ownership|"
    r"infringement|protection|claims?|rights?|and|or|in|is|to|on|of|as|for|the software|the library|the program)(?:[^a-z0-9]|$)"
)
#: Texts without these hold no copyright line.
SIGNS = ("copyright", "(c)", "©")
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}\x{a0}\x{a9}\x{ab}\x{bb}]+"
#: Equivalent spellings, in the canonical form's words: (spelling, one spelling), replaced in this order.
SPELLINGS = [
    (" all rights reserved ", " "),
    (" sub licence ", " sublicense "),
    (" sub license ", " sublicense "),
    (" licence ", " license "),
    (" licences ", " license "),
    (" licenses ", " license "),
    (" licenced ", " licensed "),
    (" acknowledgement ", " acknowledgment "),
    (" copyright owner ", " copyright holder "),
    (" copyright owners ", " copyright holders "),
    (" non infringement ", " noninfringement "),
    (" merchantibility ", " merchantability "),
    (" noncommercial ", " non commercial "),
    (" https ", " http "),
    (" the mit license ", " mit license "),
    (" v 2 0 ", " version 2 0 "),
]
#: Every known text has one of these within a word, in whatever spelling.
ANCHORS = ("licen", "permission", "redistribution", "domain")
#: A line that names licences of the SPDX list, by their ids, with the operators of its expressions.
SPDX_LINE = r"^[^A-Za-z0-9]*(?i:SPDX-Licen[sc]e-Identifier)[ \t]*:[ \t(]*([A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t()]+(?:AND|OR|WITH)[ \t()]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)[^A-Za-z0-9]*$"
OPERATORS = r"[ \t()]+(?:AND|OR|WITH)[ \t()]+"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out |= text.contains(word)
    return out


def _without_copyright(low: Column) -> Column:
    stated = lambda x: x.rlike(SIGNED) | (x.rlike(NAMED) & ~x.rlike(SENTENCE))
    stay = F.array_join(F.filter(F.split(low, "\n", -1), lambda x: ~stated(x)), "\n")
    return F.when(_any(low, SIGNS), stay).otherwise(low)


def canonical(text: Column) -> Column:
    """The punctuation pattern takes white space too, so words are one space apart after it."""
    form = let(F.lower(text), _without_copyright)
    form = F.concat(F.lit(" "), F.regexp_replace(form, PUNCTUATION, " "), F.lit(" "))
    for spelling, one in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(one))
    return F.trim(form)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """``(licence, text)``, the licences' full texts also without their titles."""
    untitled = [(name, body) for name, text in TEXTS for title, found, body in [text.partition("\n\n")] if found and len(title) < 60]
    return [*TEXTS, *untitled]


def known(spark: SparkSession) -> DataFrame:
    """``(known, licence)``: the digests of the known texts."""

    def listed(pairs: list[tuple[str, str]], value: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(v).alias(value)) for name, v in pairs])
        return spark.range(1).select(F.inline(rows))

    texts = listed(known_texts(), "text").select(digest(F.col("text")).alias("known"), "licence")
    return texts.unionByName(listed(DIGESTS, "known").select("known", "licence")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, canonical_sha256, licence, notices, n_notice_lines)`` for each row of ``docs``.

    ``licence`` is that of the entire text (null if its digest is not known); ``notices`` the licences, comma-joined in order, that
    entire lines name: by a known text, or by an SPDX line, whose ids are taken as they stand. ``n_notice_lines`` says how many lines
    do. A null text counts as empty. Rows are judged by their texts alone: repeated rows and ids and null ids come out as they
    went in; an empty table gives an empty table. Other columns are not read.
    """
    table = known(docs.sparkSession).collect()  # some 40 rows, whatever the data
    names = F.create_map(*[F.lit(x) for row in table for x in (row.known, row.licence)])

    def named(line: Column) -> Column:
        """The licences that a line names; an empty array for none."""
        ids = lambda x: F.when(x != "", F.split(x, OPERATORS, -1)).otherwise(F.array().cast("array<string>"))
        own = F.array_compact(F.array(F.try_element_at(names, digest(line))))
        return F.concat(own, let(F.regexp_extract(line, SPDX_LINE, 1), ids))

    def noticed(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: _any(F.lower(x), ANCHORS))
        return F.filter(F.transform(lines, named), lambda x: F.size(x) > 0)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = F.when(_any(F.lower(text), ANCHORS), noticed(text)).otherwise(F.array().cast("array<array<string>>"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), digest(text).alias("canonical_sha256"), found.alias("found"))
    whole = own.join(F.broadcast(known(docs.sparkSession)), F.col("canonical_sha256") == F.col("known"), "left")
    notices = F.array_join(F.array_sort(F.array_distinct(F.flatten("found"))), ",")
    return whole.select("id", "canonical_sha256", "licence", notices.alias("notices"), F.size("found").cast("bigint").alias("n_notice_lines"))


def oracle() -> str:
    """The scan of ``documents`` as SQL for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    match = lambda p: f"regexp_matches(l, {quote(p)})"
    form = f"array_to_string(list_filter(string_split(lower(x), chr(10)), lambda l: NOT ({match(SIGNED)} OR ({match(NAMED)} AND NOT {match(SENTENCE)}))), chr(10))"
    form = f"' ' || regexp_replace({form}, {quote(PUNCTUATION)}, ' ', 'g') || ' '"
    for spelling, one in SPELLINGS:
        form = f"replace({form}, {quote(spelling)}, {quote(one)})"
    form = f"sha256(trim({form}))"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in known_texts())
    digests = ", ".join(f"({quote(name)}, {quote(known)})" for name, known in DIGESTS)
    return f"""
WITH known AS (SELECT DISTINCT licence, {form} AS known FROM (VALUES {values}) AS v(licence, x) UNION SELECT licence, known FROM (VALUES {digests}) AS v(licence, known)),
lines AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE length(x) > 0),
found AS (SELECT doc_id, i, licence FROM (SELECT doc_id, i, {form} AS known FROM lines) JOIN known USING (known)
  UNION SELECT doc_id, i, unnest(string_split_regex(regexp_extract(x, {quote(SPDX_LINE)}, 1), {quote(OPERATORS)})) FROM lines WHERE regexp_matches(x, {quote(SPDX_LINE)})),
notices AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(DISTINCT i) AS n FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, {form} AS canonical_sha256 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))
SELECT doc_id, canonical_sha256, licence, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines
FROM whole LEFT JOIN known ON canonical_sha256 = known LEFT JOIN notices USING (doc_id)
"""
