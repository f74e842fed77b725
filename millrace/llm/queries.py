"""The registered queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, jpeg, licences, line_dedup, packing, quality, secrets, simhash, token_files, warc
from millrace.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = token_files.round_trip(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jpeg.media_features(jpeg.to_media(table(spark, sf_dir, "documents")))
    return done.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_line_dedup": op2_line_dedup,
        "op3_warc": op3_warc,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality": op5_quality,
        "op6_secrets": op6_secrets,
        "op7_packing": op7_packing,
        "op8_licences": op8_licences,
        "op9_token_files": op9_token_files,
        "op10_media": op10_media,
    }


ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, count(r.key) FILTER (WHERE k.doc_id <> r.first_doc) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL OR k.doc_id = r.first_doc), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""

ORACLES["op3_warc"] = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id FROM pages)
"""

ORACLES["op8_licences"] = licences.oracle()

ORACLES["op5_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
l AS (SELECT *, regexp_replace(lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') AS k,
  regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT r, host, text, unnest(string_split(t, chr(10))) AS line FROM d)),
lim AS (SELECT host, greatest({quality.MAX_LINE_DOCS}, floor(count(DISTINCT text) * {quality.MAX_LINE_SHARE})) AS most FROM d WHERE length(text) >= {quality.MIN_LINE} GROUP BY host),
bad AS (SELECT host, k FROM l JOIN lim USING (host) WHERE length(k) >= {quality.MIN_LINE} AND length(text) >= {quality.MIN_LINE} GROUP BY host, k, most HAVING count(DISTINCT text) > most),
s AS (SELECT r, count(bad.k) AS gone, coalesce(sum(len(ws)) FILTER (WHERE bad.k IS NULL), 0) AS words,
  coalesce(sum(length(array_to_string(ws, ''))) FILTER (WHERE bad.k IS NULL), 0) AS chars,
  count(*) FILTER (WHERE len(ws) > 0) - count(DISTINCT line) FILTER (WHERE len(ws) > 0) AS dup FROM l LEFT JOIN bad ON l.host = bad.host AND l.k = bad.k GROUP BY r),
b AS (SELECT d.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, gone, words, chars FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND (words < {quality.MIN_KEPT_WORDS} OR chars < {quality.MIN_KEPT_SHARE} * word_chars)) AS kept FROM f
"""

_HITS = """list_transform(generate_series(1, len(h)), lambda i: {{'start': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0),
'end': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i], lambda x: length(x))), 0), 'hit': h[i], 'kind': {0}, 'value': v[i]}})"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, value: int) -> str:
    """Spans of a pattern's matches by the lengths of what is between them."""
    q = _quoted(pattern)
    parts = f"SELECT r, string_split_regex(t, {q}) AS p, regexp_extract_all(t, {q}) AS h, regexp_extract_all(t, {q}, {value}) AS v FROM d"
    return f"SELECT r, unnest({_HITS.format(kind)}) AS s FROM ({parts}) WHERE len(h) > 0"


def _secrets_oracle() -> str:
    peak = "list_max(list_transform(generate_series(1, length(c) - {0} + 1), lambda i: list_aggregate(string_split(substr(c, i, {0}), ''), 'entropy')))".format(secrets.WINDOW)
    run = "len(list_filter(generate_series(1, length(c) - {0} + 1), lambda i: substr(c, i, {0}) = repeat(substr(c, i, 1), {0}))) > 0".format(secrets.RUN)
    forms = [p for p in secrets.ALLOWED if "\\1" not in p]
    allowed = " OR ".join([*(f"regexp_matches(c, {_quoted(p)})" for p in forms), run])
    mixed = " AND ".join(f"regexp_matches(c, {_quoted(p)})" for p in secrets.MIXED)
    (_, hexa, _, hex_bits), (_, _, _, bits) = secrets.CLASSES
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    shown = f"string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans(0, secrets.ASSIGN, 2)} UNION ALL {_spans(1, secrets.ACCESS, 0)} UNION ALL {_spans(2, secrets.HEX, 0)}),
base AS (SELECT r, s.start AS s, s.end AS e, s.kind AS kind FROM found
  WHERE (s.kind = 0 AND length(s.value) >= {secrets.LEAST_VALUE}) OR (s.kind = 1 AND length(s.hit) >= {secrets.LEAST_ACCESS}) OR (s.kind = 2 AND length(s.hit) >= {secrets.LEAST_HEX})),
cand AS (SELECT r, s.start AS s, s.end AS e, s.hit AS hit FROM ({_spans(3, secrets.CANDIDATE, 0)})),
fresh AS (SELECT r, s, e, 3 AS kind FROM (SELECT *, CASE WHEN regexp_matches(hit, {_quoted(hexa)}) THEN lower(hit) ELSE hit END AS low, hit AS c FROM cand) x
  WHERE {mixed} AND NOT ({allowed}) AND CASE WHEN regexp_matches(hit, {_quoted(hexa)}) THEN {peak.replace("(c", "(low")} >= {hex_bits} ELSE {peak} >= {bits} END
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s <= x.s AND x.e <= b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM fresh)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  count(*) FILTER (WHERE kind = 3) AS n_entropy, sha256(coalesce({shown} FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce({shown}, '') AS spans
FROM d LEFT JOIN every USING (r) GROUP BY d.r, doc_id
"""


ORACLES["op6_secrets"] = _secrets_oracle()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
