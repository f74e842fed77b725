"""The registered queries of the engine's own operators, with their SQL for DuckDB.

Numbers that come of floating-point sums are rounded to 4 decimals and given as whole ten-thousandths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import jobs, stats
from millrace.plans import fixtures, scoring
from millrace.plans import graph as g
from millrace.session import spread, table, work_path
from millrace.sources import kvtext, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def e4(value: Column) -> Column:
    return F.floor(value * 10000 + 0.5).cast("bigint")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text").where(F.col("text").isNotNull()))
    return docs.select("doc_id", "source", F.explode(text.lines(F.col("text"))).alias("value"))


WORDS = r"unnest(regexp_extract_all(lower(text), '\b[\p{L}\p{N}'']+\b'))"


@registered(f"SELECT w AS word, count(*) AS n FROM (SELECT {WORDS} AS w FROM documents) GROUP BY w")
def wordcount(spark, sf_dir):
    """The declarative job over documents."""
    pairs = jobs.map_columns(document_lines(spark, sf_dir), text.word_tokens(F.col("value")))
    return jobs.reduce_columns(pairs, jobs.sum_values(F.col("value"))).select(F.col("key").alias("word"), F.col("value").cast("bigint").alias("n"))


SPACED = "replace(text, ' a', CASE doc_id % 3 WHEN 0 THEN chr(160) || 'a' WHEN 1 THEN chr(8195) || chr(12288) || 'a' ELSE chr(133) || 'a' END)"


@registered(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower({SPACED}), '{text.SPACE}+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def wordcount_fields(spark, sf_dir):
    """P3, with white space beyond ASCII in the texts."""
    rest = F.col("doc_id") % 3
    spaced = F.replace(F.col("value"), F.lit(" a"), F.concat(F.when(rest == 0, "\u00a0").when(rest == 1, "\u2003\u3000").otherwise("\u0085"), F.lit("a")))
    pairs = jobs.map_columns(document_lines(spark, sf_dir), text.fields(spaced))
    return pairs.groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n"))


def _words_of(path: str, line: str) -> list[tuple[str, str]]:
    import regex

    return [(w, "1") for w in regex.findall(r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))[\p{L}\p{N}']+(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", line.lower())]


@registered(ORACLES["wordcount"])
def wordcount_udf(spark, sf_dir):
    """The same job by Python functions, with a combiner."""
    lines = document_lines(spark, sf_dir).select(F.col("source").alias("path"), "value")
    combined = jobs.combine_python(jobs.map_python(lines, _words_of), lambda k, v: [str(sum(map(int, v)))])
    out = jobs.reduce_python(combined, lambda k, v: [str(sum(map(int, v)))])
    return out.select(F.col("key").alias("word"), F.col("value").cast("bigint").alias("n"))


@registered(f"SELECT source, w AS word, count(*) AS n FROM (SELECT source, {WORDS} AS w FROM documents) GROUP BY source, w")
def wordcount_by_source(spark, sf_dir):
    words = document_lines(spark, sf_dir).select("source", F.explode(text.word_tokens(F.col("value"))).alias("word"))
    return words.groupBy("source", "word").agg(F.count("*").alias("n"))


@registered("""SELECT event_type, sum(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(v AS BIGINT) ELSE 0 END)::BIGINT AS total,
count(*) FILTER (WHERE NOT regexp_full_match(v, '[+-]?[0-9]+')) AS skipped
FROM (SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'x' || event_id WHEN 1 THEN ' ' || event_id WHEN 2 THEN '-' || event_id WHEN 3 THEN '+' || event_id ELSE event_id::VARCHAR END AS v FROM events) GROUP BY event_type""")
def numeric_sum_skip_bad(spark, sf_dir):
    """P5 A5: values that are no numbers are left out."""
    n, kind = F.col("event_id").cast("string"), F.col("event_id") % 5
    v = F.when(kind == 0, F.concat(F.lit("x"), n)).when(kind == 1, F.concat(F.lit(" "), n)).when(kind == 2, F.concat(F.lit("-"), n)).when(kind == 3, F.concat(F.lit("+"), n)).otherwise(n)
    pairs = table(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return pairs.groupBy("event_type").agg(jobs.sum_values(F.col("v")).alias("total"), F.count_if(text.atoi(F.col("v")).isNull()).alias("skipped"))


FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(generate_series(1, strlen({0})), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT)),
lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
DISTINCT_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents"


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()


@registered(f"SELECT word, {FNV.format('word')} AS hash, ({FNV.format('word')} % 8)::INT AS part FROM ({DISTINCT_WORDS})")
def partition_ids(spark, sf_dir):
    """A1 F-fnv."""
    return _distinct_words(spark, sf_dir).select("word", text.fnv1a32(F.col("word")).alias("hash"), text.partition_id(F.col("word"), 8).alias("part"))


@registered(f"SELECT part, count(*) AS keys, 0 AS misplaced FROM (SELECT {FNV.format('word')} % 8 AS part FROM ({DISTINCT_WORDS})) GROUP BY part")
def partition_ownership(spark, sf_dir):
    """Keys dealt to their partitions; none is in two."""
    dealt = _distinct_words(spark, sf_dir).withColumn("p", text.partition_id(F.col("word"), 8)).repartitionById(8, F.col("p"))
    placed = dealt.select(F.col("word").alias("key"), F.spark_partition_id().alias("at"), F.col("p").cast("bigint").alias("part"))
    return placed.groupBy("part").agg(F.count("*").alias("keys"), F.count_if(F.col("at") != F.col("part")).cast("int").alias("misplaced"))


@registered(f"""SELECT part, word, row_number() OVER (PARTITION BY part ORDER BY word) AS place
FROM (SELECT word, {FNV.format('word')} % 8 AS part FROM ({DISTINCT_WORDS}))""")
def sorted_runs(spark, sf_dir):
    """Every partition in byte order of its keys."""
    words = _distinct_words(spark, sf_dir).withColumn("part", text.partition_id(F.col("word"), 8).cast("bigint"))
    return stats.numbered(words, "word", by="part").select("part", "word", (F.col("place") + 1).alias("place"))


@registered("""SELECT o_orderstatus AS key, s AS source, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM
(SELECT *, 0 AS s FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT *, 2 FROM orders WHERE o_orderkey % 3 <= 1) GROUP BY ALL""")
def kway_merge(spark, sf_dir):
    """Sorted sources into one, duplicates kept."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("value"))
    rest = F.col("value") % 3
    merged = stats.kway_merge([orders.where(rest == 0), orders.where(rest == 1), orders.where(rest <= 1)])
    return merged.groupBy("key", "source").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


ESCAPED = "replace(replace(replace(replace(t, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


@registered(f"""SELECT doc_id, {ESCAPED} AS escaped, true AS same, strlen(source) + strlen(t) + 2 AS size
FROM (SELECT doc_id, source, text || CASE doc_id % 4 WHEN 0 THEN '\\n' || chr(9) WHEN 1 THEN chr(13) || '\\' WHEN 2 THEN '\\\\t' ELSE '' END AS t FROM documents)""")
def escape_roundtrip(spark, sf_dir):
    """F-escape F-unescape S4 S5: a record line and what is read from it."""
    odd = F.when(F.col("doc_id") % 4 == 0, "\\n\t").when(F.col("doc_id") % 4 == 1, "\r\\").when(F.col("doc_id") % 4 == 2, "\\\\t").otherwise("")
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("text", odd).alias("t"))
    line = kvtext.record_line(F.col("source"), F.col("t"))
    key, value = kvtext.parse_records(F.col("line"))
    out = own.withColumn("line", line).withColumn("escaped", text.escape(F.col("t")))
    return out.select("doc_id", "escaped", ((key == F.col("source")) & (value == F.col("t"))).alias("same"), text.record_size(F.col("source"), F.col("t")).alias("size"))


@registered("SELECT user_id::VARCHAR AS key, event_type AS value FROM events GROUP BY ALL")
def reduce_multi_emit(spark, sf_dir):
    """A4: several outputs a key, by a Python reducer over sorted runs."""
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))

    def distinct(key, values):
        before = None
        for v in values:  # sorted
            if v != before:
                yield v
            before = v

    return jobs.reduce_python(pairs, distinct)


@registered(f"""WITH w AS (SELECT {WORDS} AS w FROM documents), l AS (SELECT unnest(string_split(text, chr(10))) AS l, doc_id FROM documents)
SELECT 'map.input_records' AS name, count(*) - (SELECT count(*) FROM documents WHERE text LIKE '%' || chr(10) OR text = '') AS value FROM l
UNION ALL SELECT 'map.emitted', count(*) FROM w UNION ALL SELECT 'reduce.keys', count(DISTINCT w) FROM w
UNION ALL SELECT 'reduce.values', count(*) FROM w UNION ALL SELECT 'reduce.emitted', count(DISTINCT w) FROM w""")
def job_counters(spark, sf_dir):
    """A job's counters; values count before combining."""
    words = document_lines(spark, sf_dir).select(text.word_tokens(F.col("value")).alias("w"))
    lines = words.agg(F.count("*").alias("map.input_records"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("map.emitted"))
    keys = words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    keys = keys.agg(F.count("*").alias("reduce.keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("reduce.values"), F.count("*").alias("reduce.emitted"))

    def listed(row: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in row.columns]
        return row.select(F.explode(F.array(*pairs)).alias("c")).select("c.name", "c.value")

    return listed(lines).unionByName(listed(keys))


@registered("SELECT url AS file, (row_number() OVER (ORDER BY page_id) - 1) % 7 AS task FROM pages")
def split_files(spark, sf_dir):
    """Inputs dealt round to tasks."""
    pages = stats.numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return pages.select(F.col("url").alias("file"), (F.col("place") % 7).alias("task"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = document_lines(spark, sf_dir).select("doc_id", F.explode(text.word_tokens(F.col("value"))).alias("key"))
    count = lambda df: df.groupBy("key").agg(F.count("*").alias("value"))
    return count(words.where("doc_id % 2 = 0")), count(words.where("doc_id % 2 = 1"))


HALVES = f"w AS (SELECT doc_id, {WORDS} AS key FROM documents), a AS (SELECT key, count(*) AS value FROM w WHERE doc_id % 2 = 0 GROUP BY key), e AS (SELECT key, count(*) AS value FROM w WHERE doc_id % 2 = 1 GROUP BY key)"


@registered(f"""WITH {HALVES} SELECT key, a.value AS actual, e.value AS expected, CASE WHEN a.value IS NULL THEN 'missing' WHEN e.value IS NULL THEN 'extra' ELSE 'mismatch' END AS status
FROM a FULL JOIN e USING (key) WHERE a.value IS DISTINCT FROM e.value""")
def verify_diff(spark, sf_dir):
    """What one word count lacks, has over, and has differently."""
    return kvtext.compare(*_halves(spark, sf_dir))


@registered(f"WITH {HALVES} SELECT 'missing' AS kind, count(*) AS n FROM (SELECT key FROM e EXCEPT SELECT key FROM a) UNION ALL SELECT 'extra', count(*) FROM (SELECT key FROM a EXCEPT SELECT key FROM e) UNION ALL SELECT 'common', count(*) FROM (SELECT key FROM a INTERSECT SELECT key FROM e)")
def key_sets(spark, sf_dir):
    """U2 U3."""
    return kvtext.key_sets(*_halves(spark, sf_dir))


@registered("SELECT event_type, count(value) AS n, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events GROUP BY event_type")
def upper_median(spark, sf_dir):
    """A10."""
    return stats.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


TASKS = "SELECT event_type AS kind, event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'running' ELSE 'done' END AS state, value AS elapsed_ms FROM events"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 4 == 0, "running").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), state.alias("state"), F.col("value").alias("elapsed_ms"))


@registered(f"""WITH t AS ({TASKS}), m AS (SELECT kind, list_sort(list(elapsed_ms))[count(*) // 2 + 1] AS median FROM t WHERE state = 'done' GROUP BY kind HAVING count(*) >= 2)
SELECT kind, id, elapsed_ms, median FROM t JOIN m USING (kind) WHERE state = 'running' AND elapsed_ms > 1.5 * median""")
def straggler_candidates(spark, sf_dir):
    """F4 O10 A10."""
    return stats.stragglers(_tasks(spark, sf_dir))


@registered(f"WITH t AS ({TASKS}) SELECT kind, count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'running') AS running FROM t GROUP BY kind")
def task_status(spark, sf_dir):
    """A17."""
    return stats.task_status(_tasks(spark, sf_dir))


@registered("""SELECT user_id AS worker, ts, gap_us FROM (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap_us FROM events) WHERE gap_us > 86400000000""")
def worker_silences(spark, sf_dir):
    """gaps between signs of life over a day."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts")
    return stats.silences(beats, 86400.0).select("worker", "ts", F.round(F.col("gap_s") * 1e6).cast("bigint").alias("gap_us"))


@registered("""SELECT user_id AS worker, max(ts) AS last FROM events GROUP BY user_id HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 86400000000""")
def lost_workers(spark, sf_dir):
    """workers silent for over a day at the end of the log."""
    return stats.lost_workers(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts"), 86400.0).select("worker", "last")


@registered("""SELECT event_type, count(value) AS n, list_sort(list(value))[floor(0.5 * (count(value) - 1))::INT + 1] AS p50,
list_sort(list(value))[floor(0.95 * (count(value) - 1))::INT + 1] AS p95, list_sort(list(value))[floor(0.99 * (count(value) - 1))::INT + 1] AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """A11."""
    return stats.floor_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@registered("SELECT floor(avg(l_extendedprice) * 10000 + 0.5)::BIGINT AS mean_e4, floor(1000.0 * sum(l_linenumber) / sum(l_extendedprice) * 10000 + 0.5)::BIGINT AS per_second_e4 FROM lineitem")
def throughput(spark, sf_dir):
    """A13."""
    out = stats.latency(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber")
    return out.select(e4(F.col("mean_ms")).alias("mean_e4"), e4(F.col("per_second")).alias("per_second_e4"))


@registered("""SELECT l_shipmode_ AS node, l_returnflag AS op, count(*) AS calls, sum(ms)::BIGINT AS total_ms,
floor(1000 * sum(ms) / count(*) * 10000 + 0.5)::BIGINT AS us_e4, floor(sum(ms) / sum(sum(ms)) OVER () * 10000 + 0.5)::BIGINT AS share_e4
FROM (SELECT l_linestatus AS l_shipmode_, l_returnflag, floor(l_extendedprice) AS ms FROM lineitem) GROUP BY ALL""")
def node_profile(spark, sf_dir):
    """A14 O6, of lines as a log: whole numbers, so that sums don't depend on the order."""
    log = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.floor("l_extendedprice").cast("double").alias("ms"))
    out = stats.node_profile(log, "l_linestatus", "l_returnflag", "ms")
    return out.select("node", "op", "calls", F.col("total_ms").cast("bigint").alias("total_ms"), e4(F.col("us_per_call")).alias("us_e4"), e4(F.col("share")).alias("share_e4"))


@registered("SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 32)::BIGINT AS batch FROM embeddings")
def fixed_batches(spark, sf_dir):
    """B1."""
    return stats.fixed_batches(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 32).select("vec_id", "batch")


@registered("""WITH b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings), s AS (SELECT batch, count(*) AS size FROM b GROUP BY batch)
SELECT sum(size)::BIGINT AS requests, count(*) AS batches, max(size) AS max_batch, floor(sum(size) / count(*) * 10000 + 0.5)::BIGINT AS avg_e4 FROM s""")
def batcher_stats(spark, sf_dir):
    """A15."""
    sizes = fixed_batches(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("size"), F.lit(0.0).alias("elapsed_ms"))
    return stats.batcher_stats(sizes).select("requests", "batches", "max_batch", e4(F.col("avg_batch")).alias("avg_e4"))


@registered("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error' OR value < 1) AS errors FROM events")
def server_stats(spark, sf_dir):
    """A16."""
    status = F.when((F.col("event_type") == "error") | (F.col("value") < 1), 400).otherwise(200)
    return stats.server_stats(table(spark, sf_dir, "events").select(status.alias("status")))


@registered("""WITH RECURSIVE r AS (SELECT user_id AS queue, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT queue, event_id, k, 0 AS batch, t AS first, 1 AS n FROM r WHERE k = 1
UNION ALL SELECT r.queue, r.event_id, r.k, CASE WHEN b.n >= 8 OR r.t > b.first + 3600000000 THEN b.batch + 1 ELSE b.batch END,
CASE WHEN b.n >= 8 OR r.t > b.first + 3600000000 THEN r.t ELSE b.first END, CASE WHEN b.n >= 8 OR r.t > b.first + 3600000000 THEN 1 ELSE b.n + 1 END
FROM b JOIN r ON r.queue = b.queue AND r.k = b.k + 1)
SELECT queue::VARCHAR AS queue, event_id AS request_id, batch::BIGINT AS batch, count(*) OVER (PARTITION BY queue, batch) AS size FROM b""")
def dynamic_batches(spark, sf_dir):
    """Arrivals of each queue in batches of up to 8 within an hour."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrived_us"), "user_id")
    return stats.dynamic_batches(log, 8, 3_600_000_000, "user_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


E4 = "list_transform({0}, lambda v: floor(v * 10000 + 0.5)::BIGINT)"
X = "list_transform(embedding, lambda v: v::DOUBLE)"


def e4s(x: Column) -> Column:
    return F.transform(x, e4)


@registered(f"SELECT vec_id AS sample_id, {E4.format('list_transform(list_transform(embedding, lambda v: abs(floor(v::DOUBLE * 100))::BIGINT % 256), lambda p: p / 255)')} AS x FROM embeddings")
def normalize(spark, sf_dir):
    """P7 F-div255."""
    pixels = F.transform("x", lambda v: F.abs(F.floor(v * 100)) % 256)
    return _vectors(spark, sf_dir).select("sample_id", e4s(arrays.normalise(pixels)).alias("x"))


ODD_INPUT = "CASE vec_id % 5 WHEN 0 THEN list_append({0}, 'nan'::DOUBLE) WHEN 1 THEN list_append({0}, 1000000.5) WHEN 2 THEN list_append({0}, -1000000.0) WHEN 3 THEN [] ELSE {0} END"


@registered(f"""SELECT vec_id AS sample_id, len(x) = len(embedding) AS sized,
len(list_filter(x, lambda v: isnan(v) OR v < -1000000 OR v > 1000000)) = 0 AS finite FROM (SELECT vec_id, embedding, {ODD_INPUT.format(X)} AS x FROM embeddings)""")
def valid_input(spark, sf_dir):
    """P8 P9 P10."""
    odd = lambda v: F.concat("x", F.array(F.lit(v)))
    rest = F.col("sample_id") % 5
    x = F.when(rest == 0, odd(float("nan"))).when(rest == 1, odd(1000000.5)).when(rest == 2, odd(-1000000.0)).when(rest == 3, F.array().cast("array<double>")).otherwise(F.col("x"))
    own = _vectors(spark, sf_dir).select("sample_id", F.size("x").alias("n"), x.alias("x"))
    return own.select("sample_id", (F.size("x") == F.col("n")).alias("sized"), arrays.all_finite(F.col("x")).alias("finite"))


@registered(f"SELECT vec_id AS sample_id, [8, len(embedding) // 8] AS shape, floor(embedding[8 + 3]::DOUBLE * 10000 + 0.5)::BIGINT AS cell, floor(list_sum({X}) * 10000 + 0.5)::BIGINT AS total FROM embeddings")
def flatten_shape(spark, sf_dir):
    """Eight rows made of a flat vector, and flat again."""
    own = _vectors(spark, sf_dir)
    width = own.select(F.size("x").alias("n")).first()["n"] // 8
    tensor = F.struct(F.array(F.lit(8 * width).cast("bigint")).alias("shape"), F.col("x").alias("data"))
    own = own.select("sample_id", "x", arrays.reshape(tensor, [8, width]).alias("t"))
    flat = arrays.flatten_shape([1, 8, width])
    cell = arrays.at(F.col("t"), [10 // width, 10 % width])
    total = F.aggregate(F.slice("t.data", 1, flat[1]), F.lit(0.0), lambda a, v: a + v)
    return own.select("sample_id", F.transform("t.shape", lambda s: s.cast("bigint")).alias("shape"), e4(cell).alias("cell"), e4(total).alias("total"))


#: Weights of four outputs over any number of features, whole hundredths so that both engines have the same.
GEMM_W = lambda j, k: (((j * 7 + k * 3) % 13) - 6) / 8
SQL_GEMM = "list_transform(generate_series(0, 3), lambda j: list_sum(list_transform(generate_series(1, len(embedding)), lambda k: embedding[k]::DOUBLE * (((j * 7 + (k - 1) * 3) % 13) - 6) / 8)) * 0.5 + j * 0.25 * 2)"


def _gemm_args(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[list[float]], list[float]]:
    own = _vectors(spark, sf_dir)
    n = own.select(F.size("x").alias("n")).first()["n"]
    return own, [[GEMM_W(j, k) for k in range(n)] for j in range(4)], [0.25 * j for j in range(4)]


@registered(f"SELECT vec_id AS sample_id, {E4.format(SQL_GEMM)} AS y FROM embeddings")
def gemm_native(spark, sf_dir):
    """T2 T8 T9."""
    own, w, b = _gemm_args(spark, sf_dir)
    return own.select("sample_id", e4s(arrays.gemm(F.col("x"), w, b, 0.5, 2.0)).alias("y"))


@registered(f"SELECT vec_id AS sample_id, unnest(generate_series(0, 3))::INT AS j, unnest({E4.format(SQL_GEMM)}) AS y FROM embeddings")
def gemm_relational(spark, sf_dir):
    """J3 J4."""
    own, w, b = _gemm_args(spark, sf_dir)
    cells = own.select(F.col("sample_id").alias("i"), F.posexplode("x").alias("j", "v"))
    weights = spark.createDataFrame([(j, k, v) for j, row in enumerate(w) for k, v in enumerate(row)], "i int, j int, v double")
    bias = spark.createDataFrame(list(enumerate(b)), "j int, b double")
    out = scoring.with_bias(scoring.gemm_relational(cells, weights, trans_b=True, alpha=0.5, broadcast_b=True), F.broadcast(bias), 2.0)
    return out.select(F.col("i").alias("sample_id"), "j", e4(F.col("v")).alias("y"))


@registered(f"SELECT vec_id AS sample_id, list_transform({SQL_GEMM}, lambda v: floor(v * 100 + 0.5)::BIGINT) AS y FROM embeddings")
def gemm_arrow(spark, sf_dir):
    """T2 by Arrow batches and numpy, in 64 bits as the SQL."""
    import numpy as np

    own, w, b = _gemm_args(spark, sf_dir)
    node = g.Node("fc", "Gemm", ["x", "w", "b"], ["y"], {"transB": 1, "alpha": 0.5, "beta": 2.0})
    model = g.Model(g.Graph([node], ["x"], ["y"]), {"w": np.array(w, np.float32), "b": np.array(b, np.float32)})
    out = scoring.score(own, model, strategy="vectorised")
    return out.select(F.col("id").alias("sample_id"), F.transform("logits", lambda v: F.floor(v * 100 + 0.5).cast("bigint")).alias("y"))


@registered(f"SELECT vec_id AS sample_id, {E4.format(f'list_transform({X}, lambda v: greatest(v, 0))')} AS y FROM embeddings")
def relu(spark, sf_dir):
    """T3 F-max0."""
    return _vectors(spark, sf_dir).select("sample_id", e4s(arrays.relu(F.col("x"))).alias("y"))


@registered(f"""SELECT a.vec_id AS sample_id, {E4.format('list_transform(generate_series(1, len(a.embedding)), lambda i: a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE)')} AS y
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def add(spark, sf_dir):
    """Each vector and the next one."""
    a = _vectors(spark, sf_dir).select("sample_id", "x")
    b = a.select((F.col("sample_id") - 1).alias("sample_id"), F.col("x").alias("z"))
    return a.join(b, "sample_id").select("sample_id", e4s(arrays.add(F.col("x"), F.col("z"))).alias("y"))


@registered(f"SELECT vec_id AS sample_id, {E4.format(f'list_transform({SQL_GEMM}, lambda v: greatest(v, 0))')} AS y FROM embeddings")
def gemm_relu(spark, sf_dir):
    """T5."""
    own, w, b = _gemm_args(spark, sf_dir)
    return own.select("sample_id", e4s(arrays.gemm(F.col("x"), w, b, 0.5, 2.0, fuse_relu=True)).alias("y"))


def _dense(x: str, out: int, weight: str, bias: str, n: str) -> str:
    return f"list_transform(generate_series(0, {out - 1}), lambda j: list_sum(list_transform(generate_series(1, {n}), lambda k: {x}[k] * ({weight})::FLOAT::DOUBLE)) + ({bias})::FLOAT::DOUBLE)"


BRANCHING = f"""WITH h AS (SELECT vec_id, label, list_transform({_dense('embedding', 4, '0.1::DOUBLE * ((j * len(embedding) + k - 1) % 7) - 0.2::DOUBLE', '[0.1, -0.2, 0.3, 0.0][j + 1]', 'len(embedding)')}, lambda v: greatest(v, 0)) AS a FROM embeddings),
l AS (SELECT vec_id, label, {_dense('a', 3, '0.05::DOUBLE * (j * 4 + k - 1) - 0.1::DOUBLE', '[0.0, 0.5, -0.5][j + 1]', '4')} AS l, {_dense('a', 3, '-0.03::DOUBLE * (j * 4 + k - 1) + 0.2::DOUBLE', '[1.0, 0.0, 0.25][j + 1]', '4')} AS r FROM h),
z AS (SELECT vec_id, label, list_transform(generate_series(1, 3), lambda i: l[i] + r[i]) AS z FROM l)"""


def _branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    model = fixtures.branching(own.select(F.size("x").alias("n")).first()["n"])
    return scoring.score(own, model, strategy="native")


@registered(f"{BRANCHING} SELECT vec_id AS sample_id, list_transform(z, lambda v: floor(v * 1000 + 0.5)::BIGINT) AS logits FROM z")
def branching_model(spark, sf_dir):
    """E7 T1-T5 with the graph rewritten first; three decimals."""
    return _branching(spark, sf_dir).select(F.col("id").alias("sample_id"), F.transform("logits", lambda v: F.floor(v * 1000 + 0.5).cast("bigint")).alias("logits"))


@registered(f"{BRANCHING} SELECT vec_id AS sample_id, (list_position(z, list_max(z)) - 1)::INT AS prediction FROM z")
def argmax(spark, sf_dir):
    """O5."""
    return _branching(spark, sf_dir).select(F.col("id").alias("sample_id"), "prediction")


@registered(f"""{BRANCHING}, p AS (SELECT label % 3 AS label, list_position(z, list_max(z)) - 1 AS prediction FROM z)
SELECT count(*) AS samples, count(*) FILTER (WHERE label = prediction) AS correct, floor(100.0 * count(*) FILTER (WHERE label = prediction) / count(*) * 10000 + 0.5)::BIGINT AS accuracy_e4 FROM p""")
def accuracy(spark, sf_dir):
    """A12 J7."""
    labels = _vectors(spark, sf_dir).select(F.col("sample_id").alias("id"), (F.col("label") % 3).alias("label"))
    out = scoring.accuracy(_branching(spark, sf_dir), labels)
    return out.select("samples", "correct", e4(F.col("accuracy")).alias("accuracy_e4"))


@registered("SELECT vec_id AS sample_id, label FROM embeddings WHERE vec_id < 200")
def prefix_sample(spark, sf_dir):
    """O9."""
    return stats.prefix_sample(_vectors(spark, sf_dir), 200).select("sample_id", "label")


NODES = "(VALUES " + ", ".join(f"('{n.name}', '{n.op}', {n.inputs}, {n.outputs})" for n in fixtures.DIGITS.nodes) + ") AS nodes(name, op, inputs, outputs)"
EDGES = f"n AS (SELECT * FROM {NODES}), e AS (SELECT a.name AS parent, b.name AS child FROM (SELECT name, unnest(outputs) AS t FROM n) a JOIN (SELECT DISTINCT name, unnest(inputs) AS t FROM n) b USING (t) WHERE a.name <> b.name)"


@registered(f"WITH {EDGES} SELECT parent, child FROM e")
def graph_edges(spark, sf_dir):
    """J1 J2."""
    return g.edge_table(g.node_table(spark, fixtures.DIGITS))


@registered(f"WITH RECURSIVE {EDGES}, r AS (SELECT name AS node, 0 AS level FROM n WHERE name NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, r.level + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def graph_levels(spark, sf_dir):
    """O7 O8 E8."""
    nodes = g.node_table(spark, fixtures.DIGITS)
    return g.level_table(spark, nodes, g.edge_table(nodes))


@registered(f"WITH RECURSIVE {EDGES}, u AS (SELECT name FROM n WHERE list_contains(outputs, 'logits') UNION SELECT e.parent FROM u JOIN e ON e.child = u.name) SELECT name AS node FROM n WHERE name NOT IN (SELECT name FROM u)")
def dead_nodes(spark, sf_dir):
    """U4."""
    nodes = g.node_table(spark, fixtures.DIGITS)
    return g.dead_table(nodes, g.edge_table(nodes), fixtures.DIGITS.outputs)


@registered(f"""WITH {EDGES} SELECT p.name AS gemm, c.name AS relu FROM e JOIN n p ON p.name = e.parent JOIN n c ON c.name = e.child
WHERE p.op = 'Gemm' AND c.op = 'Relu' AND (SELECT count(*) FROM e x WHERE x.parent = p.name) = 1 AND (SELECT count(*) FROM e x WHERE x.child = c.name) = 1 AND NOT list_contains(p.outputs, 'logits')""")
def fusion_candidates(spark, sf_dir):
    """Section 4's fusion, with its guards."""
    nodes = g.node_table(spark, fixtures.DIGITS)
    return g.fusion_table(nodes, g.edge_table(nodes), fixtures.DIGITS.outputs)


EVENT_PAIRS = "SELECT user_id::VARCHAR AS key, event_type AS value FROM events"


@registered(f"SELECT ({FNV.format('key')} % 5)::INT AS part, count(*) AS records, count(DISTINCT key) AS keys, 0 AS misplaced FROM ({EVENT_PAIRS}) GROUP BY part")
def record_files(spark, sf_dir):
    """Records written to a file for each partition, listed, and read back."""
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))
    folder = work_path(spark, "records")
    kvtext.write_records(pairs, folder, 5)
    files = [f for f in kvtext.list_input_files(spark, folder) if "/part-" in f]
    key, _ = kvtext.parse_records(F.col("value"))
    back = kvtext.read_lines(spark, files).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), key.alias("key"))
    return back.groupBy("part").agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"), F.count_if(text.partition_id(F.col("key"), 5) != F.col("part")).cast("int").alias("misplaced"))


@registered("SELECT doc_id, count(*) FILTER (WHERE x <> '') AS filled, count(*) FILTER (WHERE x = '') AS blank FROM (SELECT doc_id, unnest(string_split(text || chr(10) || chr(10) || 'k', chr(10))) AS x FROM documents) GROUP BY doc_id")
def blank_records(spark, sf_dir):
    """Lines, and those that a record reader passes over."""
    parts = text.lines(F.concat("text", F.lit("\n\nk\n")))
    own = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", parts.alias("x"))
    blank = F.size(F.filter("x", lambda v: v == "")).cast("bigint")
    return own.select("doc_id", (F.size("x") - blank).cast("bigint").alias("filled"), blank.alias("blank"))


@registered("SELECT event_type AS name, format('{:,}', sum(event_id)::BIGINT) AS value FROM events GROUP BY event_type")
def counter_report(spark, sf_dir):
    """S17 F-thousands."""
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("event_id").alias("value"))
    return kvtext.report(sums)


@registered("""WITH q AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: floor(v::DOUBLE * 100) / 4) AS z FROM embeddings)
SELECT vec_id AS sample_id, '{"prediction":' || (list_position(z, list_max(z)) - 1) || ',"logits":[' || array_to_string(list_transform(z, lambda v: printf('%.6f', v)), ',') || ']}' AS body FROM q""")
def response_json(spark, sf_dir):
    """F-jsonfmt O5."""
    quarters = F.transform(F.slice("x", 1, 4), lambda v: F.floor(v * 100).cast("double") / 4)
    own = _vectors(spark, sf_dir).select("sample_id", quarters.alias("z"))
    return own.select("sample_id", scoring.logits_json(F.col("z"), arrays.argmax(F.col("z"))).alias("body"))


@registered(f"""SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 < 2 THEN {E4.format('list_transform(list_transform(embedding, lambda v: abs(floor(v::DOUBLE * 100))::BIGINT % 256), lambda p: p / 255)')} END AS x FROM embeddings""")
def decoded_bodies(spark, sf_dir):
    """Request bodies of bytes, and cut short."""
    own = _vectors(spark, sf_dir).select("sample_id", F.transform("x", lambda v: F.abs(F.floor(v * 100)) % 256).alias("p"))
    n = own.select(F.size("p").alias("n")).first()["n"]
    packed = F.unhex(F.array_join(F.transform("p", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    body = F.when(F.col("sample_id") % 3 < 2, packed).otherwise(F.substring(packed, 1, n - 1))
    return own.select("sample_id", e4s(models.decode_body(body, n)).alias("x"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
