"""Text inputs and key/value record files."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from millrace.files import create, open_fs, visible_files
from millrace.functions.text import escape, partition_id, unescape_strict

RECORD = "key string, value string"
#: Bytes of a line, its end included, that a mapper is given at the most.
MAX_LINE = 16 << 20


def list_input_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder, sorted, folders left out; raises if there is none. Any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()).removeprefix("file:") for s in system.listStatus(path) if s.isFile())
    if not found:
        raise ValueError(f"no input files in {folder}")
    return found


def split_files(files: list[str], groups: int) -> list[list[str]]:
    """Dealt round; no group is empty."""
    n = max(1, min(groups, len(files)))
    return [files[k::n] for k in range(n)]


def read_lines(spark: SparkSession, path: str | list[str], max_line: int = MAX_LINE) -> DataFrame:
    """S3: ``(path, value)``, a row for each line, one trailing CR stripped; a line of ``max_line`` bytes or more raises. Spark splits files by itself."""
    raw = spark.read.option("lineSep", "\n").text(path)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    said = F.concat(F.lit(f"a line of {max_line} bytes or more in "), name)
    value = F.when(F.octet_length("value") < max_line, F.regexp_replace("value", r"\r\z", "")).otherwise(F.raise_error(said))
    return raw.select(name.alias("path"), value.alias("value"))


def parse_records(line: Column) -> tuple[Column, Column]:
    """Key and value of a line, split at its first tab; what isn't a record raises."""
    tab = F.instr(line, "\t")
    said = F.concat(F.lit("record: no separator in "), line)
    key = F.when(tab > 0, F.substring(line, F.lit(1), tab - 1)).otherwise(F.raise_error(said))
    return unescape_strict(key), unescape_strict(F.substring(line, tab + 1, F.length(line)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files; blank lines are left out."""
    lines = read_lines(spark, path).where(F.col("value") != "").select("value")
    key, value = parse_records(F.col("value"))
    return lines.select(key.alias("key"), value.alias("value"))


def record_line(key: Column, value: Column) -> Column:
    return F.concat_ws("\t", escape(key), escape(value))


def write_records(records: DataFrame, path: str, partitions: int | None = None, dealt: bool = False) -> DataFrame:
    """Sorted record files; with ``partitions`` a key is in the file of its FNV-1a partition, and each partition has a file.

    ``dealt`` says that the rows are in their partitions, sorted, already. Spark's committer moves whole files into place and replaces
    what was there. Returns what was written.
    """
    out = records
    if partitions and not dealt:
        out = out.withColumn("_p", partition_id(F.col("key"), partitions)).repartitionById(partitions, F.col("_p")).drop("_p")
    if not dealt:
        out = out.sortWithinPartitions("key", "value")
    out.select(record_line(F.col("key"), F.col("value"))).write.mode("overwrite").text(path)
    if partitions:
        _fill(records.sparkSession, path, partitions)
    return out


def _fill(spark: SparkSession, path: str, partitions: int) -> None:
    """An empty file for each partition that had no row."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName()[:10] for s in system.listStatus(folder)}
    for k in range(partitions):
        if f"part-{k:05d}" not in there:
            system.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"part-{k:05d}-empty.txt")).close()


def report(counters: DataFrame) -> DataFrame:
    """Counters by name, with separated thousands."""
    return counters.select("name", F.format_number("value", 0).alias("value")).orderBy("name")


def corpus(spark: SparkSession, vocabulary: list[str], lines: int, words: int, seed: int = 7) -> DataFrame:
    """Lines of words drawn evenly from a vocabulary, a function of the seed alone."""
    pick = lambda k: F.element_at(F.array(*[F.lit(w) for w in vocabulary]), (F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(len(vocabulary))) + 1).cast("int"))
    return spark.range(lines).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), pick), " ").alias("value"))


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """``(key, actual, expected, status)`` of keys that are missing, extra or differ, of ``(key, value)`` tables."""
    a, e = actual.select("key", F.col("value").alias("actual")), expected.select("key", F.col("value").alias("expected"))
    status = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "extra").when(~F.col("actual").eqNullSafe(F.col("expected")), "mismatch")
    both = a.withColumn("in_a", F.lit(True)).join(e.withColumn("in_e", F.lit(True)), "key", "full")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select("key", "actual", "expected", "status")


def key_sets(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """``(kind, n)``: how many distinct keys are missing, extra and common, of ``(key, ...)`` tables."""
    a, e = (df.select("key").distinct().withColumn(side, F.lit(True)) for df, side in ((actual, "in_a"), (expected, "in_e")))
    both = a.join(e, "key", "full")
    counts = both.agg(F.count_if(F.col("in_a").isNull()).alias("missing"), F.count_if(F.col("in_e").isNull()).alias("extra"), F.count_if(F.col("in_a") & F.col("in_e")).alias("common"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in counts.columns])))


def misplaced_keys(records: DataFrame) -> DataFrame:
    """Keys of ``(key, part)`` that are in more than one part."""
    return records.groupBy("key").agg(F.count_distinct("part").alias("parts")).where(F.col("parts") > 1)


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """``file label`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).alias("file"), F.get(parts, 1).cast("int").alias("label"))


class _Files(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


_UNESCAPE = {"\\\\": "\\", "\\t": "\t", "\\n": "\n", "\\r": "\r"}


def unescape_text(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[0] not in _UNESCAPE:
            raise ValueError(f"record: bad escape {m[0]!r}")
        return _UNESCAPE[m[0]]

    return re.sub(r"\\.?", one, text, flags=re.S)


def escape_text(text: str) -> str:
    shown = {v: k for k, v in _UNESCAPE.items()}
    return re.sub(r"[\\\t\n\r]", lambda m: shown[m[0]], text)


class KeyValueText(DataSource):
    """``spark.read.format("kvtext").load(folder or file)`` and ``df.write.format("kvtext")``; option ``splitBytes``.

    For file systems that pyarrow knows; ``read_records`` goes by Spark's own readers.
    """

    @classmethod
    def name(cls) -> str:
        return "kvtext"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        files = visible_files(self.path)
        if not files:
            raise ValueError(f"no input files in {self.path}")
        return [_Files(n, k, min(k + self.split, size)) for n, size in files for k in range(0, max(1, size), self.split)]

    def read(self, part: _Files) -> Iterator[tuple]:
        system, _ = open_fs(self.path)
        with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as file:
            if part.begin:  # the line over the border belongs to the part before
                file.seek(part.begin - 1)
                file.readline()
            while file.tell() < part.end and (line := file.readline()):
                text = line.removesuffix(b"\n").removesuffix(b"\r").decode()
                if text:
                    key, tab, value = text.partition("\t")
                    if not tab:
                        raise ValueError(f"record: no separator in {text!r}")
                    yield unescape_text(key), unescape_text(value)


class _Written(WriterCommitMessage):
    def __init__(self, attempt: str, name: str):
        self.attempt, self.name = attempt, name


class _Writer(DataSourceWriter):
    """An attempt is a hidden file; those that count move into place. Overwriting, what was there before goes after that."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        own = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        with create(f"{self.path}/._{own}") as out:
            for r in rows:
                out.write(f"{escape_text(r[0])}\t{escape_text(r[1])}\n".encode())
        return _Written(f"._{own}", own)

    def commit(self, messages) -> None:
        system, path = open_fs(self.path)
        system.create_dir(path, recursive=True)
        before = visible_files(self.path) if self.overwrite else []
        for m in messages:
            system.move(f"{path}/{m.attempt}", f"{path}/{m.name}")
        for name, _ in before:
            system.delete_file(name)

    def abort(self, messages) -> None:
        system, path = open_fs(self.path)
        for m in messages:
            if m and system.get_file_info(f"{path}/{m.attempt}").is_file:
                system.delete_file(f"{path}/{m.attempt}")
