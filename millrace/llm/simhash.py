"""SimHash near-duplicates by multi-index hashing (Manku et al. 2007; Norouzi et al. 2012).

A 64-bit fingerprint is cut into two segments of 32 bits. For a radius of 2 one index is probed with the
Hamming ball of radius 1 around the high segment (33 keys), the other with the low segment itself (1 key): if
the low segments differ, the high ones differ at one bit at most. The matches of the segment tables are then
verified on the complete fingerprints.

Buckets of more than ``HEAVY`` fingerprints would give pairs in the square of their size. There the second
segment is enumerated too: the members name the fingerprints at one bit's distance, the probes from outside
name themselves, moved into the bucket. All that share such a name are within two bits of each other, and at
most 65 can, so a star over each name loses no component and no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import star_components
from millrace.session import ship, written

SEED = 42
#: Buckets of a segment table with more fingerprints than this are enumerated by both segments.
HEAVY = 64
LOW = 0xFFFFFFFF


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words; of the whole sequence if it has fewer words."""
    parts = text.lower().split()  # of bytes: A-Z and the ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True) if words > 1 else zip(starts.tolist(), ends.tolist(), strict=True)
    return np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed 64-bit number; 0 for no hash."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255  # 255 bytes of 0 or 1 add up within a byte
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` for each row: null, empty and blank texts have fingerprint 0. Other columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t or b"", words)) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _ball(segment: Column) -> Column:
    """The 33 values within one bit of a 32-bit segment; the segment itself comes first."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in [0, *(1 << j for j in range(32))]])
    return F.transform(masks, lambda m: segment.bitwiseXOR(m))


def _halves(fp: str) -> tuple[Column, Column]:
    return F.shiftrightunsigned(F.col(fp), 32), F.col(fp).bitwiseAND(F.lit(LOW))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``fp`` that join all pairs within 2 bits.

    Pairs of light buckets come one by one; those of heavy buckets as stars of the same components.
    """
    hi, lo = _halves("fp")
    low_key = lo + F.lit(1 << 32)  # the low segment's index has keys of its own
    entries = fps.select("fp", F.explode(F.array(hi, low_key)).alias("key"))
    probes = fps.select("fp", F.explode(F.concat(_ball(hi), F.array(low_key))).alias("key"))
    heavy = written(entries.groupBy("key").count().where(F.col("count") > HEAVY).select("key"), "heavy")
    crowded = not heavy.isEmpty()
    light = entries.join(heavy, "key", "left_anti") if crowded else entries
    pairs = (
        probes.withColumnRenamed("fp", "a")
        .join(light.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    if not crowded:
        return pairs
    hits = probes.join(heavy, "key", "left_semi")
    own = F.col("key") == hi
    in_low = F.col("key") >= (1 << 32)
    compose = lambda high, low: F.shiftleft(high, 32).bitwiseOR(low)
    names = (
        F.when(in_low, F.transform(_ball(hi), lambda h: compose(h, lo)))
        .when(own, F.transform(_ball(lo), lambda w: compose(F.col("key"), w)))
        .otherwise(F.array(compose(F.col("key"), lo)))
    )
    stars = (
        hits.select("fp", F.explode(names).alias("name"))
        .groupBy("name")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # 65 at most: the fingerprints are distinct
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where(F.col("a") != F.col("b"))
    )
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``.

    Rows whose fingerprints can be reached from one another by steps of at most 2 differing bits share the
    smallest non-null id among them. Null, empty and blank texts have fingerprint 0 and are linked like any
    other. Rows with a null id get their group's smallest id (null if the whole group has none); repeated
    rows and ids come back as often as they went in. An empty table gives an empty table. Other columns of
    ``docs``, whatever their names, are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = star_components(links(classes.select("fp")), "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp", "left").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by similarity ---
#
# SimHash comes first: the links that multi-index hashing finds between the fingerprints of all texts, each confirmed on the complete shingle
# sets. Fingerprints of similar sets may differ in more bits than an index finds. So the sets in different groups of these links then take part
# in an exact join on the Jaccard similarity, by prefixes (Chaudhuri et al. 2006; Bayardo et al. 2007): of two sets that are similar enough,
# each holds at most a known number of shingles that the other lacks. So in any order of all shingles their first ones, one more than that
# number, meet; and of more first ones, more meet. No step leaves out a pair that is similar enough.

#: All pairs of a key's members are compared if there are so many; else with two of them first.
CROWD = 8
#: Crowded keys that a set's first comparisons come from.
STAR_KEYS = 4
#: 64-bit numbers of a parity sketch.
SKETCH = 16


def least_common(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` has in common with any set of at least this similarity, at the least."""
    return math.ceil(similarity * n - 1e-9)


def shingle_set(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The distinct shingle hashes in order, and a signed hash of them all."""
    found = np.unique(hashes)
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63), found


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH buckets whether it holds an odd number of the hashes: sketches differ in as many bits as sets do in hashes, at most."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _copy_marks(words: int, similarity: float):
    """``(id, h, c, n, fp, keys)``: the SimHash fingerprint, and the least hashes, of which any similar set has ``n / 20 + 1`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py() or b"", words) for t in batch.column(2)]
            sets = [shingle_set(x) for x in hashes]
            keys = [f[: len(f) - least_common(len(f), similarity) + 1 + len(f) // 20].view(np.int64) for _, f in sets]
            numbers = [pa.array(x, pa.int64()) for x in ([c for c, _ in sets], [len(f) for _, f in sets], [fingerprint(x) for x in hashes])]
            columns = [batch.column(0), batch.column(1), *numbers, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "c", "n", "fp", "keys"])

    return run


def _copy_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(shingle_hashes(t.as_py() or b"", words)) for t in batch.column(0)]
            lists = [pa.array([x.view(np.int64) for x in col], pa.list_(pa.int64())) for col in ([f for _, f in sets], [parity_sketch(f) for _, f in sets])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sets], pa.int64()), pa.array([len(f) for _, f in sets], pa.int64()), *lists], ["c", "n", "tokens", "sketch"])

    return run


def _may_be_similar(similarity: float) -> Column:
    """Of sets with sizes ``n``, ``m`` and sketches ``p``, ``q``: false only where they are less similar."""
    apart = sum((F.bit_count(F.get("p", k).bitwiseXOR(F.get("q", k))) for k in range(1, SKETCH)), F.bit_count(F.get("p", 0).bitwiseXOR(F.get("q", 0))))
    sizes = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-6
    return sizes & (apart <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, sifted: bool = False) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets have at least this Jaccard similarity, as a written table."""
    if not sifted:
        left = sets.select(F.col("c").alias("a"), "n", F.col("sketch").alias("p"))
        right = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("q"))
        pairs = pairs.join(left, "a").join(right, "b").where(_may_be_similar(similarity)).select("a", "b")
    pairs = written(pairs, "pairs")
    left = sets.select(F.col("c").alias("a"), "n", F.col("tokens").alias("p"))
    right = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("q"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("p", "q"))
    return written(both.where(common * (1 + similarity) >= (F.col("n") + F.col("m")) * similarity - 1e-6).select("a", "b"), "links")


def print_links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets whose SimHash fingerprints are linked, of distinct rows ``(fp, c)``.

    Of the sets of one fingerprint each meets the smallest; the smallest ones of linked fingerprints meet.
    """
    heads = written(prints.groupBy("fp").agg(F.min("c").alias("head")), "heads")
    same = prints.join(heads, "fp").select(F.col("head").alias("a"), F.col("c").alias("b"))
    found = written(links(heads.select("fp")), "near")
    left, right = (heads.select(F.col("fp").alias(x), F.col("head").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    other = found.join(left, "a").join(right, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return same.unionByName(other).where(F.col("a") != F.col("b")).distinct()


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs within keys of at most CROWD members, whose roots differ."""
    sets = members.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("c", "root"))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, CROWD), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).where("p.a.root <> p.b.root").select(F.col("p.a.c").alias("a"), F.col("p.b.c").alias("b")).distinct()


def _stars(crowd: DataFrame) -> DataFrame:
    """Pairs of members of crowded keys with two of each key: that of the most neighbours, and the smallest set; their roots differ. A set takes part by a few of its keys."""
    own = crowd.groupBy("c").agg(F.any_value("n").alias("n"), F.any_value("root").alias("root"), F.sum("held").alias("deg"), F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("less"), "key"))).alias("all"))
    own = written(own.select("c", "n", "root", "deg", F.explode(F.slice("all", 1, STAR_KEYS)).alias("k")).select("c", "n", "root", "deg", F.col("k.key").alias("key")), "crowd")
    heads = own.groupBy("key").agg(F.max(F.struct("deg", "c", "root")).alias("most"), F.min(F.struct("n", "c", "root")).alias("least"))
    ends = [F.struct(F.col(f"{x}.c").alias("c"), F.col(f"{x}.root").alias("root")) for x in ("most", "least")]
    heads = heads.select("key", F.explode(F.array_distinct(F.array(*ends))).alias("head"))
    heads = written(heads.select("key", F.col("head.c").alias("head"), F.col("head.root").alias("top")), "heads")
    both = own.select("key", "c", "root").join(heads, "key").where(F.col("root") != F.col("top"))
    return both.select(F.least("head", "c").alias("a"), F.greatest("head", "c").alias("b")).distinct()


def _across(crowd: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of crowded keys that are in different components and may be similar.

    The smaller set of a pair meets the larger one in its own class of sizes or the next: sizes of similar sets differ by less than a class.
    """
    rooted = crowd.join(roots, crowd["c"] == roots["node"], "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    rooted = written(rooted, "rooted")
    apart = written(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "apart")
    rest = rooted.join(apart, "key", "left_semi").join(sets.select("c", "n", "sketch"), "c")
    # a class spans slightly more than what the similarity allows
    rest = written(rest.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / (-math.log(similarity) + 1e-6)).cast("int")), "unsettled")
    left = rest.select("key", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("c").alias("a"), "n", F.col("sketch").alias("p"), F.col("root").alias("ra"))
    right = rest.select("key", "size", F.col("c").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("q"), F.col("root").alias("rb"))
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    return left.join(right, ["key", "size"]).where(ordered & (F.col("ra") != F.col("rb")) & _may_be_similar(similarity)).select("a", "b").distinct()


def copy_links(sets: DataFrame, similarity: float, near: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the sets ``(c, n, tokens, sketch)``: all are similar enough, and they join all that are.

    ``near`` has the links of SimHash, confirmed; only sets that they leave in different components are compared here. Keys are each set's first shingles, rare ones first. All pairs of a key's members are compared if there are CROWD at most. Members
    of a crowded key are compared with two of them; that puts a large group of copies into one component. In the keys whose members are
    then still in several components, all pairs across components are compared, by size and sketch within the join: what these exclude is
    not similar. So no pair of a crowded key is left out unless its members are linked already.
    """
    tied = star_components(near, "a", "b").select(F.col("node").alias("c"), "root")
    tokens = sets.select("c", F.explode("tokens").alias("token"))
    common = written(tokens.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > 1), "shared")
    firsts = tokens.join(common, "token").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("all")).join(sets.select("c", "n"), "c")
    firsts = firsts.join(tied, "c", "left").select("c", "n", "all", F.coalesce("root", "c").alias("root"))
    # shingles that no other set holds come first of all
    spare = F.size("all") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    keys = firsts.where(spare > 0).select("c", "n", "root", F.explode(F.slice("all", 1, spare)).alias("k")).select("c", "n", "root", F.col("k.token").alias("key"))
    keys = written(keys, "keys")
    counts = written(keys.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > 1), "counts")
    members = written(keys.join(counts, "key").select("key", "c", "n", "root", "held"), "members")
    crowd = members.where(F.col("held") > CROWD)
    links = near.unionByName(_verified(_all_pairs(members.where(F.col("held") <= CROWD)).unionByName(_stars(crowd)).distinct(), sets, similarity))
    if crowd.isEmpty():
        return links
    return links.unionByName(_verified(_across(crowd.select("key", "c"), star_components(links, "a", "b"), sets, similarity), sets, similarity, sifted=True))


def _alive(marks: DataFrame) -> DataFrame:
    """``(h)`` of the texts of which as many of the least shingles are in other sets as a similar one makes sure."""
    posts = marks.select("c", F.explode("keys").alias("key"))
    shared = written(posts.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "shared")
    hits = written(posts.join(shared, "key", "left_semi").groupBy("c").agg(F.count("*").alias("hits")), "hits")
    # equal sets add up, so their number counts as often
    need = F.count("*") * (F.floor(F.any_value("n") / 20) + 1)
    held = written(marks.groupBy("c").agg(need.alias("need")).join(hits, "c").where("hits >= need").select("c"), "held")
    return written(marks.select("c", "h").join(held, "c", "left_semi").select("h").distinct(), "alive")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component_id)`` for each row of ``docs``: the smallest non-null id of its group of near copies.

    Texts are near copies if the Jaccard similarity of their sets of ``words``-word shingles (as 64-bit hashes) is ``similarity`` or more;
    groups are what links reach. SimHash links come first and are confirmed; an exact join finds those that they lack. Null, empty and blank texts are near copies of one another. Repeated rows and
    ids and null ids come out as they went in; an empty table gives an empty table. Other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("binary")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    marks = written(own.mapInArrow(_copy_marks(words, similarity), f"id {kind}, h bigint, c bigint, n bigint, fp bigint, keys array<bigint>"), "marks")
    prints = written(marks.select("fp", "c").distinct(), "prints")
    alive = own.select("t", "h").join(_alive(marks), "h", "left_semi").select("t")
    sets = alive.mapInArrow(_copy_sets(words), "c bigint, n bigint, tokens array<bigint>, sketch array<bigint>")
    sets = written(sets.groupBy("c").agg(*[F.any_value(x).alias(x) for x in ("n", "tokens", "sketch")]), "sets")
    near = _verified(print_links(prints), sets, similarity)
    roots = star_components(copy_links(sets, similarity, near), "a", "b")
    classes = written(marks.groupBy("c").agg(F.min("id").alias("least")), "classes")
    rooted = classes.join(roots, classes["c"] == roots["node"], "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = written(rooted.join(smallest, "root").select("c", "component_id"), "named")
    return marks.select("id", "c").join(named, "c", "left").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those near copies, by SimHash and an exact check, whose id is not their group's smallest; rows with a null id stay.

    Null, empty and blank texts are one group, of which one row stays. Repeated rows of an id that stays all stay. An empty table
    gives an empty table. Columns of any name are carried.
    """
    groups = near_copies(docs, id_col, text_col, words, similarity)
    gone = written(groups.where(F.col("component_id") < F.col("id")).select(F.col("id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
