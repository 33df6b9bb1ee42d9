"""Near-duplicate removal by min-max hashing.

Every distinct shingle set gets, under each of some 120 to 160 hash functions, its smallest and its largest value: two
values for one evaluation, agreeing between two sets with the probability of their Jaccard similarity.  Bands of
them give buckets.  Members of a bucket are tied to its smallest member, and connected sets of such ties are blocks:
no candidate pair leaves its block.  Inside a block links are confirmed on the full shingle sets, each set against
the postings of all others, so that no pair is written out; a block too large for one task is worked off by rounds
of pivots, each tested against all members where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage
from .graph import components

WORDS = 5             # words in a shingle
THRESHOLD = (80, 100)  # link if 100 * intersection >= 80 * union
MISS = 4e-6           # a pair at the threshold shares no band with at most this probability
BLOCK_SHINGLES = 4_000_000   # a block with more is not gathered in one task
ROUND_PIVOTS, ROUND_SHINGLES = 256, 4_000_000  # pivots of one round over large blocks
BROADCAST_ROWS = 500_000     # keys (28 bytes each) that may be broadcast instead of moving texts
MEMO = 300_000

SIGNATURES = "doc_id long, th long, n_shingles long, set_id string, bands array<long>"


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, seed=11)
        return h


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, memo: _WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words split at ASCII white space."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both are plain ASCII
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    w = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(words, 5)):
        h += w[j:j + n] * c
    return np.unique(_mixed(h))


def banding(threshold=THRESHOLD) -> tuple[int, int]:
    """(bands, values in a band): 41 of 6 at 0.8, 40 of 8 at 0.85; half of a band's values are minima."""
    t = threshold[0] / threshold[1]
    rows = 8 if t >= 0.85 else 6
    return math.ceil(math.log(MISS) / math.log1p(-min(t, 1 - 1e-9) ** rows)), rows


def band_hashes(x: np.ndarray, bands: int, rows: int) -> list[int]:
    """Hashes of the bands of a set's min-max signature; each hash function gives two values."""
    functions = bands * rows // 2
    a = _odd(functions, 7)[:, None]
    low = np.full(functions, 2**64 - 1, np.uint64)
    high = np.zeros(functions, np.uint64)
    for i in range(0, len(x), 512):
        y = a * x[i:i + 512]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    values = np.concatenate([low.reshape(bands, rows // 2), high.reshape(bands, rows // 2)], axis=1)
    h = (_mixed(values) * _odd(rows, 9)).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return _mixed(h).view(np.int64).tolist()


def signatures(docs: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """SIGNATURES of each row.  Sets so small that only equal ones can be linked get no bands."""
    bounded_batches(docs.sparkSession)
    num, den = threshold
    least = -(-num // (den - num)) if den > num else 1 << 62  # n / (n + 1) >= num / den from this n on
    shape = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHash()
        for b in batches:
            sizes, ids, bands = [], [], []
            for t in b.column(2):
                x = shingle_set(t.as_py(), memo)
                sizes.append(len(x))
                ids.append(xxhash.xxh3_128_hexdigest(x.tobytes()))
                bands.append(band_hashes(x, *shape) if len(x) >= least else [])
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()),
                pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "set_id", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, SIGNATURES)


def _linked(inter, n, m, threshold):
    num, den = threshold
    return den * inter >= num * (n + m - inter)


def block_links(ids: list[int], sets: list[np.ndarray], threshold=THRESHOLD) -> list[tuple[int, int]]:
    """(id, root) for every member: root is the smallest id that links of this block reach.

    Each member is tested against all others through the postings of its shingles, unless all are connected.
    """
    k = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(k)
    parts = k
    for p in range(k):
        if parts == 1:
            break
        own = inverse[first[p]:first[p + 1]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        inter = np.bincount(posting[at], minlength=k)
        near = np.flatnonzero(_linked(inter, sizes[p], sizes, threshold))
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
            parts -= len(roots) - 1
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, root, np.array(ids, np.int64))
    return list(zip(ids, least[root].tolist()))


def confirm_small(sets: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(id, root) from (block, id, shingles): blocks are gathered one after the other in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done():
            out = block_links(list(held), list(held.values()), threshold) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["id", "root"])

        for b in batches:
            for block, i, data in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if held:
                        yield done()
                    now, held = block, {}
                held[i] = np.frombuffer(data, np.uint64)
        if held:
            yield done()

    return (sets.select("block", "id", "shingles").repartition("block").sortWithinPartitions("block")
            .mapInArrow(run, "id long, root long"))


def confirm_large(sets: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(id, root) from (block, id, n_shingles, shingles) of blocks too large for one task.

    A round picks members that are not yet connected with their block's largest part, sends their sets (at most
    ROUND_SHINGLES in all) to every task and links them with the members there.  Rounds end when every member is
    either connected with the largest part or has been a pivot, so that every pair across parts has been tested.
    """
    spark = sets.sparkSession
    sets = stage(sets.select("block", "id", "n_shingles", "shingles").dropDuplicates(["id"]), "large")
    nodes = sets.select("block", "id", "n_shingles")
    links = spark.createDataFrame([], "a long, b long")
    used = spark.createDataFrame([], "id long")
    root = nodes.withColumn("root", F.col("id"))
    while True:
        sizes = root.groupBy("block", "root").agg(F.count("*").alias("n"))
        top = sizes.groupBy("block").agg(F.max(F.struct("n", "root")).alias("top")).select("block", "top.root", "top.n")
        open_ = (root.join(top.select("block", F.col("root").alias("top"), F.col("n").alias("top_n")), "block")
                 .filter("root != top or top_n = 1").join(used, "id", "left_anti"))
        picked, left = [], ROUND_SHINGLES
        for r in open_.orderBy(F.xxhash64("id"), "id").limit(ROUND_PIVOTS).collect():
            if picked and r["n_shingles"] > left:
                break
            picked.append(r["id"])
            left -= r["n_shingles"]
        if not picked:
            return root.select("id", "root")
        pivots: dict[int, list] = {}
        for r in sets.filter(F.col("id").isin(picked)).collect():
            pivots.setdefault(r["block"], []).append((r["id"], np.frombuffer(bytes(r["shingles"]), np.uint64)))
        here = spark.sparkContext.broadcast(pivots)

        def run(batches: Iterator[pa.RecordBatch], here=here) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for block, i, data in zip(*(c.to_pylist() for c in b.columns)):
                    x = np.frombuffer(data, np.uint64)
                    for p, y in here.value.get(block, ()):
                        if p != i and _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold):
                            out.append((i, p))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        links = stage(links.unionByName(sets.select("block", "id", "shingles").mapInArrow(run, "a long, b long")), "links")
        used = stage(used.unionByName(spark.createDataFrame([(i,) for i in picked], "id long")), "used")
        found = components(links)
        root = stage(nodes.join(found, "id", "left").select("block", "id", "n_shingles", F.coalesce("root", "id").alias("root")), "roots")


def near_duplicates(docs: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, th (xxhash64 of the text), n_shingles, component_id, part.

    Rows with equal shingle sets form a class; classes are linked if their similarity is ``threshold`` or more.  component_id
    is the smallest doc_id of the connected classes (null if they have none), ``part`` names the component (null for
    rows without words, which are linked with nothing and have their own doc_id as component).  Repeated rows and
    ids share their class; further columns are ignored; an empty table gives an empty result.
    """
    signed = stage(signatures(docs, threshold).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = stage(signed.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("rid").alias("id"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles")), "classes")
    reps = signed.select(F.col("rid").alias("id"), "doc_id", "th", "bands").join(classes.select("id", "n_shingles"), "id")
    banded = stage(reps.filter(F.size("bands") > 0).select("id", F.explode("bands").alias("band")), "bands")
    buckets = banded.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ties = banded.join(buckets, "band").filter("id != a").select("a", F.col("id").alias("b"))
    blocks = stage(components(ties).withColumnRenamed("root", "block"), "blocks")
    linked = _confirm(docs, reps, blocks, threshold)
    rooted = classes.join(linked, "id", "left").select("set_id", "first", F.coalesce("root", "id").alias("part"))
    rooted = stage(rooted, "rooted")
    firsts = rooted.groupBy("part").agg(F.min("first").alias("component_id"))
    found = rooted.join(firsts, "part").select("set_id", "part", "component_id")
    own = F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("part")
    return (signed.filter("n_shingles > 0").select("doc_id", "th", "n_shingles", "set_id").join(found, "set_id")
            .select("doc_id", "th", "n_shingles", "component_id", "part")
            .unionByName(signed.filter("n_shingles = 0").select("doc_id", "th", "n_shingles", *own)))


def _confirm(docs: DataFrame, reps: DataFrame, blocks: DataFrame, threshold) -> DataFrame:
    """(id, root) for the classes in ``blocks``, by links between full sets."""
    sizes = reps.select("id", "n_shingles", "doc_id", "th").join(blocks, "id")
    total = sizes.groupBy("block").agg(F.sum("n_shingles").alias("s"))
    keys = stage(sizes.join(total, "block").select(
        F.xxhash64("doc_id").alias("dk"), "th", "id", "block", (F.col("s") > BLOCK_SHINGLES).alias("large")), "keys")
    many = keys.count() > BROADCAST_ROWS
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("dk"), F.xxhash64("text").alias("th"), "text").join(
        keys if many else F.broadcast(keys), ["dk", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHash()
        for b in batches:
            sets = [shingle_set(t.as_py(), memo) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([x.tobytes() for x in sets], pa.binary())], ["block", "id", "large", "n_shingles", "shingles"])

    sets = texts.select("block", "id", "large", "text").mapInArrow(
        run, "block long, id long, large boolean, n_shingles long, shingles binary")
    if keys.filter("large").isEmpty():
        return stage(confirm_small(sets, threshold), "confirmed")
    sets = stage(sets, "sets")
    return stage(confirm_small(sets.filter("not large"), threshold).unionByName(
        confirm_large(sets.filter("large"), threshold)), "confirmed")


def dedup_rows(docs: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row stays of each component (the smallest doc_id, then the
    smallest text digest; of equal rows any one), and every row without words.  Columns pass unchanged."""
    found = near_duplicates(docs, threshold)
    best = (found.filter("part is not null").groupBy("part")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
            .select(F.xxhash64("k.doc_id").alias("_dk"), F.col("k.th").alias("_th")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.xxhash64(F.col("doc_id").cast("long")).alias("_dk"), F.xxhash64("text").alias("_th"),
                       F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    kept = rows.filter("_words").join(best, ["_dk", "_th"], "left_semi")
    once = kept.groupBy("_dk", "_th").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(rows.filter("not _words").select("row.*"))
