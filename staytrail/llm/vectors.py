"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Vectors become integers and are cut into parts; each part position has a codebook of entries, refined by rounds of
assignment and averaging.  The nearest entry is searched as Orchard does: every entry holds the list of all entries
by distance from it; a search walks the list of its best entry so far, jumps to the list of any entry that is nearer,
marks what it has visited, and ends where the list lies beyond twice the current distance.  Many searches of a batch
that stand at the same entry walk its list together, a stretch at a time.  All arithmetic is on integers, so that
results do not depend on how rows are split.

Only codebooks and their sums (PARTS * ENTRIES rows) come to the driver; rows never move but for their label sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import stage

#: production parameters: parts of a vector, entries of a codebook, rounds, integer steps a unit
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: list neighbours looked at together, and entries that a search tries first (every so many-th of the codebook)
STRETCH, PROBE = 64, 16
#: rows and bytes of vectors that are searched together
BLOCK_ROWS, BLOCK_BYTES = 32768, 32 << 20
CODES = "vec_id long, label string, code string, error long"


def finite(vector: str) -> Column:
    """True where the vector is not null and holds neither null nor non-finite components."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))), F.lit(False))


def integers(values: np.ndarray, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), held within the range in which squared distances still fit a long."""
    most = isqrt((1 << 58) // max(dim, 1))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


class Codebook:
    """The entries of one part position with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        exact = 8 * int(np.abs(entries).max(initial=0)) ** 2 * max(entries.shape[1], 1) < 1 << 53
        self.most = isqrt((1 << 53) // (8 * max(entries.shape[1], 1))) if exact else -1
        gaps = _distances(entries, entries)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every row; ties go to the lower index."""
        # products of such sizes are exact in doubles, which multiply faster
        kind = np.float64 if int(np.abs(rows).max(initial=0)) <= self.most else np.int64
        rows, entries = rows.astype(kind), self.entries.astype(kind)
        k, n = len(entries), len(rows)
        probes = np.arange(0, k, max(1, k // PROBE))
        first = _distances(rows, entries[probes])
        at = probes[first.argmin(axis=1)]
        best = first.min(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, probes] = True
        walking = np.arange(n)
        while len(walking):
            walking = walking[np.argsort(at[walking], kind="stable")]
            groups = np.split(walking, np.flatnonzero(np.diff(at[walking])) + 1)
            walking = np.concatenate([self._walk(g, rows, entries, at, best, visited) for g in groups])
        return at, best.astype(np.int64)

    def _walk(self, group, rows, entries, at, best, visited) -> np.ndarray:
        """Walks the list of the entry at which all of ``group`` stand; returns those that found a nearer one."""
        here = at[group[0]]
        moved = [group[:0]]
        for i in range(0, len(entries), STRETCH):
            group = group[self.gaps[here, i] <= 4 * best[group]]
            if not len(group):
                break
            stretch = self.lists[here, i:i + STRETCH]
            known = visited[group[:, None], stretch]
            new = ~known.all(axis=1)
            searching, known = group[new], known[new]
            if not len(searching):
                continue
            found = _distances(rows[searching], entries[stretch])
            visited[searching[:, None], stretch] = True
            least = np.where(known, np.inf if found.dtype == np.float64 else np.iinfo(np.int64).max, found)
            distance = least.min(axis=1)
            index = np.where(least == distance[:, None], stretch, len(entries)).min(axis=1)
            nearer = (distance < best[searching]) | ((distance == best[searching]) & (index < here))
            gone = searching[nearer]
            at[gone], best[gone] = index[nearer], distance[nearer]
            moved.append(gone)
            group = group[at[group] == here]
        return np.concatenate(moved)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """Where the parts start and end; if ``dim`` can't be divided, the first parts are one longer."""
    return [0, *np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[list, np.ndarray]]:
    """Batches joined to blocks: (other columns of the block, integer rows)."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, most):
            held.append(b.slice(i, most))
            n += held[-1].num_rows
            if n >= most:
                yield _block(held, dim, scale)
                held, n = [], 0
    if n:
        yield _block(held, dim, scale)


def _block(held: list, dim: int, scale: int) -> tuple[list, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    values = t.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return [t.column(i) for i in range(1, t.num_columns)], integers(values.reshape(t.num_rows, dim), dim, scale)


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, one array (entries, components) for each part position, from ``rows`` (vec_id, vector).

    They start as the parts of the rows with the least ids (null last, equal ids by their vectors); fewer rows than
    ``entries`` give as many entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    ends = cuts(dim, parts)
    start = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim), dim, scale)
    books = [start[:, a:b] for a, b in zip(ends, ends[1:])]
    widest = max(b - a for a, b in zip(ends, ends[1:]))
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            searched = [Codebook(b) for b in books]
            total = [np.zeros_like(b) for b in books]
            count = [np.zeros(len(b), np.int64) for b in books]
            for _, block in _blocks(batches, dim, scale):
                for p, book in enumerate(searched):
                    part = block[:, ends[p]:ends[p + 1]]
                    code, _ = book.nearest(part)
                    np.add.at(total[p], code, part)
                    count[p] += np.bincount(code, minlength=len(count[p]))
            for p in range(len(books)):
                used = np.flatnonzero(count[p])
                yield pa.RecordBatch.from_arrays([
                    pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used]),
                    pa.array(list(total[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        partial = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, s array<long>")
        found = partial.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(widest))).alias("s")).collect()
        books = [b.copy() for b in books]
        for r in found:  # at most parts * entries rows
            width = books[r["part"]].shape[1]
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["s"][:width]]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """CODES of ``rows`` (vector, vec_id, label): a hex pair for each part, and the summed squared distance."""
    dim = sum(b.shape[1] for b in books)
    ends = [0, *np.cumsum([b.shape[1] for b in books]).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for (ids, labels), block in _blocks(batches, dim, scale):
            found = [book.nearest(block[:, ends[p]:ends[p + 1]]) for p, book in enumerate(searched)]
            digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * len(found)
            codes = [digits[i:i + width] for i in range(0, len(digits), width)]
            error = np.sum([e for _, e in found], axis=0)
            out = pa.Table.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                                       ["vec_id", "label", "code", "error"])
            yield from out.to_batches()

    return rows.select("vector", F.col("vec_id").cast("long"), F.col("label").cast("string")).mapInArrow(run, CODES)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(table: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per kept row of ``table`` (vec_id, ``vector``, label): vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another
    length than the most frequent one (of equally frequent ones the longest).  A null vec_id stays and comes last
    where ids decide; repeated rows and ids are coded one by one; null labels are summed together; an empty table, or
    one without a kept row, gives an empty result; further columns are ignored whatever their names.  ``entries`` may
    be at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte for each part: 1 to 256 entries")
    rows = table.select(F.col("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col("label")).filter(finite("vector"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return table.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("vector") == lengths["dim"])
    books = fit(rows.select("vec_id", "vector"), lengths["dim"], parts, entries, rounds, scale)
    label = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("null"))
    coded = stage(encode(rows, books, scale).withColumn("label", label), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return lookup_join(coded, sums, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
