"""Quality rules by compression bands.

A text that repeats itself compresses far better than prose of its length, random text hardly at all.  The ratio
of zstandard bytes to UTF-8 bytes is taken over the whole text and over fixed chunks of it, its tail included; limits depend on the
length, as short texts carry the frame's overhead and long ones profit from their history.  The least ratio is per
code point, so that letters of several bytes don't read as repetition.  Base rules (few words, many repeated
three-word windows) come first.  Row-local: one pass, no shuffle.

Limits follow the corpus: ``fit_limits`` takes them as quantiles of the ratios of all documents that are labelled clean, but
for the fifth of the ids that is left for checks.  Where there are no labels, or too few of a length, neutral limits hold.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage

LEVEL = 3
CHUNK = 4096
#: fitting: share of the ratios beyond each limit, what is added to the limits; rows that a band needs by itself and with
#: its neighbours
BEYOND, BELOW, ABOVE, ALONE, TOGETHER = 0.001, 0.005, 0.05, 500, 50
#: ids of documents labelled clean up to which they are broadcast; beyond, ratios of all documents are joined to them
BROADCAST_IDS = 500_000
#: lengths in bytes at which fitted bands start: two an octave, from 256 bytes to a megabyte
EDGES = tuple(round(256 * 2 ** (k / 2)) for k in range(25))


class Limits(NamedTuple):
    """``whole``: from so many bytes on, least ratio of the whole text per code point, most per byte; shorter texts are
    not judged by it.  ``chunks``: from so many chunks on, least and most ratio of a chunk, and the share of chunks that
    may lie outside."""
    whole: tuple[tuple[int, float, float], ...]
    chunks: tuple[tuple[int, float, float, float], ...]


#: neutral limits: ordinary English text files lie inside but for lists and tables; nothing is taken from the test tables
NEUTRAL = Limits(
    ((256, 0.44, 0.97), (512, 0.44, 0.90), (1024, 0.39, 0.80), (2048, 0.36, 0.80), (4096, 0.33, 0.74), (8192, 0.32, 0.74),
     (16384, 0.31, 0.74), (32768, 0.25, 0.72), (65536, 0.15, 0.72)),
    ((1, 0.30, 0.80, 0.5), (4, 0.30, 0.80, 0.25), (16, 0.30, 0.80, 0.125)))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, whole_ratio double, bad_chunks long, n_chunks long")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated three-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII white spaces
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        end = 0  # first word that no earlier repeated window holds
        for i, x in enumerate(windows):
            if counts[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def band_of(bands: tuple, x: int) -> tuple | None:
    """The last of ``bands`` that starts at ``x`` or before."""
    return next((b for b in reversed(bands) if x >= b[0]), None)


def chunk_ratios(data: bytes, compressor: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the full chunks, then of the last CHUNK bytes if full chunks leave some; none for shorter data."""
    full = len(data) // CHUNK
    starts = [*range(0, full * CHUNK, CHUNK), *([len(data) - CHUNK] if full and len(data) % CHUNK else [])]
    return [len(compressor.compress(data[i:i + CHUNK])) / CHUNK for i in starts]


def ratios(data: bytes, compressor: zstandard.ZstdCompressor, density: float = 1.0,
           limits: Limits = NEUTRAL) -> tuple[float | None, int, int]:
    """(ratio of the whole, full chunks outside the limits, full chunks); ``density`` is the text's code points a byte."""
    if not data:
        return None, 0, 0
    whole = len(compressor.compress(data)) / len(data)
    found = chunk_ratios(data, compressor)[:len(data) // CHUNK]
    return whole, _outside(found, density, limits), len(found)


def _outside(found: list[float], density: float, limits: Limits) -> int:
    band = band_of(limits.chunks, len(found))
    return sum(not band[1] * density <= x <= band[2] for x in found) if band else 0


def judge(text: str | None, compressor: zstandard.ZstdCompressor, limits: Limits = NEUTRAL) -> tuple:
    """All columns of FEATURES but the id."""
    n, chars, symbols, dup, repeated = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    data = (text or "").encode("utf-8", "surrogatepass")
    density = len(text) / len(data) if data else 1.0
    whole = len(compressor.compress(data)) / len(data) if data else None
    found = chunk_ratios(data, compressor)
    bad = _outside(found, density, limits)
    kept = not failed
    band = band_of(limits.whole, len(data))
    if kept and band and not band[1] * density <= whole <= band[2]:
        kept = False
    share = band_of(limits.chunks, len(found))
    if kept and share and bad > share[3] * len(found):
        kept = False
    return n, chars, symbols, dup, repeated, failed, kept, whole, bad, len(found)


def fit_limits(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> Limits:
    """Limits from documents of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) calls clean (quality 1).

    All labelled ids whose CRC-32 modulo 5 is not 0 count (the rest is left for checks), but for documents that the base
    rules reject.  Up to ``broadcast_ids`` ids are broadcast to the documents; beyond, all documents are measured and
    only their ratios move to the ids, never their texts.  Both ways give the same rows.  A band's limits are the
    BEYOND and 1 - BEYOND quantiles of its ratios, BELOW less and ABOVE more; a band with fewer than ALONE rows is taken
    together with its neighbours, one with fewer than TOGETHER even so keeps the neutral limits.  Ratios are rounded
    to four places, so that the quantiles are exact and their state is small.  Null ids and labels don't count; an id
    that is labelled twice is clean if all labels say so.
    """
    bounded_batches(docs.sparkSession)
    clean = (labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("q")).filter("q = 1").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    clean = stage(clean.select("doc_id"), "clean")
    n = clean.count()
    if not n:
        return NEUTRAL
    texts = docs.select("doc_id", "text")
    few = n <= broadcast_ids
    if few:
        texts = texts.join(F.broadcast(clean), "doc_id", "left_semi")  # ``broadcast_ids`` rows at most
    names = ["doc_id", "kind", "band", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                words, _, _, _, repeated = base_counts(text)
                if words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * words:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                found = chunk_ratios(data, compressor)
                whole, density = len(compressor.compress(data)) / len(data), len(text) / len(data)
                out.append((i, "whole", bisect_right(EDGES, len(data)) - 1, whole / density, whole))
                kind = sum(len(found) >= c[0] for c in NEUTRAL.chunks) - 1
                out += [(i, "chunk", kind, x / density, x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (b.column(0).type, pa.string(), pa.int32(), pa.float64(), pa.float64()))], names)

    found = texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, kind string, band int, low double, high double")
    if not few:
        found = found.join(clean, "doc_id", "left_semi")
    own = F.struct(F.col("band"), F.lit(True).alias("own"))
    near = [F.struct((F.col("band") + i).alias("band"), F.lit(False).alias("own")) for i in (-1, 0, 1)]
    pooled = found.select("kind", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.explode(F.array(own, *near)).alias("b"))
    rows = pooled.groupBy("kind", "b.band", "b.own").agg(
        F.count("*").alias("n"), F.percentile("low", F.lit(BEYOND)).alias("low"), F.percentile("high", F.lit(1 - BEYOND)).alias("high"))
    by = {(r["kind"], r["band"], r["own"]): r for r in rows.collect()}  # two rows a band
    if not by:
        return NEUTRAL

    def limits(kind: str, i: int, neutral: tuple) -> tuple[float, float]:
        alone, together = by.get((kind, i, True)), by.get((kind, i, False))
        r = alone if alone and alone["n"] >= ALONE else together
        if not r or r["n"] < TOGETHER:
            return neutral
        return r["low"] - BELOW, r["high"] + ABOVE

    whole = tuple((edge, *limits("whole", i, band_of(NEUTRAL.whole, edge)[1:])) for i, edge in enumerate(EDGES))
    return Limits(whole, tuple((c[0], *limits("chunk", i, c[1:3]), c[3]) for i, c in enumerate(NEUTRAL.chunks)))


def limits_of(docs: DataFrame, path: str) -> Limits:
    """Limits fitted to the labels in ``path``, the neutral ones if there is no such table."""
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return NEUTRAL
    return fit_limits(docs, spark.read.parquet(path))


def score_quality(docs: DataFrame, limits: Limits = NEUTRAL) -> DataFrame:
    """One row of FEATURES per row of ``docs`` (``doc_id``, ``text``; further columns are ignored).

    A null or empty text has no words: base_failed, not kept, whole_ratio null.  Repeated rows and ids are judged
    one by one; a null id stays null; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    names = [x.strip().split()[0] for x in FEATURES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        for b in batches:
            rows = [judge(t.as_py(), compressor, limits) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64())] + [pa.array(c, k) for c, k in zip(cols, kinds[1:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, FEATURES)


def keep_quality(docs: DataFrame, limits: Limits = NEUTRAL) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns whatever their names.

    Rows are filtered batch by batch and pass unchanged; nulls as in ``score_quality``.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), compressor, limits)[6] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
