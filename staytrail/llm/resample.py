"""Importance resampling towards a target distribution.

Documents and target texts are described by hashed runs of one and two words.  A bucket's gain is the logarithm of its
smoothed rate in the target over that in the documents; a document's weight is the mean gain of its runs, and adding
Gumbel noise that only its id decides turns the choice of the highest scores into a draw by weight.

The hash is CRC-32 by a position table.  A CRC is linear over XOR: what a byte adds depends only on its value and its
distance from the end of the run, and what the length adds is a constant.  So the bytes of all runs of a batch are laid
out, each one's contribution is looked up, and ``bitwise_xor.reduceat`` folds the spans.  Runs longer than the table
fold block by block: the states of neighbouring blocks are joined in pairs, the front one moved on by the length behind it.

Only bucket counts (at most BUCKETS rows a side) come to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ranked, stage

#: production parameters: hash buckets, longest run of words, drawn percent, least words of a document that is drawn, seed
BUCKETS, LONGEST, PERCENT, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: distances from the end that the position table holds
REACH = 128
#: bytes of runs that are hashed together
PIECE = 1 << 18

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: fixed values: bytes of words are digits, small letters and everything beyond ASCII; the rest parts them
TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


@cache
def position_table() -> np.ndarray:
    """(REACH, 256): what a byte at a distance from the end adds to the CRC."""
    table = np.zeros((REACH, 256), np.uint32)
    for distance in range(REACH):
        tail = bytes(distance)
        table[distance] = [zlib.crc32(bytes([b]) + tail) for b in range(256)]
        table[distance] ^= table[distance, 0]
    return table


@cache
def moves(level: int) -> np.ndarray:
    """(4, 256): a state moved on by REACH * 2**level zero bytes, as the XOR of one entry for each of its bytes."""
    if level:
        return moved(moves(level - 1).ravel(), level - 1).reshape(4, 256)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(REACH):  # one zero byte: the low byte leaves, what it stands for comes in
        state = (state >> 8) ^ _byte_step()[state & 255]
    return state


@cache
def _byte_step() -> np.ndarray:
    """What the low byte of a state turns into when a byte is taken in."""
    return position_table()[0]


def moved(states: np.ndarray, level: int) -> np.ndarray:
    m = moves(level)
    return m[0][states & 255] ^ m[1][states >> 8 & 255] ^ m[2][states >> 16 & 255] ^ m[3][states >> 24]


@cache
def short_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(REACH * 8)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC of so many zero bytes, for each length."""
    table = short_constants()
    found = table[np.minimum(lengths, len(table) - 1)]
    for i in np.flatnonzero(lengths >= len(table)):
        found[i] = zlib.crc32(bytes(lengths[i]))
    return found


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span [start, end) of ``data`` (bytes); spans may overlap but are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum(), dtype=np.int64)
    values = data[at + np.repeat(starts - heads, lengths)]
    distance = np.repeat(heads + lengths - 1, lengths) - at
    if lengths.max() <= REACH:
        states = np.bitwise_xor.reduceat(position_table().ravel().take(distance * 256 + values), heads)
        return states ^ length_constants(lengths)
    blocks = (lengths + REACH - 1) // REACH
    behind = _behind(blocks)
    # a span's first block takes what is left of its length, the others are full
    cut = np.repeat(heads + lengths, blocks) - np.minimum((behind + 1) * REACH, np.repeat(lengths, blocks))
    states = np.bitwise_xor.reduceat(position_table().ravel().take(distance % REACH * 256 + values), cut)
    level = 0
    while len(states) > len(starts):
        behind = _behind(blocks)
        front = behind % 2 == 1
        states[front] = moved(states[front], level)
        # blocks 2k + 1 and 2k from the end become block k; a span's first block may be alone
        states = np.bitwise_xor.reduceat(states, np.flatnonzero(front | (behind == np.repeat(blocks, blocks) - 1)))
        blocks = (blocks + 1) // 2
        level += 1
    return states ^ length_constants(lengths)


def _behind(blocks: np.ndarray) -> np.ndarray:
    """For spans of so many blocks each, the number of blocks behind each block of its span."""
    return np.repeat(np.cumsum(blocks) - 1, blocks) - np.arange(blocks.sum())


def word_bytes(text: str | None) -> bytes:
    """The words of a text in UTF-8, parted by one space each."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(TO_SPACE).split())


def runs(texts: list[str | None], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, CRC-32) of all runs of 1 to ``longest`` words, in pieces of about PIECE bytes of words."""
    joined = [word_bytes(t) for t in texts]
    counts = np.array([j.count(b" ") + 1 if j else 0 for j in joined], np.int64)
    data = np.frombuffer(b" ".join(j for j in joined if j), np.uint8)
    if not len(data):
        return
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    text = np.repeat(np.arange(len(counts)), counts)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE)))
        for n in range(1, longest + 1):
            word = np.arange(first, min(last, len(starts) - n + 1))
            word = word[text[word] == text[word + n - 1]]
            yield text[word], span_crcs(data, starts[word], ends[word + n - 1])
        first = last


def count_buckets(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Runs in every bucket over all rows of ``texts`` (text); one row a bucket comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc in runs(b.column(0).to_pylist(), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    bounded_batches(texts.sparkSession)
    found = np.zeros(buckets, np.int64)
    counted = texts.select("text").filter("text is not null").mapInArrow(run, "bucket int, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed rate in ``target`` over that in ``source``) of every bucket."""
    n = len(source)
    s, t = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log(float((y + 1) * s) / float((x + 1) * t)))
                     for x, y in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight (floored mean gain; without runs 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, total = np.zeros((2, b.num_rows), np.int64)
            words = np.zeros(b.num_rows, np.int64)
            for i, (text, crc) in enumerate(runs(b.column(1).to_pylist(), longest)):
                count = np.bincount(text, minlength=b.num_rows)
                number += count
                if i % longest == 0:
                    words += count
                # sums of whole numbers that stay far below 2**53 are exact in doubles
                total += np.bincount(text, gains[crc % np.uint32(len(gains))], b.num_rows).astype(np.int64)
            weight = np.where(number > 0, total // np.maximum(number, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(number), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank, towards the texts of ``target``.

    Of the rows with at least ``min_words`` words, floor(percent / 100 of them) with the highest scores get the ranks
    1, 2, 3 ... (ties: smaller doc_id, null last; equal rows may swap), the others null.  Null and empty texts have no
    runs and weight 0.  A null doc_id is the string ``null`` in the noise's hash, so such rows share their noise;
    repeated rows and ids are drawn one by one.  An empty target gives all its buckets the smoothed rate, an
    empty ``docs`` an empty result.  Further columns are ignored whatever their names.
    """
    source = docs.select("doc_id", "text")
    gains = bucket_gains(count_buckets(source, longest, buckets), count_buckets(target, longest, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    noise = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5
    gumbel = F.floor(-1000 * F.log(-F.log(noise / 4294967296.0)))
    scored = stage(weigh(source, gains, longest).withColumn("score", F.col("weight") + gumbel), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    # equal rows get a number each, so that they may lie in several ranges
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("_row")]
    places = ranked(able.withColumn("_row", F.monotonically_increasing_id()), order, "rank", "ranked")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return places.select(*columns, rank.cast("long").alias("rank")).unionByName(
        scored.filter(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))
