"""Token counts through a digest cache.

The cache is a Parquet table keyed by (digest of the tokenizer's file and library, digest of the normalised text).
Documents are joined to it by digest; only one row for each digest that it lacks is encoded, and the new counts
are appended.  Text moves at most once, and not at all for what the cache holds when the misses are few.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, stage, text_or_empty

#: pieces of text whose counts a Python worker remembers at a time
MEMO = 500_000
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"

# A text may be cut before an ASCII space that a letter, digit or mark follows: the byte-level pre-tokenizer always
# starts a piece at the last space before a character that isn't white space, and no special string holds a space.
# Only plain printable ASCII and Latin letters count as such followers, so that Unicode tables don't matter.
CUT = re.compile("(?= [!-~¿-ɏ])")


class _Memo(dict):
    """Piece -> number of tokens, by the tokenizer itself."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, or ``name`` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """Digest of what fixes the counts: the library, its version and the vocabulary file."""
    path = tokenizer_path(name)
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} ".encode() + f.read()).hexdigest()


@cache
def counter(name: str):
    """A function text -> number of tokens, without begin, end or added special tokens.  A Python worker loads it once
    and keeps it, with what it remembers, for all its tasks."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    parts = json.loads(tokenizer.to_str())
    pre = parts["pre_tokenizer"] or {}
    cuttable = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                and not parts["normalizer"] and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"]
                                                        for x in parts["added_tokens"]))
    if not cuttable:
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    memo = _Memo(tokenizer)
    return lambda text: sum(map(memo.__getitem__, CUT.split(text))) if text else 0


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; a digest that two runs appended counts once."""
    table = spark.read.schema(CACHE_SCHEMA).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    return table.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None,
                 limit: int = 512, normalise: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache`` is a folder that all executors share; counts found there are used and new ones appended.  Without
    one, a new folder in the shared directory starts empty.  ``normalise`` is applied before digest and count (by
    default only null becomes empty).  Null and empty texts have 0 bytes and 0 tokens; equal texts are encoded
    once whatever their ids; repeated rows stay; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cache = cache or fresh_path(spark, "token-cache")
    kind = tokenizer_digest(tokenizer)
    text = text_or_empty() if normalise is None else normalise
    keyed = docs.select(F.col("doc_id"), text.alias("_t"))
    keyed = keyed.select("doc_id", "_t", F.sha2("_t", 256).alias("digest"), F.xxhash64("doc_id").alias("_r"))
    narrow = stage(keyed.select("doc_id", "digest", F.octet_length("_t").cast("long").alias("n_bytes"), "_r"), "digests")
    misses = narrow.groupBy("digest").agg(F.min("_r").alias("_r")).join(read_cache(spark, cache, kind), "digest", "left_anti")
    # a miss names one row (or repeats of it): copies don't meet in the exchange, as the row's hash is part of the key
    texts = keyed.select("digest", "_r", "_t").join(misses, ["digest", "_r"], "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        seen: set[str] = set()  # equal rows come to one task
        for b in batches:
            new = [(d, count(t.as_py())) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if d not in seen and not seen.add(d)]
            yield pa.RecordBatch.from_arrays([
                pa.array([kind] * len(new), pa.string()), pa.array([d for d, _ in new], pa.string()),
                pa.array([n for _, n in new], pa.int64())], ["tokenizer", "digest", "n_tokens"])

    encoded = texts.select("digest", "_t").mapInArrow(encode, CACHE_SCHEMA)
    encoded.dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = stage(read_cache(spark, cache, kind), "counts")  # so that the join below deals both sides anew and can split hot digests
    return narrow.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
