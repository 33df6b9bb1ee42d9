"""Line deduplication by a log-template tree.

Every line is parsed to a fixed depth: its number of words, then its leading words, with variable words (such with
digits, addresses, identifiers) as wildcards.  Below that leaf the line stands for several templates: its masked
words as they are, the same with one of FIELDS runs of words as a wildcard, and its words unmasked.  A template that occurs in enough
distinct texts, the fewer the longer it is, is recurring, and the lines that have one are dropped.

All templates of a line follow from the line alone, so the tree is never held anywhere: templates are counted by
hash, once a text and combined before the exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage, text_or_empty

LEADING = 2       # leading words on the path to a leaf
FIELDS = 4        # runs of words after them that may each be variable
CONSTANT = 3      # a template with variable words needs so many constant ones
#: (from so many constant words on, distinct texts in which a recurring template occurs), at most four; chance makes
#: short lines recur, hardly ever long ones
MIN_TEXTS = ((0, 10), (8, 5), (16, 3), (32, 2))
WORD_BYTES = 8    # so many bytes count as a constant word at least, for scripts without spaces
VARIABLE = re.compile(rb"[0-9@]|://|[A-Za-z+/=_-]{24}")
BROADCAST_ROWS = 2_000_000  # recurring templates (8 bytes each) that may be broadcast


def _hash(template: bytes, constant: int, variable: int) -> int:
    """64-bit hash whose two lowest bits are the place in MIN_TEXTS that the template's constant words reach."""
    size = max(constant, (len(template) - 4 * variable) // WORD_BYTES)
    need = sum(size >= least for least, _ in MIN_TEXTS) - 1
    return (xxhash.xxh3_64_intdigest(template) - 2**63) & ~3 | need


def templates(line: bytes) -> list[int]:
    """Hashes of the line's templates; none for a line without words."""
    words = line.split()
    n = len(words)
    if not n:
        return []
    masked = [b"<*>" if VARIABLE.search(w) else w for w in words] if VARIABLE.search(line) else words
    leaf = b"%d " % n + b" ".join(masked[:LEADING])
    rest = masked[LEADING:]
    constant = n - masked.count(b"<*>")
    out = []
    if constant < n:
        out.append(_hash(b"=%d " % n + b" ".join(words), n, 0))
    if constant >= min(n, CONSTANT):
        out.append(_hash(leaf + b"\n" + b" ".join(rest), constant, n - constant))
    if len(rest) >= FIELDS:
        for k in range(FIELDS):
            i, j = len(rest) * k // FIELDS, len(rest) * (k + 1) // FIELDS
            fixed = constant - (j - i - rest[i:j].count(b"<*>"))
            if fixed >= max(CONSTANT, n // 2):
                kept = b" ".join(rest[:i] + [b"<*>"] * (j - i) + rest[j:])
                out.append(_hash(leaf + b"\n%d\n" % k + kept, fixed, n - fixed))
    return out


#: two hashes of a text, 96 bits together: texts of one first hash are still told apart
TEXT = ("text_id", "text_check")


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("text_id"), F.hash("text").alias("text_check")]


def _parsed(docs: DataFrame) -> DataFrame:
    """(text_id, text_check, line, template) for all templates of all lines; copies of a text may come once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            ids, checks, lines, found = [], [], [], []
            for h, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (h, c) in seen:
                    continue
                seen.add((h, c))
                own = [(i, x) for i, line in enumerate(t.as_py().encode("utf-8", "surrogatepass").split(b"\n")) for x in templates(line)]
                if own:
                    ids.append(h)
                    checks.append(c)
                    lines.append([i for i, _ in own])
                    found.append([x for _, x in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(checks, pa.int32()), pa.array(lines, pa.list_(pa.int32())),
                 pa.array(found, pa.list_(pa.int64()))], [*TEXT, "line", "template"])

    packed = docs.select(*_text_key(), text_or_empty()).mapInArrow(
        run, "text_id long, text_check int, line array<int>, template array<long>")
    return packed.select(*TEXT, F.explode(F.arrays_zip("line", "template")).alias("x")).select(*TEXT, "x.line", "x.template")


def recurring_templates(parsed: DataFrame, min_texts: int | None = None) -> DataFrame:
    """(template) of all templates in at least ``min_texts`` distinct texts, by default as MIN_TEXTS says."""
    by_size = F.element_at(F.array(*(F.lit(n) for _, n in MIN_TEXTS)), F.col("template").bitwiseAND(3).cast("int") + 1)
    need = by_size if min_texts is None else F.lit(min_texts)
    each = parsed.select("template", *TEXT).distinct()  # dealt by template and text: no template is hot
    return each.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("template")


def dedup_lines(docs: DataFrame, min_texts: int | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, n_lines, n_dropped, dropped (line numbers from 0), kept.

    A template recurs in ``min_texts`` distinct texts, by default in as many as MIN_TEXTS asks for its length.
    Lines are split at ``\\n``.  A line without words is never dropped.  ``kept`` is the text without its dropped
    lines, joined by ``\\n``; a null text stays null and has 0 lines.  Equal texts count once for a template, so
    copies of one document don't make its lines recurring; repeated rows and ids are treated alike.  Further
    columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    parsed = stage(_parsed(docs), "lines")
    common = stage(recurring_templates(parsed, min_texts), "templates")
    few = common.count() <= BROADCAST_ROWS
    hits = parsed.join(F.broadcast(common) if few else common, "template").select(*TEXT, "line")
    hits = stage(hits.groupBy(*TEXT).agg(F.collect_set("line").alias("dropped")), "dropped-lines")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, dropped in zip(*(c.to_pylist() for c in b.columns)):
                lines = [] if text is None else text.split("\n")
                gone = set(dropped or ())
                kept = text if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone)
                out.append((i, len(lines), len(gone), sorted(gone), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             ["doc_id", "n_lines", "n_dropped", "dropped", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_text_key())
    # hits grow with the corpus, so texts are dealt by hash at every size; adaptive skew joins split a group of copies
    return texts.join(hits.hint("merge"), list(TEXT), "left").select("doc_id", "text", "dropped").mapInArrow(
        apply, "doc_id long, n_lines long, n_dropped long, dropped array<int>, kept string")
