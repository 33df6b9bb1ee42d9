"""Exact removal of repeated byte strings with a Burrows-Wheeler transform.

A string of LENGTH bytes is judged by all its occurrences in the corpus, so these must meet in one task, and no task
may see everything.  Each string has a key that only its own bytes decide: the smallest hash among its grams of GRAM
bytes.  Neighbouring strings of a document mostly share their key and travel together as one segment.

1. Keys seen only once are dropped: every task counts its own keys first and sends each key once.
2. Documents with repeated keys send the segments of those keys, equal ones once a task.
3. Each bucket of keys builds the suffix order of its distinct segments to LENGTH bytes and from it the transform.
   Intervals of equal prefixes are expanded breadth-first by backward extension: every round finds the boundaries
   of the next larger common prefix, and the rounds stop at LENGTH.  Suffixes without a boundary between them then
   share at least LENGTH bytes; all but the earliest of them are repeats.
4. The bytes that repeats cover are merged per document and cut out.

Copies of a whole text are one class from the start: only its first row takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ranked, shuffle_partitions, stage, text_or_empty

LENGTH = 100
GRAM = 32
MOST_STRINGS = 128          # strings in a segment at most
HOT_KEYS = 50_000           # a key with more segments is dealt out by its single strings
HOT_MOST = 1_000_000        # so many hot keys (8 bytes each) are sent to every task at most, about
BUCKET_BYTES = 1 << 19      # bytes of segments in a bucket, about: many small ones fill the tasks evenly
COMBINE_BYTES = 48 << 20    # segments that a task holds back to combine equal ones
BROADCAST_ROWS = 500_000    # keys (16 bytes each) that may be broadcast to thin out texts before they move
RUN = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "<u2"), ("places", "<u2")])

_rng = np.random.Generator(np.random.PCG64(2024))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """RUNs (key, first string, strings, places) that cover all strings of ``length`` bytes of the text, in order;
    places is 2 if the text has the key's gram at more than one place, else 1."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < length:
        return np.empty(0, RUN)
    h, size = _BYTE[b], 1
    while size < gram:  # gram is a power of two
        h = h[:-size] * _STEP[size.bit_length()] + h[size:]
        size *= 2
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    span, size, least = length - gram + 1, 1, h
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(b) - length + 1
    least = np.minimum(least[:n], least[span - size:span - size + n])
    # a gram is a key if it is the least of some string, that is, equals the greatest of the least around it
    edge = np.zeros(span - 1, np.uint64)
    most, size = np.concatenate([edge, least, edge]), 1
    while size * 2 <= span:
        most = np.maximum(most[:-size], most[size:])
        size *= 2
    most = np.maximum(most[:len(h)], most[span - size:span - size + len(h)])
    keys, count = np.unique(h[h == most], return_counts=True)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(new[1:], n)
    if (ends - new).max() > MOST_STRINGS:  # a periodic stretch: cut at multiples from its start
        pieces = -(-(ends - new) // MOST_STRINGS)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.minimum(np.repeat(new, pieces) + (at + 1) * MOST_STRINGS, np.repeat(ends, pieces))
        new = np.repeat(new, pieces) + at * MOST_STRINGS
    out = np.empty(len(new), RUN)
    out["key"], out["start"], out["n"] = least[new], new, ends - new
    out["places"] = np.minimum(count[np.searchsorted(keys, out["key"])], 2)
    return out


def string_classes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A class for each position of ``text`` (symbols; 0 ends a segment): positions whose next ``length`` symbols hold
    no 0 share their class if and only if these symbols are equal."""
    n = len(text)
    # suffix order by the next ``length`` symbols: ranks of 7 symbols, then of twice as many, the last overlapping
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    key, size = np.zeros(n, np.uint64), 7
    for j in range(7):
        key = (key << np.uint64(9)) | padded[j:j + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if size >= length or rank[order[-1]] == n - 1:
            break
        ahead = min(size, length - size)
        after = np.zeros(n, np.int64)
        after[:n - ahead] = rank[ahead:] + 1
        key = (rank * (n + 1) + after).astype(np.uint64)
        size += ahead
    before = text[order - 1]                               # the transform
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)                           # where a suffix goes when its preceding symbol is put first
    back[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last_same, next_same = np.full(n, -1), np.full(n, n)   # the same symbol's neighbours in the transform
    last_same[by_symbol[1:][same]] = by_symbol[:-1][same]
    next_same[by_symbol[:-1][same]] = by_symbol[1:][same]
    boundary = np.zeros(n + 1, bool)                       # before rank i: the common prefix is shorter than length
    boundary[n] = True
    left, right = np.array([0]), np.array([n])
    for common in range(length):                           # the common prefix at the boundaries found in this round
        sizes = right - left
        inside = np.repeat(left - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        low = back[inside[last_same[inside] < np.repeat(left, sizes)]]
        high = back[inside[next_same[inside] >= np.repeat(right, sizes)]] + 1
        low.sort()                                         # extended intervals are disjoint: sorted ends pair up
        high.sort()
        new = ~boundary[high]
        if common:
            new &= text[order[low]] != 0                   # no symbol sequence over a segment's end
        else:
            new[-1:] |= True                               # the last symbol's interval ends where the text does
        left, right = low[new], high[new]
        boundary[right] = True
        if not len(left):
            break
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(boundary[:n])
    return classes


def repeats(segments: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc, first, end): strings of ``length`` bytes starting at first..end-1 that also start earlier, by (doc, start)."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.zeros(ends[-1], np.uint16)
    valid = np.zeros(ends[-1], bool)
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:] = data
    text += 1
    text[ends - 1] = 0
    first = ends - sizes - 1
    classes = string_classes(text, length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(len(text)) - first[owner]
    valid = offset <= sizes[owner] - length
    at = np.flatnonzero(valid)
    doc, start, c = docs[owner[at]], starts[owner[at]] + offset[at], classes[at]
    order = np.lexsort((start, doc, c))
    c, d, s = c[order], doc[order], start[order]
    head = np.concatenate([[True], c[1:] != c[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))
    later = (d != d[lead]) | (s != s[lead])                # the same place may come in two segments
    d, s = d[later], s[later]
    return merge_starts(d, s)


def merge_starts(docs: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of consecutive starts as (doc, first, end)."""
    if not len(docs):
        return []
    order = np.lexsort((starts, docs))
    d, s = docs[order], starts[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)])
    at = np.flatnonzero(new)
    return list(zip(d[at].tolist(), s[at].tolist(), (s[np.append(at[1:], len(s)) - 1] + 1).tolist()))


def _repeated_keys(docs: DataFrame, length: int, hot_keys: int) -> DataFrame:
    """(th, runs, hot): per text the runs whose key the corpus holds at two places at least; rows with a null th name
    keys with many places instead.  A text may come in several rows."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = 4 * parts

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's runs, by bucket of key: one of each key, with how many places the task has for it."""
        seen: set[int] = set()
        ths, runs = [], []
        for b in batches:
            for th, t in zip(b.column(0).to_pylist(), b.column(1)):
                if th not in seen:
                    seen.add(th)
                    r = key_runs(t.as_py().encode("utf-8", "surrogatepass"), length)
                    if len(r):
                        ths.append(th)
                        runs.append(r)
        if not runs:
            return
        doc = np.repeat(np.array(ths, np.int64), [len(r) for r in runs])
        run = np.concatenate(runs)
        order = np.argsort(run["key"], kind="stable")
        doc, run = doc[order], run[order]
        head = np.flatnonzero(np.concatenate([[True], run["key"][1:] != run["key"][:-1]]))
        many = np.add.reduceat(run["places"].astype(np.int64), head)
        count = np.diff(np.append(head, len(run)))
        yield _by_text(doc[np.repeat(many, count) > 1], run[np.repeat(many, count) > 1], buckets)
        doc, run, count = doc[head], run[head], many
        bucket = (run["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            at = order[cuts[k]:cuts[k + 1]]
            if len(at):
                yield _row(k, None, b"".join((np.array([len(at)], "<i8").tobytes(), doc[at].tobytes(), run[at].tobytes(),
                                              count[at].astype("<i8").tobytes())))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            ds, rs, cs = zip(*held)
            doc, run, count = np.concatenate(ds), np.concatenate(rs), np.concatenate(cs)
            order = np.lexsort((run["start"], doc, run["key"]))
            doc, run, count = doc[order], run[order], count[order]
            key = run["key"]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            place = head | np.concatenate([[True], (doc[1:] != doc[:-1]) | (run["start"][1:] != run["start"][:-1])])
            group = np.cumsum(head) - 1
            places = np.bincount(group, weights=place)
            total = np.bincount(group, weights=count)
            many = (places > 1) | (np.maximum.reduceat(count, np.flatnonzero(head)) > 1)
            pick = many[group] & place & (count == 1)      # others were sent by their own task already
            yield _by_text(doc[pick], run[pick], 1)
            hot = key[head][total >= hot_keys]
            if len(hot):
                yield _row(0, None, hot.astype("<u8").tobytes())

        for b in batches:
            passed = []
            for k, th, data in zip(*(c.to_pylist() for c in b.columns)):
                if th is not None:
                    passed.append((th, data))
                    continue
                if k != now:
                    if held:
                        yield from done()
                    now, held = k, []
                n = int(np.frombuffer(data, "<i8", 1)[0])
                held.append((np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, RUN, n, 8 + 8 * n),
                             np.frombuffer(data, "<i8", n, 8 + 24 * n)))
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(passed), pa.int64()), pa.array([p[0] for p in passed], pa.int64()),
                                                  pa.array([p[1] for p in passed], pa.binary())], ["bucket", "th", "runs"])
        if held:
            yield from done()

    kind = "bucket long, th long, runs binary"
    return (docs.select("th", "text").mapInArrow(own, kind).repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(meet, kind).select("th", "runs"))


def _row(bucket: int, th: int | None, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([th], pa.int64()), pa.array([data], pa.binary())],
                                      ["bucket", "th", "runs"])


def _by_text(doc: np.ndarray, run: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a text with its runs; the bucket only spreads the rows."""
    order = np.argsort(doc, kind="stable")
    doc, run = doc[order], run[order]
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    ends = np.append(head[1:], len(doc))
    ths = doc[head]
    return pa.RecordBatch.from_arrays([
        pa.array(ths % buckets, pa.int64()), pa.array(ths, pa.int64()),
        pa.array([run[i:j].tobytes() for i, j in zip(head, ends)], pa.binary())], ["bucket", "th", "runs"])


def _segments(texts: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """(key, doc, start, end, segment) from (doc, runs, text): the segments of repeated keys, equal ones once a task;
    where the segment is null, the strings start..end-1 are repeats of one that the task has sent."""
    spread = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = spread.value
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        out: list[tuple] = []
        seen: set[int] = set()
        size = 0

        def batch(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                              ["key", "doc", "start", "end", "segment"])

        def flush():
            rows = [(k, *at, s) for (k, s), at in held.items()]
            held.clear()
            for i in range(0, len(rows), 20_000):
                yield batch(rows[i:i + 20_000])

        for b in batches:
            for doc, lists, text in zip(*(c.to_pylist() for c in b.columns)):
                if doc in seen:
                    continue
                seen.add(doc)
                data = text.encode("utf-8", "surrogatepass")
                runs = np.unique(np.concatenate([np.frombuffer(x, RUN) for x in lists]))
                runs = runs[np.argsort(runs["start"])]
                known = np.isin(runs["key"], hot) if len(hot) else np.zeros(len(runs), bool)
                copies: list[tuple[int, int]] = []
                places = zip(runs["key"].view(np.int64).tolist(), runs["start"].tolist(), runs["n"].tolist(), known.tolist())
                for key, start, n, often in places:
                    pieces = ([(xxhash.xxh3_64_intdigest(data[i:i + length]) - 2**63, i, i + 1) for i in range(start, start + n)]
                              if often else [(key, start, start + n)])
                    for k, i, j in pieces:
                        s = data[i:j - 1 + length]
                        first = held.get((k, s))
                        if first is None:
                            held[k, s] = (doc, i, j)
                            size += len(s) + 150
                        elif first[:2] < (doc, i):
                            copies.append((i, j))
                        else:
                            out.append((first[0], *first, None))
                            held[k, s] = (doc, i, j)
                merged: list[list[int]] = []
                for i, j in copies:
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(j, merged[-1][1])
                    else:
                        merged.append([i, j])
                out += [(doc, doc, i, j, None) for i, j in merged]
                if size > COMBINE_BYTES:
                    yield from flush()
                    size = 0
            if out:
                yield batch(out)
                out = []
        yield from flush()

    return texts.mapInArrow(run, "key long, doc long, start long, end long, segment binary")


def _judged(segments: DataFrame, buckets: int, length: int) -> DataFrame:
    """(doc, start, end): strings that are repeats, from the segments of ``_segments``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: dict[bytes, tuple[int, int]] = {}
        out: list[tuple[int, int, int]] = []

        def done():
            places = list(held.values())
            return repeats(list(held), np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64), length)

        for b in batches:
            for bucket, doc, start, end, segment in zip(*(c.to_pylist() for c in b.columns)):
                if segment is None:
                    out.append((doc, start, end))
                    continue
                if bucket != now:
                    if held:
                        out += done()
                    now, held = bucket, {}
                first = held.setdefault(segment, (doc, start))
                if first != (doc, start):
                    if first > (doc, start):
                        held[segment], (doc, start) = (doc, start), first
                    out.append((doc, start, start + len(segment) - length + 1))
            if out:
                yield spans(out)
                out = []
        if held:
            out += done()
        if out:
            yield spans(out)

    def spans(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc", "start", "end"])

    dealt = segments.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "doc", "start", "end", "segment")
    return (dealt.repartition(shuffle_partitions(segments.sparkSession), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "doc long, start long, end long"))


def cut(data: bytes, starts: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """(the bytes that stay, the maximal removed runs) for runs of starts of repeats."""
    spans: list[list[int]] = []
    for i, j in sorted(starts):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j - 1 + length)
        else:
            spans.append([i, j - 1 + length])
    kept, at = [], 0
    for i, j in spans:
        kept.append(data[at:i])
        at = j
    kept.append(data[at:])
    return b"".join(kept), [(i, j) for i, j in spans]


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (rid, doc_id, n_bytes, digest, th) are written; texts are (dk, th, text).  th is a 64-bit
    hash of the text under the first seed for which no two texts of this table share it."""
    text = text_or_empty()
    for seed in range(100):
        th = F.xxhash64(F.lit(seed), text)
        rows = stage(docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
            F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"), th.alias("th")), "texts")
        clash = rows.groupBy("th").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b")
        if clash.isEmpty():
            return rows, docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("dk"), th.alias("th"), text.alias("text"))
    raise ValueError("no seed tells all texts apart")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` also spans (array of [start, end) byte offsets) and kept (the remaining bytes).  ``length`` is at
    least twice GRAM; ``hot_keys`` only decides how work is dealt out.

    Every byte is removed that a string of ``length`` bytes covers which also starts earlier: in a row with a
    smaller doc_id or earlier in the same row.  Null ids come last; rows with equal ids count in the order in which
    they are read.  Matches don't cross rows.  Null and empty texts have 0 bytes and lose nothing, nor do texts
    shorter than ``length``; a later copy of a longer text is removed whole.  Further columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, texts = _keyed(docs)
    rows = ranked(rows, [F.col("doc_id").asc_nulls_last(), F.col("rid").asc()], "seq", "order")
    rows = stage(rows, "ordered")
    classes = stage(rows.groupBy("th").agg(F.min("seq").alias("seq")), "classes")
    firsts = stage(rows.join(classes.select("seq"), "seq").select("seq", F.xxhash64("doc_id").alias("dk"), "th", "n_bytes"), "firsts")

    # a segment holds some 35 strings, so that at most HOT_MOST keys can have more segments than this
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    found = stage(_repeated_keys(texts, length, max(hot_keys, size // 35 // HOT_MOST)), "runs")
    hot = [np.frombuffer(bytes(r["runs"]), "<u8") for r in found.filter("th is null").toLocalIterator()]
    hot = np.sort(np.concatenate(hot)) if hot else np.empty(0, np.uint64)
    runs = stage(found.filter("th is not null").groupBy("th").agg(F.collect_list("runs").alias("lists"))
                 .join(firsts.drop("n_bytes"), "th"), "lists")
    volume = runs.select(F.sum(F.aggregate("lists", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    buckets = max(1, -(-volume // RUN.itemsize * (length + 35) // BUCKET_BYTES))

    segments = _segments(_thinned(texts, runs.select("dk", "th")).join(runs, ["dk", "th"]).select("seq", "lists", "text"), hot, length)
    starts = _judged(segments, buckets, length)
    cuts = stage(starts.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("starts")), "cuts")
    cuts = cuts.withColumnRenamed("doc", "seq").join(firsts, "seq").select("dk", "th", "seq", "starts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, starts, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8", "surrogatepass")
                kept, spans = cut(data, [(s["start"], s["end"]) for s in starts], length)
                out.append((seq, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            [list(s) for s in spans] if with_text else None, kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             ["seq", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    changed = _thinned(texts, cuts.select("dk", "th")).join(cuts, ["dk", "th"]).select("seq", "starts", "text").mapInArrow(
        apply, "seq long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary")
    changed = stage(changed.dropDuplicates(["seq"]), "changed")
    copies = rows.join(classes.withColumnRenamed("seq", "first"), "th")
    out = copies.join(changed, "seq", "left")
    copy = (F.col("seq") != F.col("first")) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    none = F.array().cast("array<array<long>>")
    out = out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", none)).alias("spans"),
           F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "th"] if with_text else []))
    if not with_text:
        return out
    whole = texts.select("th", F.encode("text", "UTF-8").alias("whole")).dropDuplicates(["th"])
    return out.join(whole, "th").withColumn("kept", F.coalesce("kept", "whole")).drop("th", "whole")


def _thinned(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` without rows that ``keys`` (dk, th) doesn't name, if the keys are few enough to be broadcast."""
    if keys.count() > BROADCAST_ROWS:
        return texts
    return texts.join(F.broadcast(keys), ["dk", "th"], "left_semi")
