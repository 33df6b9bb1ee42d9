"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are normalised (letters lower-cased, everything else than letters and digits one space).  Every benchmark item
is cut into overlapping windows of WINDOW characters; a document is contaminated by an item if it holds one of its
windows with at most ERRORS of its length in edits.  By the q-gram lemma such a place shares at least
m - q + 1 - k * q grams with the window, all on k + 1 neighbouring diagonals: shared grams are counted in overlapping
bands of diagonals, and the few regions that reach the bound are aligned in a band.  Row-local over the documents;
the benchmark is gone through in blocks of bounded size.

Windows for edits are laid every STRIDE characters.  Exact excerpts need no luck with that: every run of WINDOW
characters of an item, at any offset, is known by its hash and compared.  Items too short for windows are matched whole,
at word borders and without edits.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Q = 12
WINDOW, STRIDE = 64, 32
ERRORS = 0.05
MIN_CHARS = 30             # shorter items have no windows; they are matched whole
MIN_SHORT = Q              # items under so many normalised characters (a word or two) name no passage
BLOCK_CHARS = 2_000_000    # of the benchmark sent to every task at a time

MATCHES = "doc_id long, item_id long, n_windows long, n_matched long, n_edits long, start long, end long"
_STEP = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _lowered() -> np.ndarray:
    """Code point -> its lower case if it is a letter or digit, else a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalnum():
            y = x.lower()
            table[c] = ord(y) if len(y) == 1 else c
    return table


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their places in the text)."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low = _lowered()[cp]
    word = low != 32
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of a run of others stays, as a space
    at = np.flatnonzero(keep)
    return low[at], at


def gram_hashes(cp: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash for each run of q code points."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = {1: cp.astype(np.uint64) * _STEP[7]}
    size = 1
    while size * 2 <= q:
        x = powers[size]
        powers[size * 2] = x[:-size] * _STEP[size.bit_length()] + x[size:]
        size *= 2
    h, at = None, 0
    for size in sorted(powers, reverse=True):
        if at + size <= q:
            part = powers[size][at:at + n]
            h = part if h is None else h * _STEP[6] + part
            at += size
    h = h ^ (h >> np.uint64(31))
    return h * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """The windows of a block of benchmark items and the postings of their grams."""
    items: list        # item_id of each window
    windows: list      # text of each window
    total: dict        # item number -> windows
    owner: list        # item number of each window
    grams: np.ndarray  # sorted distinct gram hashes
    first: np.ndarray  # of their postings
    post_window: np.ndarray
    post_offset: np.ndarray
    edits: np.ndarray  # allowed for each window
    least: np.ndarray  # shared grams needed
    filter: np.ndarray
    shift: np.uint64
    excerpts: "Excerpts | None" = None
    short: object = None  # an automaton with item number and id of each short item


@dataclass
class Excerpts:
    """Every run of WINDOW characters of the items, by hash."""
    hashes: np.ndarray  # sorted, repeated for each place
    owner: np.ndarray   # item number of the place
    offset: np.ndarray  # where it starts in its item
    texts: dict         # item number -> code points
    ids: dict           # item number -> item_id
    filter: np.ndarray
    shift: np.uint64


def _bitmap(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    bits = max(16, int(len(hashes)).bit_length() + 6)
    shift = np.uint64(64 - bits)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[hashes >> shift] = True
    return bitmap, shift


def build_index(items: list[tuple[int, str | None]], complete: bool = False) -> Index:
    """The index of a block of items; ``complete`` adds excerpts at every offset and short items."""
    ids, windows, owner, total = [], [], [], {}
    hashes, of, offset = [], [], []
    texts, short = {}, {}
    for number, (item, text) in enumerate(items):
        cp, _ = normalise(text)
        if len(cp) and cp[-1] == 32:
            cp = cp[:-1]
        if len(cp) < MIN_CHARS:
            if len(cp) and cp[0] == 32:
                cp = cp[1:]
            if len(cp) >= MIN_SHORT:
                short.setdefault(f" {_text(cp)} ", []).append((number, item))
            continue
        last = max(0, len(cp) - WINDOW)
        starts = sorted({*range(0, last + 1, STRIDE), last})
        total[number] = len(starts)
        texts[number] = cp
        for s in starts:
            part = cp[s:s + WINDOW]
            h = gram_hashes(part)
            hashes.append(h)
            of.append(np.full(len(h), len(windows)))
            offset.append(np.arange(len(h)))
            ids.append(item)
            owner.append(number)
            windows.append(_text(part))
    if windows:
        h, w, o = np.concatenate(hashes), np.concatenate(of), np.concatenate(offset)
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        m = np.array([len(x) for x in windows])
        edits = (m * ERRORS).astype(np.int64)
        index = Index(ids, windows, total, owner, grams, np.append(first, len(h)), w[order], o[order], edits,
                      m - Q + 1 - edits * Q, *_bitmap(grams))
    else:
        none = np.empty(0, np.int64)
        index = Index([], [], {}, [], np.empty(0, np.uint64), none, none, none, none, none, np.zeros(2, bool), np.uint64(63))
    if complete:
        index.excerpts = _excerpts(texts, dict(enumerate(item for item, _ in items)))
        if short:
            index.short = ahocorasick.Automaton()
            for text, numbers in short.items():
                index.short.add_word(text, (len(text), numbers))
            index.short.make_automaton()
    return index


def _text(cp: np.ndarray) -> str:
    return cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _excerpts(texts: dict, ids: dict) -> Excerpts | None:
    runs = {n: gram_hashes(cp, WINDOW) for n, cp in texts.items() if len(cp) >= WINDOW}
    if not runs:
        return None
    hashes = np.concatenate(list(runs.values()))
    owner = np.repeat(np.array(list(runs)), [len(h) for h in runs.values()])
    offset = np.concatenate([np.arange(len(h)) for h in runs.values()])
    order = np.argsort(hashes, kind="stable")
    return Excerpts(hashes[order], owner[order], offset[order], texts, ids, *_bitmap(hashes))


def find_excerpts(cp: np.ndarray, found: Excerpts) -> dict[int, tuple[int, int]]:
    """Item number -> outer bounds of its runs of WINDOW characters that the text holds."""
    h = gram_hashes(cp, WINDOW)
    place = np.flatnonzero(found.filter[h >> found.shift]) if len(h) else np.empty(0, np.int64)
    low, high = (np.searchsorted(found.hashes, h[place], side) for side in ("left", "right"))
    bounds: dict[int, tuple[int, int]] = {}
    seen: dict[bytes, tuple[int, int]] = {}
    for p, a, b in zip(place.tolist(), low.tolist(), high.tolist()):
        if a == b:
            continue
        run = cp[p:p + WINDOW].tobytes()
        if run in seen:  # a run that was met before: only the bounds of its items grow
            seen[run] = (seen[run][0], p + WINDOW)
        else:
            seen[run] = (p, p + WINDOW)
    for run, (start, end) in seen.items():
        key = gram_hashes(np.frombuffer(run, cp.dtype), WINDOW)
        a, b = (int(np.searchsorted(found.hashes, key, side)[0]) for side in ("left", "right"))
        for n, o in zip(found.owner[a:b].tolist(), found.offset[a:b].tolist()):
            if found.texts[n][o:o + WINDOW].tobytes() == run:
                old = bounds.get(n, (start, end))
                bounds[n] = min(old[0], start), max(old[1], end)
    return bounds


def banded_distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``pattern`` in ``text`` if it needs at most ``most`` edits, else None.

    Only diagonals on which the whole pattern fits, and ``most`` on either side, are worked out.
    """
    found = text.find(pattern)
    if found >= 0:
        return 0, found + len(pattern)
    m, n = len(pattern), len(text)
    width = max(0, n - m) + 2 * most + 1  # diagonals j - i from -most to n - m + most
    far = most + 1
    row = [0 if 0 <= d - most <= n else far for d in range(width)]
    for i in range(1, m + 1):
        c, new = pattern[i - 1], [far] * width
        for d in range(width):
            j = i + d - most
            if j < 0 or j > n:
                continue
            best = row[d] + (text[j - 1] != c) if j else i
            if d + 1 < width and row[d + 1] + 1 < best:
                best = row[d + 1] + 1
            if d and new[d - 1] + 1 < best:
                best = new[d - 1] + 1
            new[d] = best if best < far else far
        row = new
        if min(row) == far:
            return None
    best, at = min(((v, m + d - most) for d, v in enumerate(row) if 0 <= m + d - most <= n), default=(far, 0))
    return (best, at) if best <= most else None


def find_items(text: str | None, index: Index) -> list[tuple]:
    """(item_id, windows, matched, fewest edits, start, end) of each item that contaminates the text; start and end
    are the outer bounds of its matches in the text's characters."""
    cp, at = normalise(text)
    found = {n: (item, *rest) for n, item, *rest in _find_windows(cp, index)}
    if index.excerpts:
        for n, (begin, end) in find_excerpts(cp, index.excerpts).items():
            item, windows, matched, _, low, high = found.get(n, (index.excerpts.ids[n], index.total[n], 0, 0, begin, end))
            found[n] = item, windows, matched, 0, min(low, begin), max(high, end)
    if index.short and len(cp):
        lead = int(cp[0] != 32)  # a space before the first word and behind the last
        for last, (size, numbers) in index.short.iter(" " * lead + _text(cp) + " "):
            end = min(last - lead, len(cp))
            begin = last - lead - size + 2
            for n, item in numbers:
                low, high = found[n][4:] if n in found else (begin, end)
                found[n] = item, 1, 1, 0, min(low, begin), max(high, end)
    return [(item, windows, matched, edits, int(at[begin]), int(at[end - 1]) + 1)
            for _, (item, windows, matched, edits, begin, end) in sorted(found.items())]


def _find_windows(cp: np.ndarray, index: Index) -> list[tuple]:
    """(item number, item_id, windows, matched, fewest edits, start, end) by windows, in normalised characters."""
    if not index.windows:
        return []
    h = gram_hashes(cp)
    place = np.flatnonzero(index.filter[h >> index.shift]) if len(h) else np.empty(0, np.int64)
    if not len(place):
        return []
    known = np.searchsorted(index.grams, h[place])
    known[known == len(index.grams)] = 0
    hit = index.grams[known] == h[place]
    place, known = place[hit], known[hit]
    if len(place) < index.least.min():
        return []
    lengths = index.first[known + 1] - index.first[known]
    post = np.repeat(index.first[known] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    window, offset = index.post_window[post], index.post_offset[post]
    start = np.repeat(place, lengths) - offset + WINDOW  # never negative
    step = index.edits[window] + 1
    bands = len(cp) + 2 * WINDOW + 2
    keys, counts = np.unique(window.astype(np.int64) * bands + start // step, return_counts=True)
    w, band = keys // bands, keys % bands
    both = counts.copy()  # of a band and the next one
    follows = np.flatnonzero((w[1:] == w[:-1]) & (band[1:] == band[:-1] + 1))
    both[follows] += counts[follows + 1]
    enough = np.flatnonzero(both >= index.least[w])
    if not len(enough):
        return []
    whole = _text(cp)
    known_places: dict[tuple[str, str], tuple[int, int] | None] = {}  # repeated wording is aligned once
    found: dict[int, dict[int, int]] = defaultdict(dict)
    bounds: dict[int, list[int]] = {}
    for x, b in zip(w[enough].tolist(), band[enough].tolist()):
        k, pattern = int(index.edits[x]), index.windows[x]
        low = max(0, b * (k + 1) - WINDOW - k)
        high = min(len(whole), (b + 2) * (k + 1) - WINDOW + len(pattern) + k)
        region = pattern, whole[low:high]
        if region not in known_places:
            known_places[region] = banded_distance(*region, k)
        got = known_places[region]
        if got:
            item = index.owner[x]
            found[item][x] = min(got[0], found[item].get(x, got[0]))
            end = low + got[1]
            begin = max(0, end - len(pattern))
            span = bounds.setdefault(item, [begin, end])
            span[0], span[1] = min(span[0], begin), max(span[1], end)
    return [(item, index.items[next(iter(ws))], index.total[item], len(ws), min(ws.values()), *bounds[item])
            for item, ws in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of about BLOCK_CHARS."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).dropDuplicates()
        yield sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES: a row for each row of ``docs`` (``doc_id``, ``text``) and each item of ``benchmark`` (``item_id``,
    ``text``) that it holds a passage of.

    n_windows are the item's (a short item counts as one), n_matched those found, n_edits the fewest of a match; start and
    end bound the matches in characters of the text.  An item known only by an exact excerpt has n_matched 0 and n_edits 0.
    Clean documents have no row.  Null and empty texts match nothing, nor do items of fewer than MIN_SHORT normalised
    characters; shorter ones than MIN_CHARS match whole, at word borders.  Repeated rows and items are reported each (equal items once);
    null ids stay null; further columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [x.strip().split()[0] for x in MATCHES.split(",")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(build_index(block, complete=True))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for m in find_items(t.as_py(), index.value)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names)

        out = out.unionByName(narrow.mapInArrow(run, MATCHES))
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, with their columns unchanged; nulls as above."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = docs.columns.index("text")
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(build_index(block, complete=True))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not find_items(t.as_py(), index.value) for t in b.column(text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
