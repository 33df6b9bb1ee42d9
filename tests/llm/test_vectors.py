"""Vector code compression against a plain version that looks at every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from staytrail.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    sizes = [len(r[1]) for r in kept]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    ends = [0]
    for i in range(parts):
        ends.append(ends[-1] + dim // parts + (i < dim % parts))
    cut = [[v[a:b] for v in ints] for a, b in zip(ends, ends[1:])]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for c, book in zip(cut, books):
            code = [nearest(v, book)[1] for v in c]
            for i in range(len(book)):
                members = [v for v, k in zip(c, code) if k == i]
                if members:
                    book[i] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(v, book) for v in c] for c, book in zip(cut, books)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, r in enumerate(kept):
        out.append([r[0], "".join(f"{f[i][1]:02x}" for f in found), sum(f[i][0] for f in found), r[2]])
    for o in out:
        o.append(sum(x[2] for x in out if x[3] == o[3]))
    return sorted(((o[0], o[1], o[2], o[4], digest) for o in out), key=repr)


def table(seed, n, dim, spread):
    rnd = random.Random(seed)
    return [(i * 3 % n, [rnd.randint(-spread, spread) / 1024 for _ in range(dim)], rnd.choice([None, 1, 1, 2])) for i in range(n)]


AWKWARD = [(None, [0.5] * 8, 1), (None, [0.5] * 8, 1), (5, None, 1), (6, [0.1] * 7 + [None], 1), (7, [float("nan")] * 8, 2),
           (8, [float("inf")] + [0.0] * 7, 2), (9, [], 2), (10, [0.25] * 12, 2), (11, [0.0] * 8, None), (11, [0.0] * 8, None)]


@pytest.mark.parametrize("rows,entries", [
    (table(1, 120, 8, 2000) + AWKWARD, 16),
    (table(2, 150, 8, 2) + AWKWARD, 32),  # many equal distances and repeated entries
    (table(3, 60, 10, 500), 256),  # fewer rows than entries, parts of unequal lengths
    ([(1, [-0.1, 3.0, 0.0, 2.0], None)], 256),
])
def test_equals_brute_force(spark, rows, entries):
    got = vectors.compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, entries=entries)


def test_empty_and_extra_columns(spark):
    assert vectors.compress_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vectors.compress_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    rows = table(4, 30, 8, 100)
    more = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA + ", vector int, code string, error long, dim string")
    assert sorted(map(tuple, vectors.compress_vectors(more, entries=4).collect()), key=repr) == brute(rows, entries=4)


def test_search_visits_less_than_all_and_is_exact():
    rng = np.random.default_rng(3)
    entries = rng.integers(-500, 500, (256, 4))
    rows = entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4))
    book = vectors.Codebook(entries)
    looked = []
    walk = book._walk

    def counted(group, rows, entries, at, best, visited):
        moved = walk(group, rows, entries, at, best, visited)
        looked.append(visited)
        return moved

    book._walk = counted
    code, gap = book.nearest(rows)
    every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (gap == every.min(axis=1)).all()
    assert looked[-1].mean() < 0.7  # lists end beyond twice the distance


def test_huge_components_stay_in_range(spark):
    rows = [(i, [3e38, -3e38, float(i), 0.0], 1) for i in range(5)]
    got = vectors.compress_vectors(spark.createDataFrame(rows, SCHEMA), entries=2).collect()
    assert len(got) == 5 and all(0 <= r["error"] for r in got)
