"""Importance resampling: the position-table CRC against zlib, the draw against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOC, awkward, with_extra

from staytrail.llm import resample

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = "item_id long, text string"


def plain_runs(text):
    w = PLAIN_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(plain_runs(x)[1])
    for x in target:
        t.update(plain_runs(x)[1])
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for doc_id, x in docs:
        words, runs = plain_runs(x)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in runs)
        weight = total // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(runs), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= least),
                  key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest", [3, 127, 128, 129, 256, 257, 2000, 70000])
def test_span_crcs(longest):
    rnd = random.Random(longest)
    data = bytes(rnd.randrange(256) for _ in range(80000))
    spans = [(a, a + rnd.randint(1, longest)) for a in (rnd.randrange(10000) for _ in range(50))] + [(0, longest), (7, 7 + longest)]
    got = resample.span_crcs(np.frombuffer(data, np.uint8), *np.array(spans).T)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert resample.span_crcs(np.frombuffer(data, np.uint8), np.array([], int), np.array([], int)).tolist() == []


@pytest.mark.parametrize("piece", [1, 100, 1 << 18])
def test_runs_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    texts = ["Ab c-d ÉÈ 12 x", None, "", " ,. ", "one", "日本語、テキスト " * 50 + "x" * 3000, "a b c", "Tail\x00of\x7fit"]
    got = {i: [] for i in range(len(texts))}
    for numbers, crcs in resample.runs(texts):
        for i, crc in zip(numbers.tolist(), crcs.tolist()):
            got[i].append(crc % 10000)
    assert [sorted(got[i]) for i in got] == [sorted(plain_runs(t)[1]) for t in texts]


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = awkward() + [(100 + i, " ".join(rnd.choice(["alpha", "beta", "gamma", "x" * 200]) for _ in range(rnd.randint(15, 40))), "en", "s", 1)
                        for i in range(60)]
    target = [(1, "alpha beta alpha beta gamma"), (2, None), (3, rows[1][1]), (4, "")]
    got = resample.resample(with_extra(spark, rows).repartition(5), spark.createDataFrame(target, TARGET))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in rows], [t for _, t in target])
    assert {r["rank"] for r in got.collect()} - {None} == set(range(1, got.filter("rank is not null").count() + 1))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(awkward(2), DOC), spark.createDataFrame([], TARGET)
    assert resample.resample(spark.createDataFrame([], DOC), none).collect() == []
    assert sorted(map(tuple, resample.resample(docs, none).collect()), key=repr) == brute([r[:2] for r in awkward(2)], [])


def test_draw_leans_to_the_target(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"{'q' if i % 2 else 'z'}{rnd.randrange(50)}" for _ in range(40)), "en", "s", 1) for i in range(300)]
    target = [(i, " ".join(f"q{rnd.randrange(50)}" for _ in range(40))) for i in range(40)]
    drawn = resample.resample(spark.createDataFrame(rows, DOC), spark.createDataFrame(target, TARGET)).filter("rank is not null")
    assert drawn.count() == 75 and drawn.filter("doc_id % 2 = 1").count() > 60
