import random

import numpy as np
import pytest
from helpers import DOC, awkward, components, prose, shingles, with_extra

from staytrail.llm import graph, minhash


def brute(rows, num=80):
    sets = [shingles(t) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = components(len(rows), links)
    first = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            first[root[i]] = min(doc, first.get(root[i], doc))
    return [(rows[i][0], len(sets[i]), first.get(root[i]) if sets[i] else rows[i][0]) for i in range(len(rows))], root, sets


def corpus(seed, families=6, members=12):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        w = prose(rnd, rnd.choice([7, 12, 40, 150])).split()
        for _ in range(members):
            x = list(w)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                i = rnd.randrange(len(x))
                x[i:i + rnd.choice([0, 1, 2])] = [prose(rnd, 1)]
            if rnd.random() < 0.3:
                w = x  # drift: chains whose ends are not similar
            text = "  ".join(x)
            rows.append((len(rows) * 7 % 1009, text.upper() if rnd.random() < 0.1 else text, "en", "s", 1))
    return rows + [(2000 + i, prose(rnd, n), "en", "s", 1) for i, n in enumerate([0, 1, 2, 4, 4, 5, 6, 60])]


def key(row):
    return tuple(-1 if v is None else v for v in row)


@pytest.mark.parametrize("seed,limit,num", [(1, 4_000_000, 85), (2, 4_000_000, 80), (1, 300, 85), (2, 300, 80)])
def test_components(spark, monkeypatch, seed, limit, num):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", limit)  # at 300 most blocks go through the rounds of pivots
    monkeypatch.setattr(minhash, "ROUND_PIVOTS", 5)
    rows = corpus(seed)
    found = minhash.near_duplicates(with_extra(spark, rows), threshold=(num, 100))
    got = found.select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, num)[0]))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)  # texts move by key
    rows = awkward()
    got = minhash.near_duplicates(with_extra(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)[0]))


def test_one_row_of_each_group_stays(spark):
    rows = awkward() + [(500 + r[0], *r[1:]) for r in corpus(3, 3, 6)]
    docs = with_extra(spark, rows)
    kept = minhash.dedup_rows(docs)
    assert kept.columns == docs.columns
    found, root, sets = brute(rows)
    groups = {}
    for i, r in enumerate(root):
        if sets[i]:
            groups.setdefault(r, set()).add((rows[i][0], rows[i][1]))
    out = [(r.doc_id, r.text) for r in kept.collect()]
    words = [x for x in out if shingles(x[1])]
    assert len(words) == len(groups)
    assert all(sum(x in g for x in words) == 1 for g in groups.values())
    first = {r: min((d is None, d or 0) for d, _ in g) for r, g in groups.items()}
    assert sorted((d is None, d or 0) for d, _ in words) == sorted(first.values())
    assert len(out) - len(words) == sum(not s for s in sets)


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (850, 75, 75))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    assert minhash.banding((80, 100)) == (41, 6) and minhash.banding((85, 100)) == (40, 8)
    same = sum(p == q for p, q in zip(minhash.band_hashes(x, 40, 8), minhash.band_hashes(y, 40, 8)))
    assert 4 <= same <= 24  # 40 * 0.85 ** 8 = 11 are expected
    assert minhash.band_hashes(x, 40, 8) == minhash.band_hashes(x[::-1], 40, 8)
    assert not set(minhash.band_hashes(a, 40, 8)) & set(minhash.band_hashes(shared, 40, 8))


def test_graph(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = components(400, links)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    used = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: least[root[i]] for i in used}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert minhash.near_duplicates(none).collect() == [] and minhash.dedup_rows(none).collect() == []
