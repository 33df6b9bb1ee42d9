import hashlib
import random
import zlib

import pytest
from helpers import DOC, awkward, prose, with_extra

from staytrail.llm import sharding


def smallest_capacity(sizes, shards):
    def needed(c):
        used, now = 1, 0
        for s in sizes:
            if s > c:
                return shards + 1
            if now + s > c:
                used, now = used + 1, 0
            now += s
        return used

    c = max(sizes)
    while needed(c) > shards:
        c += 1
    return c


@pytest.mark.parametrize("seed,n,shards", [(1, 40, 8), (2, 5, 8), (3, 200, 3), (4, 30, 1), (5, 60, 8)])
def test_minimax(spark, seed, n, shards):
    rnd = random.Random(seed)
    rows = [(hashlib.sha256(b"%d" % i).hexdigest(), rnd.choice([1, 2, 5, 40, 300 if seed == 5 else 7])) for i in range(n)]
    ends = sharding.prefix_sums(spark.createDataFrame(rows, "g string, size long"))
    capacity, cuts = sharding.minimax_cuts(ends, shards)
    ordered = sorted(rows)
    assert capacity == smallest_capacity([s for _, s in ordered], shards)
    sums = [0] * shards
    for g, s in ordered:
        sums[sum(g > c for c in cuts)] += s
    assert max(sums) == capacity and len(cuts) < shards


def test_documents(spark):
    rows = awkward()
    out = [r.asDict() for r in sharding.shard_documents(with_extra(spark, rows), 4).collect()]
    assert len(out) == len(rows)
    crc = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == crc
    where = {}
    for r in out:
        where.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in where.values()) and set(where) <= set(range(4))


def test_equal_texts_share_a_shard_and_a_hot_group_fills_one(spark):
    rnd = random.Random(3)
    hot = prose(rnd, 40)
    rows = [(i, hot if i % 3 == 0 else prose(rnd, 10), "en", "s", 1) for i in range(120)]
    out = sharding.shard_rows(spark.createDataFrame(rows, DOC), 4).select("text", "shard", "slot").collect()
    shard = {}
    for r in out:
        assert shard.setdefault(r.text, r.shard) == r.shard
    groups = {}
    for _, t, *_ in rows:
        h = hashlib.sha256(t.encode()).hexdigest()
        groups[h] = groups.get(h, 0) + len(t.encode()) + 1
    load = {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + len(r.text.encode()) + 1
    assert max(load.values()) == smallest_capacity([groups[h] for h in sorted(groups)], 4)


def test_rows_keep_columns_and_replace_clashes(spark):
    docs = with_extra(spark, awkward())
    out = sharding.shard_rows(docs, 2)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert out.count() == docs.count() and dict(out.dtypes)["shard"] == "int"


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert sharding.shard_documents(none).collect() == []
    assert sharding.shard_rows(none).collect() == []
