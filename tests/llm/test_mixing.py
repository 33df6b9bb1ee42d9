import math
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from helpers import DOC, WORD, awkward, prose, with_extra

from staytrail.llm import mixing
from staytrail.llm.queries import OP7_SQL


def targets(sizes):
    """By the letter: share by weight, stop at twice the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(spark, rows):
    out = mixing.mix_documents(with_extra(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(dict(sizes))
    got = defaultdict(int)
    source = {}
    for s, n in sizes.items():
        source.setdefault((n, round(want[s], 3)), s)
    for r in out:
        s = source[r.source_size, round(r.target, 3)]
        got[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    return sizes, want, got


def test_targets_and_budgets(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.choice([1, 5, 30, 200])), "en", rnd.choice(["a", "b", "B", "ä", "z", None, "hot", "hot", "hot"]), 1) for i in range(300)]
    rows += [(1000, prose(rnd, 2), "en", "tiny", 1), (1001, None, "en", "void", 1)]
    sizes, want, got = check(spark, rows)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(got[s] - math.floor(want[s] + 1e-6)) <= 1


def test_awkward_rows(spark):
    rows = awkward()
    sizes, want, got = check(spark, rows)
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)


def test_sql_and_reruns_agree(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(40)), "en", rnd.choice(["x", "y", "yy", None, "q"]), 1) for i in range(200)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs = spark.createDataFrame(rows, DOC)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(tuple(r) for r in mixing.mix_documents(docs.repartition(7)).select(cols).collect())
    assert got == sorted(tuple(r) for r in mixing.mix_documents(docs.coalesce(1)).select(cols).collect())
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({OP7_SQL})").fetchall())


def test_whole_rows(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 20), "en", rnd.choice(["a", "b", "b", "b", None]), 1) for i in range(200)]
    docs = with_extra(spark, rows)
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert set(n.values()) <= {1, 2}
    want = targets({s: 20 * sum(r[3] == s for r in rows) for s in ("a", "b", None)})
    for s in want:
        assert abs(20 * sum(n[r[0]] for r in rows if r[3] == s) - want[s]) <= 20


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert mixing.mix_documents(none).collect() == [] and mixing.mix_rows(none).collect() == []
