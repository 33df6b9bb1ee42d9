import random
from collections import Counter

import corpus_pipeline
import zstandard
from helpers import DOC, awkward, components, prose, shingles, with_extra

from staytrail.llm import decontam, quality
from staytrail.llm.queries import ORACLE_SQL, QUERIES


def corpus(seed):
    rnd = random.Random(seed)
    bench = [(i, prose(rnd, 30)) for i in range(5)]
    rows = []
    for i in range(150):
        t = prose(rnd, rnd.randrange(20, 200))
        if i % 10 == 0:
            t += " " + rnd.choice(bench)[1]
        if i % 15 == 1:
            t = "again and again " * 60
        rows.append((i, t, "en", rnd.choice(["a", "b", "b", "b", None]), len(t)))
    for i in range(40):
        w = rows[i][1].split()
        w[len(w) // 2] = "edited" if i % 2 else w[len(w) // 2]
        rows.append((1000 + i, " ".join(w), "en", "c", 1))
    return rows, bench


def brute(rows, bench):
    """What the stages before mixing keep: (doc_id, text)."""
    c = zstandard.ZstdCompressor(level=3)
    kept = [r for r in rows if quality.judge(r[1], c)[6]]
    sets = [shingles(r[1]) for r in kept]
    root = components(len(kept), [(a, b) for a in range(len(kept)) for b in range(a)
                                  if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    best = {}
    for i, r in enumerate(kept):
        best[root[i]] = min(best.get(root[i], i), i, key=lambda k: kept[k][0])
    kept = [kept[i] for i in sorted(best.values())]
    texts = [" ".join(t.split()) for _, t in bench]
    return [r for r in kept if not any(t in r[1] for t in texts)]


def test_run(spark, tmp_path):
    rows, bench = corpus(1)
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = brute(rows, bench)
    assert 60 < len(clean) < 140
    assert {(r.doc_id, r.text) for r in out} <= {(r[0], r[1]) for r in clean}
    taken = Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
    total = Counter()
    for r in clean:
        total[r[3]] += len(r[1].split())
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) < 200 * len(total)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, "nothing of this " * 5), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (with_extra(spark, awkward()), with_extra(spark, [])):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(tmp_path))
            if name != "sharding":
                assert out.columns == docs.columns, name
            if docs.isEmpty():
                assert out.isEmpty(), name
            assert out.count() >= 0


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert decontam.MATCHES.startswith("doc_id long, item_id long")
