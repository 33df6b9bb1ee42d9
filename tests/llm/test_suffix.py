import hashlib
import random

import pytest
from helpers import DOC, awkward, prose, with_extra

from staytrail.llm import suffix


def brute(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), [None] * len(rows)
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = [x for x in bytes(gone).split(b"\0") if x]
        out[i] = (-1 if rows[i][0] is None else rows[i][0], len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    passages = [prose(rnd, n) for n in (14, 30, 30, 60)] + ["ab " * 60, "x" * 230, "é😀" * 40]
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randrange(1, 40))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            parts += [p if rnd.random() < 0.6 else p[rnd.randrange(20):], prose(rnd, rnd.randrange(1, 20))]
        rows.append((i * 13 % 101, rnd.choice(["", " ", "\n"]).join(parts), "en", "s", 1))
    return rows + [(200 + i, rows[i][1], "en", "s", 1) for i in range(5)]


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 50_000), (3, 3)])
def test_removed_bytes(spark, seed, hot):
    rows = corpus(seed)  # with hot=3 most repeated keys are dealt out by single strings
    df = suffix.remove_repeats(spark.createDataFrame(rows, DOC).repartition(5), hot_keys=hot)
    assert result(df) == sorted(brute(rows))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", 0)
    rows = [r for r in awkward()]
    assert result(suffix.remove_repeats(with_extra(spark, rows).coalesce(1))) == sorted(brute(rows))


def test_texts_and_spans(spark):
    rows = corpus(4)
    text = {i: t.encode() for i, t, *_ in rows}
    for r in suffix.remove_repeats(spark.createDataFrame(rows, DOC), with_text=True).collect():
        data, at, kept = text[r.doc_id], 0, b""
        for i, j in r.spans:
            kept, at = kept + data[at:i], j
        kept += data[at:]
        assert bytes(r.kept) == kept and hashlib.sha256(kept).hexdigest() == r.kept_sha256
        assert sum(j - i for i, j in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion(seed):
    import numpy as np

    rnd = random.Random(seed)
    length, letters = rnd.choice([8, 10, 33, 40]), rnd.choice([b"ab", b"abcd", b"abcdefghij"])
    segments = [bytes(rnd.choice(letters) for _ in range(rnd.randint(length, 3 * length))) for _ in range(rnd.randint(1, 8))]
    passage = bytes(rnd.choice(letters) for _ in range(2 * length))
    segments = list(dict.fromkeys(s[:5] + passage + s[5:] if rnd.random() < 0.5 else s for s in segments))
    gone = [bytearray(len(s)) for s in segments]
    for d, i, j in suffix.repeats(segments, np.arange(len(segments)), np.zeros(len(segments), np.int64), length):
        gone[d][i:j - 1 + length] = b"\1" * (j - 1 + length - i)
    seen = set()
    for s, g in zip(segments, gone):
        want = bytearray(len(s))
        for p in range(len(s) - length + 1):
            if s[p:p + length] in seen:
                want[p:p + length] = b"\1" * length
            seen.add(s[p:p + length])
        assert g == want


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], DOC)).collect() == []
