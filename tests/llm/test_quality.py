import random
import zlib
from collections import Counter

import zstandard
from helpers import DOC, WORD, awkward, prose, with_extra

from staytrail.llm import quality

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup, seen = 0, set()
    for line in (text or "").split("\n") if text else []:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked),
            len(w) < 50 or 100 * len(marked) > 50 * len(w))


def test_base_counts(spark):
    rnd = random.Random(1)
    texts = [None, "", "\n\n", " a b \x0b\x0c c\r\n", "x y z " * 40, "a b c a b c a b", "l1 w\nl1 w\n l1 w\n\n\nl1 w", "<a> | #*$%&\n" * 3]
    texts += ["".join(rnd.choice(["a ", "b ", "c", "\n", "\t", "é ", "# "]) for _ in range(rnd.randrange(300))) for _ in range(200)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in quality.score_quality(with_extra(spark, rows)).collect()}
    for i, t in enumerate(texts):
        assert tuple(out[i][c] for c in BASE) == brute(t), t


def test_verdicts(spark):
    rnd = random.Random(2)
    clean = {n: prose(rnd, n, 3000) for n in (60, 120, 500, 3000, 12000)}
    words = [prose(rnd, 30).split() for _ in range(3)]
    # repetitive, but no three-word window comes twice often enough for the base rule
    shuffled = " ".join(" ".join(rnd.sample(words[0], 30)) for _ in range(400))
    noise = " ".join("".join(chr(rnd.randrange(33, 0x2FFF)) for _ in range(8)) for _ in range(3000))
    half = clean[3000] + " " + " ".join(w * 60 for w in prose(rnd, 300).split())
    texts = [*clean.values(), shuffled, noise, half]
    kept = [r.kept for r in quality.score_quality(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC))
            .orderBy("doc_id").collect()]
    assert kept == [True] * len(clean) + [False] * 3


def test_ratios_are_of_whole_text_and_full_chunks():
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    data = b"abcdefgh" * 2000
    whole, bad, full = quality.ratios(data, c)
    assert whole == len(c.compress(data)) / len(data) and full == len(data) // quality.CHUNK == bad
    assert quality.ratios(b"", c) == (None, 0, 0)


def test_rows_pass_unchanged(spark):
    docs = with_extra(spark, awkward())
    scores = [r.kept for r in quality.score_quality(docs).collect()]
    kept = quality.keep_quality(docs)
    assert kept.schema == docs.schema
    want = [str(r) for r, k in zip(docs.collect(), scores) if k]
    assert sorted(map(str, kept.collect())) == sorted(want)


def test_tail_and_share_of_bad_chunks():
    c, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(6)
    size = quality.CHUNK

    def text(*kinds, tail=0):
        clean, noise = (lambda n: prose(rnd, n // 5 + 1, 3000)[:n]), "".join(chr(rnd.randrange(33, 127)) for _ in range(size))
        return "".join(clean(size) if k else noise for k in kinds) + noise[:tail]

    assert quality.judge(text(1), c)[8:] == (0, 1) and quality.judge(text(0), c)[8:] == (1, 1)
    assert quality.judge(text(1, 1, tail=4000), c)[8:] == (1, 3)  # the tail is a chunk of its own
    assert quality.judge(text(1, 1, 1, 1, tail=0), c)[8:] == (0, 4)
    assert not quality.judge(text(1, 0, 1, 0, 1, 1), c)[6] and quality.judge(text(1, 1, 1, 0, 1, 1), c)[6]
    assert not quality.judge(text(*[1] * 17, *[0] * 3), c)[6] and quality.judge(text(*[1] * 18, *[0] * 2), c)[6]


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert quality.score_quality(none).collect() == [] and quality.keep_quality(none).collect() == []


def test_limits_decide_between_clean_and_padded_text():
    """Few words in ever new order: the base rules pass them, only the ratio tells."""
    c, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(3)
    for n in (200, 400, 900, 2000, 6000):
        vocabulary = prose(rnd, 60, 40).split()
        low = " ".join(rnd.choice(vocabulary) for _ in range(n))
        out = quality.judge(low, c)
        assert not out[5] and not out[6], n
    for n in (60, 150, 400, 900, 2000, 6000):
        assert quality.judge(prose(rnd, n, 3000), c)[6], n


def test_letters_of_several_bytes_are_not_repetition():
    """The same words in letters of two bytes get the same verdict."""
    c, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(4)
    wide = str.maketrans({chr(97 + i): chr(0x430 + i) for i in range(26)})
    for n in (150, 900, 6000):
        assert quality.judge(prose(rnd, n, 3000).translate(wide), c)[6], n


def plain_kept(text, limits):
    """The verdict in plain steps."""
    n, _, _, _, repeated, failed = brute(text)
    if failed:
        return False
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    data = text.encode()
    whole = [b for b in limits.whole if b[0] <= len(data)]
    if whole and not (whole[-1][1] <= size(data) / len(text) and size(data) / len(data) <= whole[-1][2]):
        return False
    parts = [data[i:i + 4096] for i in range(0, len(data) - 4095, 4096)] if len(data) >= 4096 else []
    if parts and len(data) % 4096:
        parts.append(data[-4096:])
    if not parts:
        return True
    _, low, high, share = [c for c in limits.chunks if c[0] <= len(parts)][-1]
    bad = sum(not low * len(text) / len(data) <= size(p) / 4096 <= high for p in parts)
    return bad <= share * len(parts)


def labelled(n=900, seed=8):
    """Clean prose, and texts of few words in ever new order that the base rules pass."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        size, poor = rnd.choice([70, 150, 400, 900, 2500]), i % 6 == 0
        words = prose(rnd, 150, 60).split() if poor else None
        docs.append((i, " ".join(rnd.choice(words) for _ in range(size)) if poor else prose(rnd, size, 3000), "en", "s", 1))
        labels.append((i, int(not poor), 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_fitted_limits_decide_as_plain_steps(spark):
    docs, labels = labelled()
    odd = [(None, 1, 0), (3, None, 0), (7, 0, 0), (10 ** 9, 1, 0)]
    limits = quality.fit_limits(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + odd, LABELS))
    rows = docs + [(5000 + i, *r[1:]) for i, r in enumerate(awkward())]
    got = {r.doc_id: r.kept for r in quality.score_quality(with_extra(spark, rows), limits).collect()}
    assert got == {r[0]: plain_kept(r[1], limits) for r in rows}
    held = [(got[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0 and not brute(docs[i][1])[5]]
    clean, poor = [k for k, q in held if q], [k for k, q in held if not q]
    assert len(clean) > 100 and sum(clean) >= 0.98 * len(clean)
    assert len(poor) > 20 and sum(poor) < 0.2 * len(poor)
    assert limits != quality.NEUTRAL


def test_limits_are_quantiles_of_clean_ratios(spark):
    docs, labels = labelled(600, seed=9)
    limits = quality.fit_limits(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABELS))
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    edge = quality.EDGES[:-1]
    for k in range(len(edge)):
        lo, hi = quality.EDGES[max(k - 1, 0)] if k else 0, quality.EDGES[min(k + 2, len(quality.EDGES) - 1)]
        texts = [d[1] for d, y in zip(docs, labels) if y[1] and zlib.crc32(str(d[0]).encode()) % 5 and not brute(d[1])[5]
                 and lo <= len(d[1].encode()) < hi]
        if len(texts) < quality.TOGETHER:
            continue
        found = sorted(round(len(c.compress(t.encode())) / len(t), 4) for t in texts)
        at = quality.BEYOND * (len(found) - 1)
        low = found[0] + (found[1] - found[0]) * at
        assert abs(limits.whole[k][1] - (low - quality.BELOW)) < 1e-6, edge[k]


def test_all_labelled_rows_count(spark):
    """Limits are the quantiles of every clean row, also of more than 20,000."""
    rnd = random.Random(10)
    words = prose(rnd, 400, 300).split()
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(55, 200))), "en", "s", 1)
            for i in range(26_000)]
    limits = quality.fit_limits(spark.createDataFrame(docs, DOC), spark.createDataFrame([(d[0], 1, 0) for d in docs], LABELS))
    c, by = zstandard.ZstdCompressor(level=quality.LEVEL), {}
    for i, text, *_ in docs:
        if zlib.crc32(str(i).encode()) % 5 and not brute(text)[5]:
            k = max(j for j, e in enumerate(quality.EDGES) if e <= len(text))
            by.setdefault(k, []).append(round(len(c.compress(text.encode())) / len(text), 4))
    assert sum(map(len, by.values())) > 20_000
    for k, found in by.items():
        if len(found) >= quality.ALONE:
            at = quality.BEYOND * (len(found) - 1)
            found.sort()
            low = found[int(at)] + (found[int(at) + 1] - found[int(at)]) * (at - int(at))
            assert abs(limits.whole[k][1] - (low - quality.BELOW)) < 1e-6, k


def test_joined_ratios_give_what_broadcast_ids_give(spark):
    docs, labels = labelled(600, seed=11)
    docs, labels = spark.createDataFrame([*docs, docs[1], (None, *docs[1][1:])], DOC), spark.createDataFrame(labels, LABELS)
    few = quality.fit_limits(docs, labels)
    assert quality.fit_limits(docs, labels, broadcast_ids=0) == few != quality.NEUTRAL


def test_no_labels_give_neutral_limits(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), DOC)
    assert quality.fit_limits(docs, spark.createDataFrame([], LABELS)) == quality.NEUTRAL
    assert quality.fit_limits(docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)) == quality.NEUTRAL
    assert quality.limits_of(docs, f"{tmp_path}/none.parquet") == quality.NEUTRAL


def test_chunks_reject_what_the_whole_passes():
    c, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(12)
    poor = prose(rnd, 8, 400).split()
    text = prose(rnd, 5000, 3000) + " " + " ".join(rnd.choice(poor) for _ in range(2500))
    n, *_, failed, kept, whole, bad, chunks = quality.judge(text, c)
    band = quality.band_of(quality.NEUTRAL.whole, len(text.encode()))
    assert not failed and band[1] <= whole <= band[2] and not kept and bad > chunks / 8
