import random

import pytest
from helpers import DOC, awkward, with_extra

from staytrail.llm import decontam

BENCH = "item_id long, text string, doc_id long, start long"


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def flat(text):
    out = ""
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        out += low if c.isalnum() else ("" if not out or out.endswith(" ") else " ")
    return out


def windows(text):
    t = flat(text).removesuffix(" ")
    last = max(0, len(t) - 64)
    return [t[s:s + 64] for s in sorted({*range(0, last + 1, 32), last})] if len(t) >= 30 else []


def edited(rnd, text, n):
    x = list(text)
    for _ in range(n):
        k = rnd.randrange(len(x))
        x[k:k + rnd.choice([0, 1])] = rnd.choice(["", "q", "e"])
    return "".join(x)


def case(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcdefg hij,. Klm") for _ in range(n))
    items = [(i, make(rnd.choice([20, 40, 70, 150, 300]))) for i in range(12)]
    docs = []
    for i in range(60):
        t = make(rnd.randrange(200))
        if rnd.random() < 0.6:
            x = rnd.choice(items)[1]
            x = edited(rnd, x, rnd.choice([0, 1, 3, 8])).upper() if rnd.random() < 0.8 else x[rnd.randrange(10):len(x) * 2 // 3]
            t += x.replace(" ", rnd.choice([" ", "\n", " - "])) + make(rnd.randrange(100))
        docs.append((i, t, "en", "s", 1))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_alignments(seed):
    docs, items = case(seed)
    index = decontam.build_index(items)
    found = 0
    for _, text, *_ in docs:
        want = {}
        for item, passage in items:
            hits = [distance(w, flat(text)) for w in windows(passage)]
            hits = [d for d, w in zip(hits, windows(passage)) if d <= int(len(w) * 0.05)]
            if hits:
                want[item] = (len(windows(passage)), len(hits), min(hits))
        got = {m[0]: m[1:4] for m in decontam.find_items(text, index)}
        assert got == want
        found += len(want)
    assert found > 10


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = case(4)
    bench = spark.createDataFrame([(i, t, None, None) for i, t in items] + [(99, None, None, None), (None, items[3][1], None, None)], BENCH)
    whole = sorted(map(str, decontam.find_contamination(spark.createDataFrame(docs, DOC), bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    blocks = decontam.find_contamination(spark.createDataFrame(docs, DOC), bench)
    assert sorted(map(str, blocks.collect())) == whole and whole
    dirty = {r.doc_id for r in blocks.collect()}
    assert sorted(r.doc_id for r in decontam.clean_rows(spark.createDataFrame(docs, DOC), bench).collect()) == [
        d[0] for d in docs if d[0] not in dirty]


def test_places(spark):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(200)).strip()
    text = "İntro text. " + passage.upper() + "; and an end"
    (r,) = decontam.find_contamination(spark.createDataFrame([(7, text, "en", "s", 1)], DOC),
                                       spark.createDataFrame([(3, passage, None, None)], BENCH)).collect()
    assert (r.doc_id, r.item_id, r.n_edits, r.n_matched) == (7, 3, 0, r.n_windows)
    assert text[r.start:r.end].lower() == passage


def test_awkward_rows(spark):
    rows = awkward()
    bench = spark.createDataFrame([(1, rows[3][1][100:400], None, None), (2, "", None, None), (3, None, None, None)], BENCH)
    docs = with_extra(spark, rows)
    dirty = [r for r in rows if rows[3][1][200:300] in (r[1] or "")]
    assert len(dirty) == 2
    got = decontam.find_contamination(docs, bench).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in dirty)
    clean = decontam.clean_rows(docs, bench)
    assert clean.schema == docs.schema and clean.count() == len(rows) - 2


def test_empty(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "a text " * 20, "en", "s", 1)], DOC)
    assert decontam.find_contamination(none, bench).collect() == []
    assert decontam.find_contamination(some, bench).collect() == [] and decontam.clean_rows(some, bench).count() == 1


@pytest.mark.parametrize("seed", [5, 6])
def test_excerpts_of_64_characters_are_found_at_every_offset(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcdefghij klm") for _ in range(n))
    items = [(i, make(250)) for i in range(5)]
    index = decontam.build_index(items, complete=True)
    for item, text in items:
        plain = flat(text).strip()
        for s in range(len(plain) - 63):
            excerpt = plain[s:s + 64]
            got = {m[0] for m in decontam.find_items("before it. " + excerpt + " and behind", index)}
            assert got == {item}, s
            if excerpt[0] != " " and excerpt[-1] != " ":
                (m,) = decontam.find_items("Before it: " + excerpt, index)
                assert excerpt in ("Before it: " + excerpt)[m[4]:m[5]] and m[3] == 0


def test_short_items_are_matched_whole_at_word_borders(spark):
    bench = [(1, "Who wrote it, and when?"), (2, "yes"), (3, "12345 67890 abc"), (4, " The quick, red fox "), (5, "who WROTE it and when")]
    texts = ["who wrote it - and WHEN", "somewho wrote it and when", "who wrote it and whenever", "x 12345 67890 abc", "12345 67890 abcd",
             "yes", "a (the Quick  red fox) b", "", None, "the quick red foxes"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)
    got = decontam.find_contamination(docs, spark.createDataFrame([(*b, None, None) for b in bench], BENCH)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (0, 5), (3, 3), (6, 4)]
    assert all((r.n_windows, r.n_matched, r.n_edits) == (1, 1, 0) for r in got)
    assert {texts[r.doc_id][r.start:r.end] for r in got} == {"who wrote it - and WHEN", "12345 67890 abc", "the Quick  red fox"}


def test_complete_results_hold_the_windows_results():
    docs, items = case(7)
    plain, complete = decontam.build_index(items), decontam.build_index(items, complete=True)
    for _, text, *_ in docs:
        few = {m[0]: m for m in decontam.find_items(text, plain)}
        many = {m[0]: m for m in decontam.find_items(text, complete)}
        assert few.keys() <= many.keys()
        exact = {i for i, x in items if any(flat(x).strip()[s:s + 64] in flat(text) for s in range(max(1, len(flat(x).strip()) - 63)))
                 and len(flat(x).strip()) >= 64}
        assert exact <= many.keys()
        assert many.keys() - few.keys() <= exact | {i for i, x in items if len(flat(x).strip()) < 30}
