import random
import re

from helpers import DOC, awkward, prose, with_extra
from pyspark.sql import functions as F

from staytrail.llm import lines

VARIABLE = re.compile(r"[0-9@]|://|[A-Za-z+/=_-]{24}")


def brute_templates(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    m = tuple("<*>" if VARIABLE.search(x) else x for x in w)
    n, constant, out = len(w), sum(x != "<*>" for x in m), set()
    if n and constant >= min(n, 3):
        out.add((n, "all", m))
    head, rest = m[:2], m[2:]
    if len(rest) >= 4:
        for k in range(4):
            i, j = len(rest) * k // 4, len(rest) * (k + 1) // 4
            if sum(x != "<*>" for x in head + rest[:i] + rest[j:]) >= max(3, n // 2):
                out.add((n, k, head + rest[:i] + rest[j:]))
    return out


def brute(rows, least):
    texts = {t for _, t, *_ in rows if t is not None}
    count = {}
    for t in texts:
        for x in {x for line in t.split("\n") for x in brute_templates(line)}:
            count[x] = count.get(x, 0) + 1
    out = []
    for i, t, *_ in rows:
        ls = [] if t is None else t.split("\n")
        gone = [k for k, line in enumerate(ls) if any(count[x] >= least for x in brute_templates(line))]
        kept = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out.append((str(i), len(ls), len(gone), gone, str(kept)))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(80):
        ls = [prose(rnd, rnd.randrange(0, 15), 50).replace("0", "o").replace("1", "l") for _ in range(rnd.randrange(4))]
        letters = lambda n: "".join(rnd.choice("abcdefg") for _ in range(n))
        ls.append(f"posted on {rnd.randrange(1990, 2030)}-01-{rnd.randrange(28)} by user{rnd.randrange(999)} in the forum")
        if i % 2:
            ls.append(f"all rights of {letters(5)} reserved by the owner of this page")
        if i % 5 == 0:
            ls.append("share  this\tpage")
        rnd.shuffle(ls)
        rows.append((i, "\n".join(ls), "en", "s", 1))
    return rows + [(100 + i, "copied line of one text " + "word " * 3, "en", "s", 1) for i in range(30)]


def result(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.dropped, str(r.kept)) for r in df.collect())


def test_recurring_templates_go(spark):
    rows = corpus(1)
    got = result(lines.dedup_lines(spark.createDataFrame(rows, DOC), 10))
    assert got == brute(rows, 10)
    kept = {r[0]: r[4] for r in got}
    assert not any("posted on" in t or "all rights" in t or "share" in t for t in kept.values())
    assert "copied line" in kept["100"]  # copies of one text are no recurrence


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    rows = awkward() + corpus(2)
    assert result(lines.dedup_lines(with_extra(spark, rows), 6)) == brute(rows, 6)


def test_long_lines_need_fewer_texts(spark):
    rnd = random.Random(5)
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    unspaced = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(120))  # 360 bytes, one word
    numbers = [" ".join(["total of all"] + [str(rnd.randrange(10**6)) for _ in range(60)]) for _ in range(3)]
    cases = [(60, 2, True), (20, 2, False), (20, 3, True), (10, 4, False), (10, 5, True), (4, 9, False), (4, 10, True)]
    rows = []
    for c, (n, texts, _) in enumerate(cases):
        line = letters(n)
        rows += [(100 * c + j, f"{letters(9)}\n{line}", "en", "s", 1) for j in range(texts)]
    rows += [(2000 + j, f"{letters(9)}\n{unspaced}", "en", "s", 1) for j in range(2)]
    rows += [(3000 + j, f"{letters(9)}\n{x}", "en", "s", 1) for j, x in enumerate(numbers)]
    got = {r.doc_id: r.dropped for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got[2000] == [1] and got[3000] == []  # three constant words are no long template
    for c, (n, texts, gone) in enumerate(cases):
        assert all(got[100 * c + j] == [1] * gone for j in range(texts)), (n, texts)


def test_verbatim_lines_of_variable_words(spark):
    same = ["Page 3 of 10", "Copyright 2024 Acme", "https://share.example/x?id=77", "editor@example.org", "17"]
    rows = [(i, "\n".join([f"own line of text {chr(97 + i)} here", *same, f"Page {i} of 99", f"https://own.example/{i}"]), "en", "s", 1)
            for i in range(10)]
    rows.append((50, "Page 3  of\t10\nPage 3 of 11", "en", "s", 1))
    got = {r.doc_id: r.dropped for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert all(set(got[i]) >= {1, 2, 3, 4, 5} and not {6, 7} & set(got[i]) for i in range(10)) and got[50] == [0]


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOC)).collect() == []


def test_texts_of_one_first_hash_are_told_apart(spark, monkeypatch):
    """With a first hash that is the same for all texts, the second one alone keeps every text's lines its own."""
    shared = "all rights to this very page stay with its many authors"
    rows = [(i, f"only text {chr(97 + i)} says {chr(97 + i) * 3} here\n" * (i % 3) + shared) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.dropped, r.kept) for r in lines.dedup_lines(df, 10).collect())
    assert [d for _, d, _ in want] == [[i % 3] for i in range(14)]
    second = lambda: [F.lit(1).cast("long").alias("text_id"), F.hash("text").alias("text_check")]
    monkeypatch.setattr(lines, "_text_key", second)
    assert sorted((r.doc_id, r.dropped, r.kept) for r in lines.dedup_lines(df, 10).collect()) == want
