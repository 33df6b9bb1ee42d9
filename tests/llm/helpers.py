"""Small tables with all the awkward rows, and brute-force versions that share no code with the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, shard string, kept boolean, row string, part long, target double, g string, th long, rid long, _t string, words int"


def prose(rnd, n, vocabulary=400):
    return " ".join(f"{rnd.choice('abcdefghijklmnop')}{rnd.choice('aeiou')}{rnd.randrange(vocabulary):x}" for _ in range(n))


def awkward(seed=1):
    """Rows of DOC: nulls in every column, empty and blank texts, repeated rows, repeated ids, copies, a long text."""
    rnd = random.Random(seed)
    base = [prose(rnd, n) for n in (3, 60, 120, 300, 80)]
    near = base[3].split()
    near[100] = "changed"
    rows = [(10 + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[1], "en", "s1", 1), (21, " ".join(near), "en", None, 1), (22, None, None, None, None), (23, "", "en", "s0", 0),
             (24, " \n\t ", "en", "s0", 4), (None, base[2], "en", "s2", 1), (None, None, None, None, None), (25, "Ünï ©ode ñ 😀 " * 30, "xx", "ü", 1),
             (26, prose(rnd, 20000), "en", "s1", 1), (12, "another text under a used id " + prose(rnd, 70), "en", "s0", 1)]
    return rows + [rows[1], rows[8], rows[8]]


def with_extra(spark, rows, schema=DOC):
    """The rows with further columns whose names the operators use inside."""
    n = len(EXTRA.split(",")) - 1
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], schema + EXTRA)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])
