"""Toxicity: features by hand, terms against a plain count, held-out accuracy on planted texts."""

import random
import zlib
from collections import Counter
from math import log, sqrt

import pytest
from helpers import DOC, awkward, with_extra

from staytrail.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def feature(text, name, weights=None):
    return toxicity.Reader(weights or {}).features(text)[toxicity.NAMES.index(name)]


def test_features_by_hand():
    assert len(toxicity.NAMES) == len(toxicity.Reader({}).features(None)) == len(toxicity.Reader({" a ": 1.0}).features("a b"))
    assert toxicity.Reader({}).features(None) == toxicity.Reader({}).features("")
    assert feature("You are an IDIOT, really", "abuse_density") == 1 / 5
    assert feature("you are an idiot", "near_second") == 1 / 4
    assert feature("you " + "x " * 20 + "idiot", "near_second") == 0
    assert feature("AB abc", "capitals") == 2 / 5
    assert feature("GO AWAY now", "shouted") == 1 / 3
    assert feature("what?! no!!", "bursts") == 1  # two runs over two words
    for hidden in ("1d10t", "i d i o t", "iiidiot", "st*pid 1diot"):
        assert feature(f"such {hidden} there", "hidden_abuse") > 0, hidden
    for plain in ("covid 19 and mp3 files", "on 3 may 2024", "a b c"):
        assert feature(plain, "hidden_abuse") == 0, plain
    weights = {" grum": 2.0, " grumpo ": 3.0, "zle ": 1.5}
    assert feature("The Grumpo, grumble and puzzle", "term_density", weights) == 3 / 5
    assert feature("The Grumpo, grumble and puzzle", "term_weight", weights) == (3.0 + 2.0 + 1.5) / 5
    assert feature("x grumpo grumpo", "term_kinds", weights) == 1 and feature("x grumpo grumpo", "term_top", weights) == 3.0
    assert feature("The grum", "term_density", {" grumb": 1.0}) == 0


@pytest.mark.parametrize("text,words", [("", " "), ("A", " a "), ("..a b", " a b "), ("One, TWO\n3 x_y ", " one two x y "), ("ÉCOLE日本 é", " école日本 é ")])
def test_spaced(text, words):
    got, gaps = toxicity.spaced(text)
    assert got == words and [i for i, c in enumerate(words) if c == " "] == gaps.tolist()


def test_terms_equal_a_plain_count(spark):
    rnd = random.Random(3)
    rows = [(" ".join([f"w{rnd.choice('abcdefgh')}{rnd.choice('xyz')}" for _ in range(30)] + ([f"grum{rnd.choice('abcdef')}" * (i % 4 > 0)] if i % 5 == 0 else [])),
             int(i % 5 == 0)) for i in range(200)] + [(None, 1), ("", 0)]
    got = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int").repartition(4))
    n = Counter(y for _, y in rows)
    counts = Counter((t, y) for x, y in rows for t in toxicity.terms(toxicity.spaced(x or "")[0]))
    expected = {}
    for term in {t for t, y in counts if y}:
        a, b = counts[term, 1] + 0.5, counts[term, 0] + 0.5
        odds = log(a / (n[1] + 1)) - log(b / (n[0] + 1))
        if counts[term, 1] >= toxicity.MIN_TEXTS and odds >= toxicity.MIN_ODDS and odds / sqrt(1 / a + 1 / b) >= toxicity.MIN_Z:
            expected[term] = pytest.approx(odds)
    assert got == expected and " grum" in got


def planted(n, seed=1):
    """Invented prose; toxic texts hold forms of an invented stem, which no fixed list has."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ra", "ti", "lo", "me", "su", "ne"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        words = [word() for _ in range(rnd.randint(30, 90))]
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words)), "vorb" + word())
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = planted(700)
    odd = [(None if r[0] is None else 10000 + r[0], *r[1:]) for r in awkward()]
    extra = [(10010, 1, None), (None, 1, 1), (10011, None, 0), (10011, None, 0), (99999999, 1, 1)]
    got = toxicity.score_toxicity(with_extra(spark, docs + odd), spark.createDataFrame(labels + extra, LABELS)).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in docs + odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = dict((i, y) for i, _, y in labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    docs, labels = planted(300, seed=2)
    run = lambda d, y: sorted(map(tuple, toxicity.score_toxicity(spark.createDataFrame(d, DOC), spark.createDataFrame(y, LABELS)).collect()))
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    assert run(docs, labels) == run([(i, t, "xx", "other", None) for i, t, *_ in docs], flipped)


def test_empty_tables_and_missing_classes(spark):
    docs, labels = planted(40)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score_toxicity(spark.createDataFrame([], DOC), spark.createDataFrame(labels, LABELS)).collect() == []
    assert toxicity.score_toxicity(spark.createDataFrame([], DOC), none).collect() == []
    table = spark.createDataFrame(docs, DOC)
    assert {tuple(r)[2:] for r in toxicity.score_toxicity(table, none).collect()} == {(0.0, 0)}
    clean = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    assert all(0 < r["score"] < 0.1 and not r["predicted"] for r in toxicity.score_toxicity(table, clean).collect())


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(3000)], LABELS)
    sample = toxicity.labelled_sample(labels, bound=100)
    n = Counter(r["toxic"] for r in sample.collect())
    assert 60 < n[0] < 140 and 60 < n[1] < 140
    assert not [r for r in sample.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
