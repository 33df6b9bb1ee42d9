"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (fixed words of abuse; terms learned from labelled texts), how near their
hits stand to the second person, capitals, punctuation, and how much of the text is obfuscated.  Learned terms are
whole words and their beginnings and endings, so that inflected and compound forms count; they are weighed by smoothed
log-odds.  Texts are read once for the features; the trees and the calibration are Spark's own and score them as rows.

Labelled rows outside the held-out fifth are drawn by a hash of their id, at most LABELLED of each class.  The trees
and the calibration must not see terms that were learned from their own rows: each half of the sample is read with the
terms of the other half, three quarters of the rows then teach the trees and the rest the calibration.  All texts are
scored with the terms of both halves.  The drawn ids (a bounded number) are broadcast; no other text is moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log, sqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage

#: bounds of what is learned from: labelled rows of each class, terms
LABELLED, TERMS = 6000, 4000
#: a term needs so many toxic texts, such log-odds, and so many standard errors of them
MIN_TEXTS, MIN_ODDS, MIN_Z = 3, 2.0, 2.5
#: code points of word beginnings and endings that are terms
AFFIXES = range(3, 8)
#: trees, depth, step; words around the second person that count as near
TREES, DEPTH, STEP, NEAR = 20, 3, 0.3, 6

#: fixed words of abuse by language; learned terms add to them
ABUSE = frozenset("""
idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile cretin loser losers scum scumbag trash
garbage filth filthy pathetic worthless disgusting clown jerk bastard bitch asshole shit bullshit crap fuck fucking
fucker dickhead prick slut whore retard retarded vermin parasite pig swine coward liar creep freak hate kill die
dumm dummkopf vollidiot trottel arsch arschloch scheisse scheiße wichser hurensohn schlampe abschaum versager drecksack
missgeburt blödmann blöd schwein widerlich erbärmlich wertlos verpiss
idiote imbécile crétin connard connasse salaud salope merde putain enculé abruti débile ordure raclure minable dégoûtant
idiota imbécil estúpido estúpida tonto tonta gilipollas cabrón puta puto mierda basura escoria asqueroso pendejo maricón
inútil
""".split())
#: fixed words of the second person
SECOND = frozenset("""you your yours yourself ya u du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous
votre vos tú ti tuyo usted ustedes vosotros os""".split())
#: fixed values: characters that stand for letters inside obfuscated words
LEET = str.maketrans("01345789@$!|+€", "oieastbgasilte")

LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = frozenset("@$!|+€*#%&")
#: letters with digits or symbols between or before them; only where a word starts, so that long runs are read once
MASKED = re.compile(r"(?<![\w@$!|+€])(?:[\d@$!|+€]*[^\W\d_]+(?:[\d@$!|+€*#%&]+[^\W\d_]+)+|[\d@$!|+€]+[^\W\d_]{3,})")
WILD = re.compile(r"[#*%&]")
SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?!\w)")
DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
BURST = re.compile(r"[!?]{2,}")

NAMES = ("abuse_density", "abuse_kinds", "term_density", "term_kinds", "term_weight", "term_top", "near_second", "second_density",
         "capitals", "shouted", "exclaimed", "asked", "bursts", "symbols", "masked", "spelled", "drawn_out", "hidden_abuse", "length")


@cache
def kinds_of_characters() -> np.ndarray:
    """For every code point 1 if a letter, 2 more if a capital, 4 if a digit or one of SYMBOLS."""
    chars = map(chr, range(0x110000))
    return np.array([c.isalpha() + 2 * c.isupper() + 4 * (c.isdecimal() or c in SYMBOLS) for c in chars], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spaced(text: str) -> tuple[str, np.ndarray]:
    """The words of a text in small letters, one space before, between and after them; places of the spaces."""
    points = code_points(f" {text.lower()} ")
    letter = kinds_of_characters()[points] & 1 == 1
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of what parts words the first character stays, as a space
    kept[0] = True
    out = np.where(letter, points, np.uint32(32))[kept]
    # before the first word two spaces may have stayed
    out = out[1:] if len(out) > 1 and out[0] == out[1] == 32 else out
    return out.tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(out == 32)


def terms(words: str) -> set[str]:
    """All terms of a spaced text: `` word ``, `` beginning``, ``ending ``."""
    found = set()
    for w in set(words.split()):
        found.add(f" {w} ")
        for n in AFFIXES:
            if len(w) > n:
                found.add(f" {w[:n]}")
                found.add(f"{w[-n:]} ")
    return found


def means_abuse(masked: str) -> bool:
    """Whether a word with characters in the place of letters can be read as a word of abuse."""
    word = masked.lower().translate(LEET)
    if word in ABUSE or not WILD.search(word):
        return word in ABUSE
    pattern = re.compile(WILD.sub(r"\\w", word))
    return any(map(pattern.fullmatch, ABUSE))


def automaton(values: dict):
    """Finds all terms in one pass over a spaced text; an ending's match ends on the space behind its word."""
    found = ahocorasick.Automaton()
    for term, value in values.items():
        found.add_word(term, (term, value))
    if values:
        found.make_automaton()
    return found


class Reader:
    """Texts to features with one lexicon of learned terms."""

    def __init__(self, weights: dict[str, float]):
        fixed = {f" {w} ": [True, False, 0.0] for w in ABUSE}
        for w in SECOND:
            fixed.setdefault(f" {w} ", [False, False, 0.0])[1] = True
        for term, weight in weights.items():
            fixed.setdefault(term, [False, False, 0.0])[2] = weight
        self.search = automaton(fixed)

    def features(self, text: str | None) -> list[float]:
        """One value for each of NAMES; a null text reads as empty."""
        text = text or ""
        words, gaps = spaced(text)
        n = max(len(gaps) - 1, 1)
        chars = max(len(text), 1)
        abuse, second, best = set(), set(), {}
        found = list(self.search.iter(words))
        # a match that ends on a space belongs to the word before it
        at = (np.searchsorted(gaps, [end for end, _ in found]) - 1).tolist() if found else []
        for word, (_, (_, (is_abuse, is_second, weight))) in zip(at, found):
            if is_abuse:
                abuse.add(word)
            if is_second:
                second.add(word)
            if weight:
                best[word] = max(weight, best.get(word, 0.0))

        def kinds(places) -> int:
            return len({words[gaps[i] + 1:gaps[i + 1]] for i in places})

        near = 0
        hits = np.array(sorted({*abuse, *best}))
        if len(hits) and second:
            places = np.array(sorted(second))
            right = np.searchsorted(places, hits)
            gap = np.minimum(abs(places[np.minimum(right, len(places) - 1)] - hits), abs(places[np.maximum(right - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        kind = kinds_of_characters()[code_points(text)]
        letter, capital, sign = kind & 1 > 0, kind & 2 > 0, kind & 4 > 0
        letters = max(int(letter.sum()), 1)
        # the patterns below are slow and rarely match: they run where a plain look finds what they need
        shouted = 0
        if (capital[2:] & capital[1:-1] & capital[:-2]).any():
            shouted = sum(len(w) > 2 and w.isupper() for w in LETTERS.findall(text))
        masked = MASKED.findall(text) if (sign[:-1] & letter[1:]).any() else []
        single = np.diff(gaps) == 2
        spelled = SPELLED.findall(text) if (single[3:] & single[2:-1] & single[1:-2] & single[:-3]).any() else []
        points = code_points(words)
        same = (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
        long = {int(i) for i in np.searchsorted(gaps, np.flatnonzero(same))}  # words are parted by one space only
        long = [words[gaps[i - 1] + 1:gaps[i]] for i in sorted(long)]
        hidden = sum(map(means_abuse, masked))
        hidden += sum("".join(LETTERS.findall(s.lower())) in ABUSE for s in spelled)
        hidden += sum(DRAWN_OUT.sub(r"\1", w) in ABUSE for w in long)
        return [len(abuse) / n, kinds(abuse), len(best) / n, kinds(best), sum(best[i] for i in sorted(best)) / n,
                max(best.values(), default=0.0), near / n, len(second) / n, int(capital.sum()) / letters,
                shouted / n, text.count("!") / chars, text.count("?") / chars,
                len(BURST.findall(text)) / n if "!" in text or "?" in text else 0.0, sum(map(text.count, "@#$%&*")) / chars,
                len(masked) / n, len(spelled) / n, len(long) / n, hidden / n, log(n)]


def remainder(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, toxic, fold) of at most about ``bound`` labelled ids of each class outside the held-out fifth.

    An id that is labelled twice counts as toxic if one label says so; null ids and null labels are left out.  The
    draw takes an equal share of hashes for each class, so that which ids are in it doesn't depend on the layout.
    """
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
             .filter(remainder() != 0).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    known = stage(known.withColumn("_draw", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)), "labelled")
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, bound / n) for k, n in count.items()}
    part = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(20))
    return known.filter(F.col("_draw") < part).select("doc_id", "toxic", fold.cast("int").alias("fold"))


#: folds of 20 whose rows teach the trees, the rest the calibration; even and odd folds are the halves
TREE_FOLDS = 15


def learn_terms(texts: DataFrame, bound: int = TERMS) -> dict[str, float]:
    """Terms of toxic texts and their log-odds from ``texts`` (text, toxic); the ``bound`` surest at most.

    Terms are found in toxic texts alone and then counted in the others, texts that hold them, not occurrences.
    """
    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(terms(spaced(t.as_py())[0]))
                if len(counts) > 1 << 20:  # passed on before it grows; the sums come after the exchange
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return {}
    toxic = texts.filter("toxic = 1 and text is not null").select("text")
    found = toxic.mapInArrow(of_toxic, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    least = max(MIN_TEXTS, 0.002 * size[1])
    found = {r["term"]: r["n"] for r in found.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(8 * bound).collect()}

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts = automaton(dict.fromkeys(found, 0.0)), Counter()
        for b in batches:
            for t in b.column(0):
                counts.update({term for _, (term, _) in search.iter(spaced(t.as_py())[0])})
        yield _counted(counts)

    if not found:
        return {}
    clean = texts.filter("toxic = 0 and text is not null").select("text").mapInArrow(of_clean, "term string, n long")
    other = {r["term"]: r["n"] for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    sure = {}
    for term, n in found.items():
        a, b = n + 0.5, other.get(term, 0) + 0.5
        odds = log(a / (size[1] + 1)) - log(b / (size[0] + 1))
        z = odds / sqrt(1 / a + 1 / b)
        if odds >= MIN_ODDS and z >= MIN_Z:
            sure[term] = (z, odds)
    return {t: sure[t][1] for t in sorted(sure, key=lambda t: (-sure[t][0], t))[:bound]}


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])


def read_features(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``texts`` with their column text replaced by the vector ``features``."""
    bounded_batches(texts.sparkSession)
    at = texts.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights)
        for b in batches:
            others = [b.column(i) for i in range(b.num_columns) if i != at]
            names = [b.schema.names[i] for i in range(b.num_columns) if i != at]
            found = pa.array([reader.features(t.as_py()) for t in b.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*others, found], [*names, "features"])

    return texts.mapInArrow(run, f"{kinds}, features array<double>").withColumn("features", array_to_vector("features"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, learned from ``labels`` (doc_id, toxic).

    The score is the calibrated chance of label 1, and among equal chances rises with the trees' own by a thousandth.
    Null and empty texts are scored as texts without words.  A null doc_id is not held out and never learned from;
    repeated rows and ids are scored one by one; an empty table gives an empty result.  If a class is missing among the
    labels of the trees or of the calibration, every score is the smoothed share of toxic labels.  Further columns are ignored whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels))  # at most about 2 * LABELLED rows
    learning = stage(docs.join(sample, "doc_id").select("text", "toxic", "fold"), "learning")
    halves = [learning.filter(F.col("fold") % 2 == i) for i in (0, 1)]
    known = [read_features(half, learn_terms(other)) for half, other in zip(halves, reversed(halves))]
    known = stage(known[0].unionByName(known[1]).withColumn("label", F.col("toxic").cast("double")), "known")
    weights = learn_terms(learning)
    held_out = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    count = {(r["late"], r["toxic"]): r["n"] for r in known.groupBy((F.col("fold") >= TREE_FOLDS).alias("late"), "toxic")
             .agg(F.count("*").alias("n")).collect()}
    if len(count) < 4:
        toxic, every = sum(n for (_, y), n in count.items() if y), sum(count.values())
        score = F.lit((toxic + 1) / (every + 2) if every else 0.0)
        return docs.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=13).fit(known.filter(F.col("fold") < TREE_FOLDS))

    def chance(rows: DataFrame) -> DataFrame:
        return trees.transform(rows).withColumn("own", vector_to_array("probability")[1]).drop("prediction")

    calibration = IsotonicRegression(featuresCol="own").fit(chance(known.filter(F.col("fold") >= TREE_FOLDS)))
    scored = calibration.transform(chance(read_features(docs, weights)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("prediction") + 0.001 * F.col("own")))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
