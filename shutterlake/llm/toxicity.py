"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, maps homoglyphs and full-width forms to plain letters, and
reads digits and signs inside words as the letters that they stand for. The
lexicon's terms are words and beginnings of words; terms, weights (smoothed log
odds) and exception phrases are learned from a bounded sample of labelled rows, in
which copies count once. A match inside an exception phrase doesn't count. The sum
of weights, and that sum relative to the text's length, go through a logistic
function of three parameters, fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, labelled_sample

#: At most twice as many labelled rows are used.
SAMPLE_ROWS = 6000
TERMS, MIN_DOCS, MIN_WEIGHT = 4000, 6, 3.0
#: Smallest hashes by which copies are told.
MINIMA = 3
#: Exception phrases that are learned at most.
PHRASES = 200
PREFIX = range(3, 9)

# Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαοερτυνικ", "aeopcyxijsdhlkmtbhaoeptuvik", strict=True))
SIGNS = dict(zip("013457@$", "oieastas", strict=True))

_IN_WORD = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|(?<![\w@$])[013457@$](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457@$](?![\w@$])")
_SIGN = str.maketrans(SIGNS)
_FOLD = str.maketrans({**{c: " " for c in map(chr, range(128)) if not c.isalpha()}, **HOMOGLYPHS, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **{c: " " for c in " –—‘’“”…«»¡¿"}, "​": "", "‍": "", "­": ""})
_HAS_SIGN = re.compile(r"[013457@$]")


def fold(text: str | None) -> str:
    """The text in folded words, each between blanks."""
    if not text:
        return " "
    text = text.lower()
    if _HAS_SIGN.search(text):
        for _ in range(2):  # what is read first may be what another sign stands beside
            text = _IN_WORD.sub(lambda m: m[0].translate(_SIGN), text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """terms: " word " or " beginning" -> weight. exceptions: phrases inside which matches don't count."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.5)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.terms.items():
                self._machine.add_word(term, (len(term), weight))
            self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight); of matches with the same start the longest."""
        if not self.terms:
            return []
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight) in self.machine().iter(folded):
            at = last + 1 - size
            if weight is None:
                spared.append((at, last + 1))
            else:
                found[at] = (last + 1, weight)
        if not spared:
            return [(a, b, w) for a, (b, w) in found.items()]
        # of the exceptions that begin at or before a match the farthest end decides
        spared.sort()
        starts, far = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
        return [(a, b, w) for a, (b, w) in found.items() if not (k := bisect_right(starts, a)) or far[k - 1] < b]

    def inputs(self, text: str | None) -> tuple[float, float]:
        """Of the logistic function: the sum of weights, and that for a hundred words, both dampened."""
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(20, folded.count(" "))) if total else 0.0

    def score(self, text: str | None) -> float:
        a, b = self.inputs(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(folded: str) -> set[str]:
    """The words of a text and their beginnings."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in PREFIX if k < len(word))
    return out


def _key(folded: str) -> int:
    """Of a text's word pairs the smallest hashes, as one: copies mostly share them, so that a group of copies counts once; a common line alone doesn't make two texts copies."""
    import xxhash

    words = folded.split()
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:] or words, strict=False)}
    return xxhash.xxh3_64_intdigest(repr(nsmallest(MINIMA, map(xxhash.xxh3_64_intdigest, pairs)))) >> 1


def _chosen(counts: list[tuple[str, int, int]], positive: int, negative: int) -> dict[str, float]:
    """Terms with weights, without those that a shorter term with nearly that weight begins."""
    weight = {t: math.log((p + 0.5) / (positive + 1) * (negative + 1) / (n + 0.5)) for t, p, n in counts}
    held = {t: p for t, p, _ in counts}
    good = {t for t, w in weight.items() if w >= MIN_WEIGHT}
    out: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        shorter = [term[:k] for k in range(4, len(term)) if term[:k] in out]
        if not any(out[s] >= weight[term] - 1.0 for s in shorter):
            out[term] = round(weight[term], 4)
    # a beginning that only one word has stands for no more than that word; the word is the safer term
    for term in [t for t in out if not t.endswith(" ")]:
        words = [t for t in good if t.endswith(" ") and t.startswith(term)]
        if len(words) == 1 and held[words[0]] >= 0.95 * held[term]:
            out[words[0]] = max(out.pop(term), round(weight[words[0]], 4))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, train_fold: F.Column, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns the lexicon. Terms are counted on the executors; counts of terms, not texts, reach the driver."""
    sample = labelled_sample(docs, labels, "toxic", train_fold, SAMPLE_ROWS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "k": [_key(f) for f in folded], "folded": folded})

    # of copies the smallest stays, whatever the order they come in; stored, so that all passes see the same rows
    once = sample.select("text", "y").mapInPandas(counted, "y int, k long, folded string").groupBy("k").agg(F.min(F.struct("folded", "y")).alias("r"))
    rows = Stored(once.select("r.y", "r.folded"), "sample")
    kept = rows.df

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with_, without = Counter(), Counter()
            for y, f in zip(batch["y"], batch["folded"], strict=True):
                (with_ if y else without).update(terms_of(f))
            yield pd.DataFrame([(t, n, without[t]) for t, n in with_.items()] + [(t, 0, n) for t, n in without.items() if t not in with_], columns=["term", "p", "n"])

    sizes = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    positive, negative = sum(c for y, c in sizes.items() if y), sizes.get(0, 0)
    odds = F.log((F.col("p") + 0.5) / (positive + 1) * (negative + 1) / (F.col("n") + 0.5))
    sums = kept.select("y", "folded").mapInPandas(terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    least = max(4, min(MIN_DOCS, positive // 50))
    counts = sums.where((F.col("p") >= least) & (odds >= MIN_WEIGHT)).orderBy(F.desc("p"), "term").limit(TERMS).collect()
    lexicon = Lexicon(_chosen([(r["term"], r["p"], r["n"]) for r in counts], positive, negative), tuple(exceptions))
    lexicon.exceptions += _phrases(kept, lexicon)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [lexicon.inputs(f) for f in batch["folded"]]
            yield pd.DataFrame({"y": batch["y"], "a": [v for v, _ in x], "b": [v for _, v in x]})

    got = sorted(kept.select("y", "folded").mapInPandas(rated, "y int, a double, b double").collect())
    rows.drop()
    y = np.array([r["y"] for r in got], float)
    if lexicon.terms and 0 < y.sum() < len(y):  # without terms no text is suspect
        lexicon.curve = tuple(round(float(v), 6) for v in _logistic(np.array([[r["a"], r["b"]] for r in got]), y))
    return lexicon


def _phrases(kept: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Phrases of a matched word and the one before that at least three harmless texts have and no toxic one."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for n, (y, f) in enumerate(zip(batch["y"], batch["folded"], strict=True)):
                for a, b, _ in lexicon.hits(f):
                    end = f.find(" ", max(a + 1, b - 1))
                    before = f[:a].rsplit(" ", 1)[-1]
                    if before:
                        rows.add((n, y, f"{before} {f[a + 1 : end]}"))
            if rows:
                yield pd.DataFrame([(p, y) for _, y, p in rows], columns=["phrase", "y"])

    counts = kept.select("y", "folded").mapInPandas(seen, "phrase string, y int").groupBy("phrase").agg(F.sum(F.lit(1) - F.col("y")).alias("n"), F.sum("y").alias("p"))
    return tuple(r["phrase"] for r in counts.where("n >= 3 and p = 0").orderBy(F.desc("n"), "phrase").limit(PHRASES).collect())


def scored(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column`` (replaced if it is there).

    A null or empty text gets what a text without matches gets. Rows that repeat
    are each scored; all other columns stay as they are.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype=float)

    return docs.withColumn(column, score("text"))
