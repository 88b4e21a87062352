"""Text quality by a sparse rule ensemble over statistics.

Statistics of a text are Spark column expressions. Shallow boosted trees are
grown on a bounded sample of labelled rows; every path from a root becomes a
conjunctive rule; a logistic model with a lasso penalty keeps few of them; and
the kept rules with their weights are compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: At most twice as many labelled rows are used; only their statistics reach the driver.
SAMPLE_ROWS = 8000
TREES, DEPTH, CUTS, MIN_LEAF = 40, 3, 24, 12
PENALTIES = (0.03, 0.01, 0.003, 0.001)

_SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~"


def statistics(text: Column) -> dict[str, Column]:
    """Name -> value, of the whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / F.greatest(n, F.lit(1))
    return {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": n / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "symbols": share(_SYMBOLS),
        "bars": share("|"),
        "calls": share("!?"),
        "stops": share(".,;:"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most?, value)."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, value in self.parts:
            v = x[:, names.index(name)]
            out &= (v <= value) if low else (v > value)
        return out

    def column(self) -> Column:
        out = None
        for name, low, value in self.parts:
            c = F.col(name) <= F.lit(value) if low else F.col(name) > F.lit(value)
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score, from columns named like the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, names: list[str], cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, list[Rule]]:
    """A tree of second-order steps: the step of each row, and the rules of all its nodes."""
    out, rules = np.zeros(len(x)), []

    def node(rows: np.ndarray, parts: tuple, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for j, values in enumerate(cuts):
                side = x[rows, j][:, None] <= values[None, :]
                count, gl, hl = side.sum(0), gradient[rows] @ side, hessian[rows] @ side
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(count < MIN_LEAF) | (len(rows) - count < MIN_LEAF)] = 0
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], (j, float(values[k])))
        if parts:
            rules.append(Rule(parts))
        if best[1] is None:
            out[rows] = g / (h + 1)
            return
        j, value = best[1]
        low = x[rows, j] <= value
        node(rows[low], (*parts, (names[j], True, value)), depth + 1)
        node(rows[~low], (*parts, (names[j], False, value)), depth + 1)

    node(np.arange(len(x)), (), 0)
    return out, rules


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the bias is free."""
    n, m = r.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2)
    w = v = np.zeros(m + 1)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[0] = v[0] = np.log(rate / (1 - rate))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[0] + r @ v[1:], -30, 30)))
        grad = np.concatenate([[np.mean(p - y)], r.T @ (p - y) / n])
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Rules from boosted trees, weights by lasso; the penalty is chosen on a fifth of the rows."""
    if not len(y) or y.min() == y.max():
        rate = float((y.sum() + 1) / (len(y) + 2))
        return RuleEnsemble(round(float(np.log(rate / (1 - rate))), 6), ())
    check = np.arange(len(y)) % 5 == 4
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    # thresholds in the tails as well: bad texts are few
    cuts = [np.unique(np.concatenate([c, np.quantile(x[:, j], [0.005, 0.01, 0.02, 0.98, 0.99, 0.995])])) for j, c in enumerate(cuts)]
    rules: dict[Rule, None] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rng = np.random.default_rng(3)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        use = rng.random(len(y)) < 0.7
        step, found = _grow(x, names, cuts, np.where(use, y - p, 0.0), np.where(use, p * (1 - p), 0.0))
        z += 0.3 * step
        rules.update(dict.fromkeys(found))
    names_of, columns = [], []
    for rule in rules:
        c = rule.holds(x, names)
        if MIN_LEAF <= c.sum() <= len(y) - MIN_LEAF:
            names_of.append(rule)
            columns.append(c)
    r = np.unique(np.array(columns, float), axis=0, return_index=True)[1] if columns else []
    names_of, r = [names_of[i] for i in r], np.array([columns[i] for i in r], float).T if len(columns) else np.zeros((len(y), 0))
    best = None
    for penalty in PENALTIES:
        b, w = _lasso(r[~check], y[~check], penalty)
        p = 1 / (1 + np.exp(-np.clip(b + r[check] @ w, -30, 30)))
        loss = -np.mean(np.where(y[check] == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = _lasso(r, y, best[1], 1500)
    return RuleEnsemble(round(b, 6), tuple((rule, round(float(v), 6)) for rule, v in zip(names_of, w, strict=True) if abs(v) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, train_fold: Column) -> RuleEnsemble:
    sample = labelled_sample(docs, labels, "quality", train_fold, SAMPLE_ROWS)
    columns = statistics(F.col("text"))
    names = list(columns)
    rows = sample.select("doc_id", "y", *(c.cast("double").alias(k) for k, c in columns.items())).orderBy("doc_id", *names).collect()
    x = np.array([[r[k] for k in names] for r in rows], float).reshape(len(rows), len(names))
    return fit(x, np.array([r["y"] for r in rows], float), names)


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, score (0 to 1) and the statistics, one row for each row of ``docs``.

    A null text counts as empty; rows that repeat are each scored; other
    columns are left out, so their names can't clash.
    """
    columns = statistics(F.col("text"))
    found = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in columns.items()))
    return found.select("doc_id", model.column().alias("score"), *columns)
