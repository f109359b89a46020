"""Text quality by a sparse ensemble of rules.

Small boosted trees over text statistics are grown on a labelled sample; every path from
a root becomes a conjunctive rule; a lasso-penalised logistic regression gives most
rules no weight. The rest are compiled into one Spark column expression, so scoring is
DataFrame functions over each row, without shuffle.

Statistics come from the text alone; identifiers, language and source are never read.
The sample has at most ``sample`` labelled rows (documented bound), first by a hash of
the key, from rows the caller lets through; it is the only thing the driver receives.

Defined results: null and empty texts have statistics of zero and a score like any other;
rows without a label do not train, repeated labels count as often as they stand; with
labels of one class or none the score is that class's smoothed share (0.5 for none);
an empty table gives an empty table; an input column named like the score is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeline.llm.columns import SPACE, let, occurrences, unused, whole_text, without, words

FEATURES = ("n_words", "word_length", "distinct", "repeats", "symbols", "capitals", "digits", "pipes", "marks",
            "sentences", "line_words", "same_lines", "decorated")

Condition = tuple[int, bool, float]      # feature, greater, threshold
Rule = tuple[Condition, ...]


def statistics(text: Column) -> dict[str, Column]:
    whole = whole_text(text)

    def share(pattern: str) -> Column:
        return occurrences(whole, pattern) / F.greatest(F.length(whole), F.lit(1))

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        return F.struct(
            F.size(w).alias("n"), (F.size(F.array_distinct(w)) / n).alias("distinct"),
            (F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))) / n).alias("repeats"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))).alias("same"))

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x != "")
    return {"_w": let(words(whole), of_words), "_l": let(lines, of_lines), "_symbols": share(r"[#*$%&<>]"),
            "_capitals": share(r"\p{Lu}"), "_digits": share("[0-9]"), "_pipes": share(r"\|"), "_marks": share("!"),
            "_sentences": occurrences(whole, f"[.!?]([{SPACE}]|$)"), "_decorated": occurrences(whole, r"[#*$%&!|]{2,}"),
            "_chars": F.length(whole)}


def feature_names(docs: DataFrame) -> list[str]:
    """Names of the statistics beside the columns of ``docs``."""
    return unused(docs, *FEATURES)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics under ``feature_names``; texts are read once."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    raw = statistics(F.col(f"`{text}`"))
    at = dict(zip(raw, unused(docs, *raw)))
    col = lambda name, field=None: F.col(at[name]) if field is None else F.col(at[name])[field]
    n = F.greatest(col("_w", "n"), F.lit(1))
    features = {
        "n_words": col("_w", "n").cast("double"), "word_length": col("_chars") / n, "distinct": col("_w", "distinct"),
        "repeats": col("_w", "repeats"), "symbols": col("_symbols"), "capitals": col("_capitals"), "digits": col("_digits"),
        "pipes": col("_pipes"), "marks": col("_marks"), "sentences": col("_sentences") / n,
        "line_words": col("_w", "n") / F.greatest(col("_l", "n"), F.lit(1)), "same_lines": col("_l", "same"),
        "decorated": col("_decorated") / n}
    return docs.select(*kept, *[c.alias(at[a]) for a, c in raw.items()]).select(
        *kept, *[features[f].alias(name) for f, name in zip(FEATURES, feature_names(docs))])


def grow(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: Rule, rules: list[Rule], out: np.ndarray,
         rows: np.ndarray) -> None:
    """A regression tree by variance reduction; leaves write their means to ``out``."""
    r = residual[rows]
    out[rows] = r.mean()
    if not depth or len(rows) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[rows, f], kind="stable")
        values, sums = x[rows, f][order], np.cumsum(r[order])
        at = np.arange(least, len(rows) - least + 1)
        at = at[values[at - 1] < values[at]] if len(at) and at[-1] < len(rows) else at[:-1][values[at[:-1] - 1] < values[at[:-1]]]
        if len(at):
            left = sums[at - 1]
            gain = left ** 2 / at + (sums[-1] - left) ** 2 / (len(rows) - at) - sums[-1] ** 2 / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((values[at[k] - 1] + values[at[k]]) / 2))
    if best[1] < 0:
        return
    _, f, threshold = best
    above = x[rows, f] > threshold
    for greater, part in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (f, greater, threshold))
        rules.append(longer)
        grow(x, residual, depth - 1, least, longer, rules, out, part)


def simplified(rule: Rule) -> Rule:
    """One condition for each feature and direction, the tightest."""
    kept: dict[tuple[int, bool], float] = {}
    for f, greater, t in rule:
        old = kept.get((f, greater))
        kept[f, greater] = t if old is None else (max(old, t) if greater else min(old, t))
    return tuple(sorted((f, g, t) for (f, g), t in kept.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, t in rule:
        out &= (x[:, f] > t) if greater else (x[:, f] <= t)
    return out


def lasso(rules: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal gradient."""
    n, m = rules.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    z, zb, t = w.copy(), b, 1.0
    # The largest curvature, by a few power iterations.
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        u = rules @ v[:m] + v[m]
        v = np.append(rules.T @ u, u.sum())
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.25 * size / n * 1.05 + 1e-12)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(rules @ z + zb, -30, 30))) - y
        w2 = z - step * (rules.T @ error / n)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = zb - step * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self, names: Sequence[str] = FEATURES) -> Column:
        """The compiled score over the statistics' columns, from 0 to 1."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            fits = F.lit(True)
            for f, greater, t in rule:
                fits = fits & ((F.col(names[f]) > t) if greater else (F.col(names[f]) <= t))
            total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, least: int = 10, penalty: float = 1e-3,
        rounds: int = 600, seed: int = 7) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble((), float(np.log(share / (1 - share))))
    random = np.random.default_rng(seed)
    least = max(1, min(least, len(y) // 20))
    found: list[Rule] = []
    current = np.zeros(len(y))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-current))
        rows = random.permutation(len(y))[:max(2, len(y) // 2)]
        before, out = len(found), np.zeros(len(y))
        grow(x, residual, depth, least, (), found, out, np.sort(rows))
        # Leaves also hold for the rows the tree has not seen.
        for rule in found[before:]:
            inside = holds(rule, x)
            out[inside] = residual[np.intersect1d(np.flatnonzero(inside), rows)].mean()
        current += 2.0 * out
    rules = sorted({simplified(r) for r in found})
    matrix = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    keep = (matrix.mean(axis=0) > 0) & (matrix.mean(axis=0) < 1)
    rules, matrix = [r for r, k in zip(rules, keep) if k], matrix[:, keep]
    weights, bias = lasso(matrix, y, penalty, rounds)
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6), bias)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = 6000) -> Ensemble:
    """Fit on at most ``sample`` labelled rows for which ``allowed`` (over the labels) holds."""
    chosen = labels.where(allowed & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("double").alias("_y")).orderBy(
        F.xxhash64("_key"), "_key", "_y").limit(sample)
    # At most ``sample`` rows of two numbers: a bounded broadcast, and texts are not shuffled.
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
    got = with_features(rows, "_text").select("_key", "_y", *FEATURES).collect()
    data = np.array(sorted(tuple(float(v) for v in r[1:]) for r in got)).reshape(-1, len(FEATURES) + 1)
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of each text."""
    kept = [F.col(f"`{c}`") for c in without(docs, name).columns]
    return with_features(docs, text).select(*kept, ensemble.score(feature_names(docs)).alias(name))
