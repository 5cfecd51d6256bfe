"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow boosted trees are grown on the statistics of a bounded sample of labelled texts.
Every path from a root to a node is a rule, a conjunction of threshold conditions; a lasso
on the logistic loss gives most rules no weight, and the rules that keep one are compiled
into a Spark column expression, so that all texts are scored inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.llm.common import WORD, fresh, read

#: About so many labelled rows at most are collected to fit rules: the documented bound of the sample.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
HELD_OUT_OF = 5


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, by name; a null text is empty. No label, language, source or id."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    words = F.regexp_count(t, F.lit(WORD)).cast("double")
    per_word = F.greatest(words, F.lit(1.0))
    per_char = F.greatest(chars, F.lit(1.0))
    without = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s)))) / F.lit(float(len(s)))
    pieces, lines = F.split(t, " "), F.split(t, "\n")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(words),
        "word_length": chars / per_word,
        "capitals": count(r"\p{Lu}") / per_char,
        "capital_words": count(r"\p{Lu}{2,}") / per_word,
        "symbols": count(r"[*#$%&@~^=_<>\[\]{}\\/+]") / per_word,
        "symbol_runs": count(r"[!?*#$%&@~^=_<>+.\-]{2,}") / per_word,
        "bars": without("|") / per_word,
        "exclaims": without("!") / per_word,
        "digits": count("[0-9]") / per_char,
        "stops": count(r"[.!?](?=\s|\z)") / per_word,
        "commas": without(",") / per_word,
        "distinct_words": F.size(F.array_distinct(pieces)) / F.size(pieces),
        "lines": F.size(lines) / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "longest_word": F.log1p(F.aggregate(pieces, F.lit(0), lambda m, p: F.greatest(m, F.length(p))).cast("double")),
    }


@dataclass(frozen=True)
class Rule:
    """All of its (statistic, is_above, threshold) conditions hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, at in self.conditions:
            out &= (x[:, j] > at) == above
        return out

    def compiled(self, names: list[str]) -> Column:
        out = F.lit(True)
        for j, above, at in self.conditions:
            column = F.col(names[j])
            out = out & ((column > F.lit(at)) if above else (column <= F.lit(at)))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, names: list[str]) -> Column:
        """The probability of label 1, from columns of the given names."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.compiled(names), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1.0 / (1.0 + np.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, depth: int, out: np.ndarray, rate: float) -> list[Rule]:
    """One boosted tree: adds its step to out, returns the rules of its nodes."""
    rules: list[Rule] = []
    todo = [(np.arange(len(x)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = gradient[rows].sum(), curve[rows].sum()
        best = (1e-3, -1, -1)
        if len(path) < depth:
            for j in range(x.shape[1]):
                size = len(cuts[j]) + 1
                if size < 2:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], weights=gradient[rows], minlength=size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], weights=curve[rows], minlength=size))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < 1) | (h - hl < 1)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            out[rows] -= rate * g / (h + 1)
            continue
        _, j, k = best
        under = binned[rows, j] <= k
        for above, part in ((False, rows[under]), (True, rows[~under])):
            step = (*path, (j, above, float(cuts[j][k])))
            rules.append(Rule(step))
            todo.append((part, step))
    return rules


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 32, penalty: float = 2e-4, steps: int = 400) -> Ensemble:
    """Rules and weights from statistics x and labels y in 0, 1.

    Without rows the score is 0.5; with rows of one label only, it is their smoothed share.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Ensemble(bias, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rule in _grow(x, binned, cuts, p - y, p * (1 - p), depth, margin, 0.3):
            rules.setdefault(rule, None)
    rules = list(rules)
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    weights, intercept = _lasso(held, y.astype(np.float64), bias, penalty, steps)
    return Ensemble(float(intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def _lasso(a: np.ndarray, y: np.ndarray, bias: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean logistic loss plus penalty * |w|_1; the intercept is free."""
    a = np.hstack([a, np.ones((len(a), 1))])
    vector = np.ones(a.shape[1])
    for _ in range(20):
        vector = a.T @ (a @ vector)
        norm = np.linalg.norm(vector)
        vector /= norm
    rate = 4.0 * len(a) / norm
    shrink = np.full(a.shape[1], rate * penalty)
    shrink[-1] = 0
    w = np.zeros(a.shape[1])
    w[-1] = bias
    at, t = w, 1.0
    for _ in range(steps):
        step = at - rate * (a.T @ (1 / (1 + np.exp(-(a @ at))) - y)) / len(a)
        new = np.sign(step) * np.maximum(np.abs(step) - shrink, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], w[-1]


def held_out(doc: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by HELD_OUT_OF; false for a null id."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Ensemble:
    """Fit on labelled rows that aren't held out.

    Of more than max_labelled such labels, a share of about that many is taken by a hash of
    the id. Labels other than 0 and 1 and null ids are left out; an id with both labels
    counts as 1 if most of its labels are; of several texts of an id, one counts (the one of
    the least statistics). Only statistics come to the driver, one row an id.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull() & ~held_out(F.col(doc))).groupBy(F.col(doc).alias("_doc")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    n = known.count()
    scale = 1 << 30
    taken = known.where(F.pmod(F.xxhash64("_doc"), F.lit(scale)) < F.lit(scale if n <= max_labelled else scale * max_labelled // n))
    found = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(taken), "_doc")  # about max_labelled rows
    stats = statistics(F.col("_text"))
    told = found.select("_doc", F.struct("_label", *[c.alias(k) for k, c in stats.items()]).alias("_row"))
    rows = told.groupBy("_doc").agg(F.min("_row").alias("_row")).select("_doc", "_row.*").toPandas()
    rows = rows.sort_values(["_doc", *stats], kind="stable")
    return fit(rows[list(stats)].to_numpy(dtype=np.float64), rows["_label"].to_numpy())


def score(docs: DataFrame, model: Ensemble, text: str = "text", threshold: float = THRESHOLD, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on, else 0), replacing columns of those names.

    Every row is scored on its whole text; null texts score as empty ones. Repeated rows
    score alike; an empty table stays empty.
    """
    names, with_stats = [], docs
    for k, c in statistics(F.col(text)).items():
        names.append(fresh(docs, f"_dg_{k}"))
        with_stats = with_stats.withColumn(names[-1], c)
    scored = with_stats.withColumn(score_name, model.score(names)).drop(*names)
    return scored.withColumn(predicted_name, (F.col(score_name) >= threshold).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """All documents scored; rules learnt from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
