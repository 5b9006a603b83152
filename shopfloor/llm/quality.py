"""Quality classifier: a sparse ensemble of rules (operator 7).

Shallow boosted trees are grown on text statistics; every path from a root
to a node is a rule, a conjunction of comparisons.  A logistic model with an
L1 penalty weighs the rules, which leaves a few of them.  The rules and
weights are compiled into one Spark column expression over the statistics.

Fitted on at most ``FIT_ROWS`` labelled rows, drawn by a hash of the id
(documented bound); everything else covers all rows.  Labels, language,
source and id are never inputs of a score.

Defined results: null counts as empty; texts without words have statistics
of zero and the score that the model gives for these; equal texts have
equal scores; repeated rows are scored each; labels with a null are left
out, of contradicting labels of a document the smallest counts; without
labels of both classes the score is the share of ones (0.5 without
labels); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_before, ids_text, rest_of
from .stats import NAMES, STATS, with_statistics

FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES = 30
DEPTH = 3
BINS = 32
PENALTY = 0.0005

Rule = tuple[tuple[int, float, bool], ...]          # (statistic, bound, whether above it)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All root-to-node paths of boosted trees, without doubles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)   # x > cut k: bin > k
    f = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        gradient, weight = y - p, p * (1 - p)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth):
            after = []
            for rows, rule in nodes:
                best = None
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    g = np.bincount(binned[rows, j], gradient[rows], minlength=len(cuts[j]) + 1)
                    h = np.bincount(binned[rows, j], weight[rows], minlength=len(cuts[j]) + 1)
                    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                    gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                    k = int(gain.argmax())
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
                if best is None:
                    f[rows] += 0.3 * gradient[rows].sum() / (weight[rows].sum() + 1)
                    continue
                _, j, k = best
                above = binned[rows, j] > k
                for side in (False, True):
                    path = (*rule, (j, float(cuts[j][k]), side))
                    rules[tuple(sorted(path))] = None
                    after.append((rows[above == side], path))
            nodes = after
        for rows, _ in nodes:
            if len(rows):
                f[rows] += 0.3 * gradient[rows].sum() / (weight[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, bound, above in rule:
        out &= (x[:, j] > bound) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic model, by accelerated proximal steps."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    u = np.random.default_rng(5).normal(size=m)
    for _ in range(20):                                   # largest eigenvalue, for the step
        u = z.T @ (z @ u)
        u /= max(np.linalg.norm(u), 1e-12)
    step = 1 / (0.25 * (np.linalg.norm(z @ u) ** 2 / n + 1) * 1.05 + 1e-9)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w1 = v - step * (z.T @ r) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = c - step * r.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, intercept)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    rules = grow(x, y)
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    w, b = lasso(z, y)
    return [(r, float(v)) for r, v in zip(rules, w) if v], b


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as a Spark column over the statistics."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        test = F.lit(True)
        for j, bound, above in rule:
            c = F.col(STATS)[j]
            test = test & ((c > F.lit(bound)) if above else (c <= F.lit(bound)))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """Model of the labelled documents that aren't held out."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
              .where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y"))
              .where(~held_out("_id")).orderBy(F.xxhash64("_id", F.lit("fit")), "_id").limit(fit_rows))
    rows = docs.select(F.col("`doc_id`").cast("long").alias("_id"), F.col("`text`").cast("string").alias("text")) \
        .join(F.broadcast(chosen), "_id")                 # at most ``fit_rows`` rows of two numbers
    # rows that repeat a document: the one with the smallest statistics, so that ``fit_rows`` rows reach the driver at most
    got = with_statistics(rows).groupBy("_id").agg(F.min("_y").alias("_y"), F.min(STATS).alias(STATS)).toPandas()
    got = sorted(zip(got["_id"], got["_y"], map(tuple, got[STATS])))
    return fit(np.array([g[2] for g in got], float).reshape(-1, len(NAMES)), np.array([g[1] for g in got], float))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every row."""
    return with_statistics(docs.select(ids_text())).select("doc_id", compiled(*model).alias("score"))


def accepted(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, unchanged."""
    rows = docs.select(rest_of(docs, "text"), F.col("text"))
    kept = with_statistics(rows).where(compiled(*model) >= threshold)
    return as_before(kept, docs.columns, text=F.col("text"))
