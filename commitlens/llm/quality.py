"""Quality classifier: Bradley-Terry scores learnt from preference pairs, thresholded by a score quantile.

A labelled document of quality 1 is preferred to one of quality 0. The score of a document is linear in its features,
and the chance that a is preferred to b is sigmoid(score(a) - score(b)), so the logistic loss is on feature
differences. The cut between the classes is the quantile of the training scores at the share of quality 0.

Edge cases: a null text counts as empty; an empty text has zero features and gets a score like any other; repeated
rows are scored each; rows with a null id are never training rows' partners (labels join on id) but are scored; a
table without both classes in its training labels gives score 0.5 for every row; columns beyond doc_id and text are
ignored. Features read whole texts and nothing else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, map_slices, texts

#: Labelled rows that are learnt from, at most: those of least hash. The model has a weight per feature, so more rows
#: change it little.
TRAIN_ROWS = 8192
PAIRS = 60_000
#: The score that the quantile cut is moved to.
CUT = 0.3

_GROUPS = {
    "symbols": "#*$%&|<>", "marks": "!?", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789",
    "stops": ".", "commas": ",", "lines": "\n", "brackets": "()[]{}", "joins": "_-/\\@=+~^", "quotes": "\"'`:;",
}
FEATURES = [*_GROUPS, "high bytes", "log length", "distinct words", "echoed words", "distinct lines", "word length", "words a stop", "symbols at all", "marks at all", "bars"]


def features(text: str) -> np.ndarray:
    """Bounded features of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(FEATURES))
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), text.split(), text.split("\n")
    share = [bins[list(g.encode())].sum() / n for g in _GROUPS.values()]
    w = max(1, len(words))
    echoed = sum(map(str.__eq__, words, words[1:])) / w
    return np.array([
        *share, bins[128:].sum() / n, np.log1p(n) / 15, len(set(words)) / w / (1 + np.log1p(w)), echoed, len(set(lines)) / len(lines), min(1.0, n / w / 40),
        min(1.0, w / (1 + bins[46]) / 100), np.sqrt(share[0]), np.sqrt(share[1]), bins[124] / w,
    ])


def featurized(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features."""

    def make():
        def fn(b):
            return {"doc_id": b.column("doc_id"), "x": [features(t).tolist() for t in texts(b)]}

        return fn

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, x array<double>")


class Ranking:
    """Standardising means and spreads, weights, and the cut."""

    def __init__(self, mean, spread, weights, cut):
        self.mean, self.spread, self.weights, self.cut = mean, spread, weights, cut

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, seed: int = 7, rounds: int = 25) -> Ranking | None:
    """Newton's method on the logistic loss of feature differences of (quality 1, quality 0) pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    return Ranking(mean, spread, w, float(np.quantile(raw, (y == 0).mean())))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS) -> Ranking | None:
    """Learns from the labelled rows of least hash outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).where(fold(F.col("doc_id"), folds) != held)
    own = own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(train_rows)
    # train_rows bounds the broadcast side
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")
    truth = {r.doc_id: r.quality for r in own.collect()}
    # of rows of one id the least features count, so that at most train_rows come, the same in every run
    rows = sorted((r.doc_id, r.x) for r in featurized(mine).groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    if not rows:
        return None
    return fit_pairs(np.array([x for _, x in rows]), np.array([truth[i] for i, _ in rows]))


def score(docs: DataFrame, model: Ranking | None, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def make():
        def fn(b):
            x = np.array([features(t) for t in texts(b)]).reshape(-1, len(FEATURES))
            return {"doc_id": b.column("doc_id"), "score": model.score(x) if model else np.full(len(x), 0.5)}

        return fn

    got = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def by_quantile(scored: DataFrame, share: float) -> DataFrame:
    """The rows at or above the score quantile `share`; of no rows, none."""
    cut = scored.agg(F.percentile_approx("score", share, 10_000)).first()[0]
    return scored.where(F.col("score") >= F.lit(cut))
