"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of what its letters and words look like. In a pair of a good and a bad document the
good one wins with the logistic of their strengths' difference, and the weights are fitted to pairs of labelled documents
by the logistic loss on feature differences. The threshold is the strength below which as large a share of the training
documents lies as is labelled bad; scores are logistic around it, so it is ACCEPT everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .labelled import TRAINING_ROWS, held_out, training_sample

PAIRS = 40_000
ROUNDS, RATE, DECAY = 400, 0.5, 1e-4
#: The score at the threshold.
ACCEPT = 0.3
#: Letters that mark markup, shouting and tables rather than prose.
MARKS = (b"!", b"|", b"*$%&#@^~", b".", b",", b"?", b":;", b"()[]{}<>", b"/\\", b"-_=+")


def features(text: str | None) -> list[float]:
    """Shares of letters, marks and words. An empty text has only zeros and ones that a text of no words would have."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) + 1
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n_words = len(words) + 1
    distinct = len(set(words))
    letters = by[65:91].sum() + by[97:123].sum() + by[128:].sum() + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = by[10] + 1
    shares = [by[65:91].sum() / letters, by[48:58].sum() / n, by[128:].sum() / n, *(by[list(m)].sum() / n for m in MARKS), by[10] / n]
    more = [again / n_words, distinct / n_words, len(raw) / n_words / 10, np.log(n_words) / 10, np.log(n_words) * distinct / n_words / 10, lines / n_words]
    # Junk is often plain at small shares, where square roots spread what shares crowd together.
    return [float(x) for x in [*shares, *np.sqrt(shares), *more, np.sqrt(again / n_words)]]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """The ranker of features x and labels y; without both labels, one that has no preference and accepts all."""
    middle, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"middle": middle, "spread": spread, "w": np.zeros(x.shape[1] if x.ndim == 2 else 0), "cut": -1.0, "scale": 1.0}
    x = (x - middle) / spread
    draw = np.random.default_rng(seed)
    pairs = np.clip(x[draw.choice(good, PAIRS)] - x[draw.choice(bad, PAIRS)], -8, 8)
    w, mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, ROUNDS + 1):  # Adam on the whole sample of pairs
        slope = -(pairs / (1 + np.exp(np.clip(pairs @ w, -30, 30)))[:, None]).mean(0) + DECAY * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= RATE / 10 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    strength = np.clip(x, -8, 8) @ w
    # The quantile at the share of bad documents; halfway to the next strength, so that ties fall together.
    ranked = np.sort(strength)
    k = min(max(len(bad), 1), len(ranked) - 1)
    cut = (ranked[k - 1] + ranked[k]) / 2
    gap = strength[good].mean() - strength[bad].mean()
    return {"middle": middle, "spread": spread, "w": w, "cut": float(cut), "scale": float(4 / max(gap, 1e-6))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    strength = np.clip((x - model["middle"]) / model["spread"], -8, 8) @ model["w"]
    return 1 / (1 + (1 - ACCEPT) / ACCEPT * np.exp(np.clip((model["cut"] - strength) * model["scale"], -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> dict:
    """The ranker of at most bound labelled documents; only their features and labels come to the driver."""

    def start() -> Callable[[dict], dict]:
        return lambda batch: {"doc_id": batch["doc_id"], "x": [features(t) for t in batch["text"]], "label": batch["label"]}

    rows = map_rows(training_sample(docs, labels, "quality", bound), start, "doc_id long, x array<double>, label int").toPandas().sort_values("doc_id")
    x = np.array([*rows.x], float).reshape(len(rows), len(features("")))
    return fit(x, rows.label.to_numpy())


def quality(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, more).

    A null text is an empty one, which has a score too. A row without a doc_id isn't held out. Without labels of both kinds
    all documents are accepted. An empty table gives no rows, and repeated rows one each; a text's words are in memory at
    once, as the text is.
    """
    model = learn(docs, labels, bound)

    def start() -> Callable[[dict], dict]:
        def apply(batch: dict) -> dict:
            return {"doc_id": batch["doc_id"], "score": score(model, np.array([features(t) for t in batch["text"]]))}

        return apply

    scored = map_rows(docs.select("doc_id", "text"), start, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """The rows of docs whose text the ranker accepts, with all columns."""
    from pyspark.sql.functions import pandas_udf

    model = learn(docs, labels, bound)

    @pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series(score(model, np.array([features(t) for t in texts])) >= ACCEPT)

    return docs.where(good("text"))
