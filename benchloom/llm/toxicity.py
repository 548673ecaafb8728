"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another.  Each model is a logistic regression over the words of a text and the
probabilities of all earlier categories.  For training, those probabilities come from models that did not see
the row (out of fold), so a later model learns how far to trust them; for scoring they come from the models
fitted on all training rows.

The models keep few words (an absolute penalty), so wrong labels are not learned by heart.  They are fitted on at
most ``train_rows`` labelled documents, taken by hash of their id - the only bounded sample.  One task fits one
model: the folds of a category and its model of all rows are fitted side by side, and what a task holds is bounded by
the sample.  Words that stand in at least ``least_docs`` of a model's rows are its features.  Every
document is scored whole, where it lies.

Defined results: a null or empty text has no words and is scored by the models' intercepts; labels that are null
or without a document are not used; several labels of one document count as one, the largest; a category with
fewer than two classes in the sample gets the sample's constant as probability (0 without labels); repeated rows
are scored alike; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import stored, table

#: Categories in the order of the chain, each with the SQL of its label.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
TRAIN_ROWS, FOLDS, LEAST_DOCS, FEATURES = 10_000, 3, 10, 1 << 16
PENALTY, STEPS, TOLERANCE = 0.002, 150, 1e-4
#: Probability from which a document is toxic: a toxic document that stays weighs three times a clean one that goes.
THRESHOLD = 0.25
WORD = re.compile(r"[^\W_]+")
#: Key of the constant of a model; no word is empty.
CONSTANT = ""


def words_of(text: str | None) -> list[str]:
    """The different words of a text, in order."""
    return sorted(set(WORD.findall(text.lower()))) if isinstance(text, str) else []


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_linear(
    words: list[list[str]], inputs: np.ndarray, names: list[str], labels: np.ndarray, least_docs: int, features: int
) -> dict[str, float]:
    """Weights by word, by name of an input column, and the ``CONSTANT``.

    A word counts by its rarity, so words of every text hardly matter.  Logistic loss with an absolute penalty on all
    but the constant, by accelerated proximal steps.
    """
    if len(set(labels.tolist())) < 2:
        return {CONSTANT: math.inf if len(labels) and labels[0] > 0 else -math.inf}
    seen = Counter(w for ws in words for w in ws)
    frequent = sorted((w for w, n in seen.items() if n >= least_docs), key=lambda w: (-seen[w], w))[:features]
    place = {w: i for i, w in enumerate(frequent)}
    lists = [[place[w] for w in ws if w in place] for ws in words]
    column = np.array([i for one in lists for i in one], dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), [len(one) for one in lists])
    rows, width = len(lists), len(frequent)
    rarity = np.log([(rows + 1) / seen[w] for w in frequent])

    def forward(w: np.ndarray) -> np.ndarray:
        by_words = np.bincount(row, weights=(w[:width] * rarity)[column], minlength=rows)
        return by_words + inputs @ w[width:-1] + w[-1]

    def backward(r: np.ndarray) -> np.ndarray:
        by_words = np.bincount(column, weights=r[row], minlength=width) * rarity
        return np.concatenate([by_words, inputs.T @ r, [r.sum()]])

    # The steepest curvature, by power iteration, bounds the step.
    ahead, top = np.ones(width + len(names) + 1), 1.0
    for _ in range(20):
        ahead = backward(forward(ahead / np.linalg.norm(ahead)))
        top = np.linalg.norm(ahead)
    step = 1 / (1.05 * top / 4 / rows)
    shrink = np.full(len(ahead), PENALTY * step)
    shrink[-1] = 0
    weights = ahead = np.zeros(len(ahead))
    momentum = 1.0
    for _ in range(STEPS):
        moved = ahead - step * backward(_squash(forward(ahead)) - labels) / rows
        moved = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        # Start the momentum anew where it points uphill.
        if (ahead - moved) @ (moved - weights) > 0:
            momentum = 1.0
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = moved + (momentum - 1) / after * (moved - weights)
        change = np.abs(moved - weights).max()
        weights, momentum = moved, after
        if change < TOLERANCE:
            break
    weights[:width] *= rarity
    return {k: float(w) for k, w in zip([*frequent, *names, CONSTANT], weights) if w or k == CONSTANT}


def probability(model: dict[str, float], words: list[str], inputs: dict[str, float]) -> float:
    found = model.get(CONSTANT, -math.inf)
    if math.isinf(found):
        return float(found > 0)
    found += sum(model.get(name, 0.0) * p for name, p in inputs.items())
    found += sum(model.get(w, 0.0) for w in words)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, found))))


class Chain:
    """The fitted models of the categories, in order."""

    def __init__(self, models: dict[str, dict[str, float]]):
        self.models = models

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column ``p_<category>`` for each category."""
        models = self.models

        @F.pandas_udf(", ".join(f"p_{name} double" for name in models))
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found = []
                for text in texts:
                    words, inputs = words_of(text), {}
                    for name, model in models.items():
                        inputs[f"p_{name}"] = probability(model, words, inputs)
                    found.append(inputs)
                yield pd.DataFrame(found, columns=[f"p_{name}" for name in models], dtype=float)

        scored = docs.withColumn("__scores", scores("text"))
        return scored.withColumns({f"p_{name}": F.col(f"__scores.p_{name}") for name in models}).drop("__scores")


def _fitter(label: str, inputs: list[str], least_docs: int, features: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One model: its weights, and the probabilities of the rows it did not see."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        held = rows["held"].to_numpy(dtype=bool)
        known = rows[~held & rows[label].notna().to_numpy()]
        model = fit_linear(
            known["words"].tolist(),
            known[inputs].to_numpy(dtype=float).reshape(len(known), len(inputs)),
            inputs,
            known[label].to_numpy(dtype=float),
            least_docs,
            features,
        )
        weights = pd.DataFrame({"row": None, "name": list(model), "value": list(model.values())})
        apart = rows[held]
        p = [probability(model, ws, dict(zip(inputs, x))) for ws, x in zip(apart["words"], apart[inputs].to_numpy(dtype=float))]
        out = pd.concat([weights, pd.DataFrame({"row": apart["row"].to_numpy(), "name": None, "value": p})])
        out["fit"] = rows["fit"].iloc[0]
        out["row"] = out["row"].astype("Int64")
        return out[["fit", "row", "name", "value"]]

    return fit


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str] = CATEGORIES,
    train_rows: int = TRAIN_ROWS,
    folds: int = FOLDS,
    least_docs: int = LEAST_DOCS,
    features: int = FEATURES,
) -> Chain:
    """Fit the chain on at most ``train_rows`` labelled ``docs`` (``doc_id``, ``text``), whatever else is labelled.

    A label is a number from 0 to 1; anything else is none.
    """
    given = lambda sql: F.max(F.when(F.expr(sql).between(0, 1), F.expr(sql))).cast("double")
    marks = labels.groupBy("doc_id").agg(*[given(sql).alias(n) for n, sql in categories.items()])
    marks = marks.where(F.coalesce(*categories).isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi")
    marks = marks.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(train_rows)
    # At most train_rows short rows.
    marks = stored(marks, "labels")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    # Copies of an id (repeated rows) stand once, so the sample stays within its bound.
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    chosen = chosen.groupBy("doc_id", *categories).agg(F.max("text").alias("text"))
    rows = stored(
        chosen.select(
            F.col("doc_id").alias("row"),
            *categories,
            words(F.coalesce("text", F.lit(""))).alias("words"),
            F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(folds)).cast("int").alias("fold"),
        ),
        "training",
    )
    models, inputs = {}, []
    for place, name in enumerate(categories):
        # Fit i leaves out fold i; the last one leaves out none.
        last = place == len(categories) - 1
        fits = F.array(*[F.lit(i) for i in ([folds] if last else range(folds + 1))])
        spread = rows.withColumn("fit", F.explode(fits)).withColumn("held", F.col("fit") == F.col("fold"))
        spread = spread.select("fit", "held", "row", "words", name, *inputs)
        fitted = stored(
            spread.groupBy("fit").applyInPandas(
                _fitter(name, list(inputs), least_docs, features), "fit int, row long, name string, value double"
            ),
            "fitted",
        )
        # At most ``features`` weights.
        whole = fitted.where((F.col("fit") == folds) & F.col("name").isNotNull())
        models[name] = {r["name"]: r["value"] for r in whole.collect()}
        if not last:
            apart = fitted.where("row IS NOT NULL").select("row", F.col("value").alias(f"p_{name}"))
            rows = stored(rows.join(apart, "row"), "training")
        inputs = [*inputs, f"p_{name}"]
    return Chain(models)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_low_quality``, ``p_toxic`` and ``is_toxic``."""
    scored = fit_chain(docs, labels).score(docs)
    return scored.withColumn("is_toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not reject, with all their columns."""
    return toxicity(docs, labels).where(~F.col("is_toxic")).select(docs.columns)


def op2_toxicity(spark, folder: str) -> DataFrame:
    scored = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "is_toxic"
    )


QUERIES = {"op2_toxicity": op2_toxicity}
