"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the models are fitted on, at most, chosen by hash of their id.
SAMPLE = 6_000
FOLDS = 5
#: Features kept per category, those that tell its classes apart best.
FEATURES = 4_096
#: Lengths of the beginnings of words that count as features beside the word.
STEMS = (4, 5, 6)
BITS = 24
#: The categories in order of the chain, as conditions on a row of labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
MEMO_WORDS = 500_000

_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"


def word_features(word: str) -> tuple[int, ...]:
    bare = word.strip(_EDGES)
    if not bare:
        return ()
    names = [f"={bare}", *(f"{k}{bare[:k]}" for k in STEMS if len(bare) > k)]
    return tuple(xxhash.xxh64_intdigest(n) & ((1 << BITS) - 1) for n in names)


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text."""
    found = {f for w in set((text or "").lower().split()) for f in word_features(w)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Linear:
    """Logistic regression over chosen features and what earlier models of the chain say."""

    def __init__(self, rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-3):
        n = len(rows)
        flat, of = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(n), [len(r) for r in rows])
        names, at = np.unique(flat, return_inverse=True)
        has, pos = np.bincount(at, minlength=len(names)), np.bincount(at, weights=y[of], minlength=len(names))
        p = y.mean() if n else 0.0
        # chi-square of presence against the class
        gain = np.where(has > 2, (pos - has * p) ** 2 / np.maximum(has * p * (1 - p) * (1 - has / max(n, 1)), 1e-9), 0)
        best = np.argsort(-gain, kind="stable")[:FEATURES]
        best = np.sort(best[gain[best] > 3.84])
        self.names = names[best]
        new = np.full(len(names), -1)
        new[best] = np.arange(len(best))
        col = new[at]
        of, col = of[col >= 0], col[col >= 0]
        k = len(best)
        w, u, b = np.zeros(k), np.zeros(extra.shape[1]), float(np.log((p + 1e-6) / (1 - p + 1e-6)))
        # Adam on the whole batch
        m = np.zeros(k + len(u) + 1)
        v = np.zeros_like(m)
        for t in range(1, rounds + 1 if n else 1):
            z = np.bincount(of, weights=w[col], minlength=n) + extra @ u + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.concatenate([np.bincount(col, weights=d[of], minlength=k) + decay * w / 10, d @ extra + decay * u / 10, [d.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, u, b = w - step[:k], u - step[k:-1], b - step[-1]
        self.weights, self.extra, self.bias = w, u, float(b)

    def score(self, found: np.ndarray, extra: np.ndarray) -> float:
        at = np.searchsorted(self.names, found)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, max(len(self.names) - 1, 0))] == found)] if len(self.names) else at[:0]
        z = self.weights[at].sum() + extra @ self.extra + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Chain:
    """One model per category; each sees the probabilities of the categories before it.

    In training these are out-of-fold predictions, so that a model learns how far to trust what it will see.
    """

    def __init__(self, ids: Sequence[int], rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        fold = np.array([xxhash.xxh64_intdigest(str(i)) % folds for i in ids], np.int64)
        extra = np.zeros((len(rows), 0))
        self.models, self.held_out = [], []
        for y in labels.T:
            out = np.zeros(len(rows))
            for f in range(folds):
                rest = np.flatnonzero(fold != f)
                model = Linear([rows[i] for i in rest], extra[rest], y[rest])
                for i in np.flatnonzero(fold == f):
                    out[i] = model.score(rows[i], extra[i])
            self.models.append(Linear(rows, extra, y))
            self.held_out.append(out)
            extra = np.column_stack([extra, out])
        self.limit = _best_limit(self.held_out[-1], labels[:, -1]) if len(rows) else 0.5
        self.names = np.unique(np.concatenate([m.names for m in self.models])) if self.models else np.zeros(0, np.int64)

    def predict(self, found: np.ndarray) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(model.score(found, np.array(out)))
        return out


def _best_limit(scores: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the last category best in held-out predictions, halfway to the next below.

    Best is F0.5: a clean document that goes weighs more than a toxic one that stays.
    """
    order = np.argsort(-scores, kind="stable")
    ranked, hits = scores[order], np.cumsum(y[order])
    if not hits[-1]:
        return 0.5
    best = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * hits[-1])
    best[:-1][ranked[:-1] == ranked[1:]] = 0
    k = int(best.argmax())
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(ranked) else ranked[k])) / 2)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents; rows without a text or with a null label are left out."""
    wanted = labels.select("doc_id", *(F.expr(rule).cast("double").alias(f"_{k}") for k, (_, rule) in enumerate(categories)))
    # chosen among the labels, so that their number is bounded before they meet texts, which then stay where they are
    picked = wanted.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    chosen = texts.join(F.broadcast(picked), "doc_id").select(*picked.columns, "text")

    def features(batches):
        for batch in batches:
            rows = [text_features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "found"])

    # the texts themselves stay on the executors
    marks = ", ".join(f"_{k} double" for k in range(len(categories)))
    table = chosen.mapInArrow(features, f"doc_id long, {marks}, found array<int>").toArrow()
    labels_ = np.column_stack([table.column(f"_{k}").to_numpy() for k in range(len(categories))])
    found = table.column("found").combine_chunks()
    flat, edges = found.flatten().to_numpy(), found.offsets.to_numpy()
    rows = np.split(flat, (edges - edges[0])[1:-1]) if len(table) else []
    return Chain(table.column("doc_id").to_pylist(), rows, labels_)


def score(docs: DataFrame, chain: Chain, categories=CATEGORIES, limit: float | None = None) -> DataFrame:
    """All columns of ``docs(text, ...)``, ``p_<category>`` each, and ``rejected``: the last probability reaches the limit.

    Without a limit the chain's own holds, which parted held-out documents best.
    A null text counts as empty; an input column with the name of a new one is replaced.
    """
    limit = chain.limit if limit is None else limit
    model = docs.sparkSession.sparkContext.broadcast(chain)
    new = [*(f"p_{name}" for name, _ in categories), "rejected"]
    kept = docs.drop(*new)
    at = kept.columns.index("text")

    def rate(batches):
        chain = model.value
        known = dict.fromkeys(chain.names.tolist())
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                found: set[int] = set()
                for word in set((text or "").lower().split()):
                    if (own := memo.get(word)) is None:
                        own = memo[word] = tuple(f for f in word_features(word) if f in known)
                    if own:
                        found.update(own)
                rows.append(chain.predict(np.sort(np.fromiter(found, np.int64, len(found)))))
            table = np.array(rows, float).reshape(len(rows), len(new) - 1)
            extra = [pa.array(table[:, k]) for k in range(len(new) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra, pa.array(table[:, -1] >= limit)], names=[*batch.schema.names, *new]
            )

    fields = [*kept.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} double" for n in new[:-1]), "rejected boolean"])
    return kept.mapInArrow(rate, schema)


def classify(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: float | None = None) -> DataFrame:
    """Train the chain on the labelled documents and score all. Without labelled documents no document is rejected."""
    return score(docs, train(docs, labels, categories), categories, limit)
