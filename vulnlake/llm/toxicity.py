"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and their first letters, hashed. Grades 0..K are
predicted by P(grade <= k) = sigmoid(threshold[k] - w.x): one weight vector for all ordered
thresholds. The result is the expected severity, sum over k of P(grade > k).

The model is fitted on at most `LABELLED` labelled documents, chosen by a hash of the id.
Their features, which are bounded with them, come to the driver; features that do not
separate the grades are dropped first, so that common words of long texts add nothing.
All documents are then scored in one pass.

Where labels only say toxic or not, `graded` makes three grades: 0 for clean, and 1 or 2
for toxic documents below or above the median density of telling features.

Defined cases: null and empty texts have no features and take the severity of the
thresholds alone, which is low; labels with a null id or grade are ignored, the largest
grade of a repeated id counts; without labels of two grades every severity is 0; repeated
rows are scored each; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import bounded_labels, map_batches, struct_schema, table, words_of

LABELLED = 10_000
BITS, PREFIXES = 22, (3, 4, 5, 6, 7)
#: Features kept for the fit, and the z-score of their log odds that they need.
FEATURES, TELLING = 8192, 3.0
STEPS, RATE, DECAY = 400, 0.1, 1e-4
REJECT = 0.5
_EDGES = string.punctuation + "«»„“”‘’¡¿…"


def features(word: str) -> set[int]:
    """Hashed features of one word: itself and its beginnings, without case and punctuation."""
    word = word.lower().strip(_EDGES)
    if not word:
        return set()
    names = ["=" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return {xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1) for name in names}


@dataclass(frozen=True)
class Ordinal:
    """Weights of hashed features and ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k in a column of its own."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Ordinal:
    """Fit on each row's feature ids; grades count from 0 without gaps."""
    top = int(grades.max(initial=0))
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    if top == 0:
        return Ordinal(flat[:0], np.zeros(0), np.full(1, np.inf))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    ids = telling(flat, (grades > 0)[row], int((grades > 0).sum()), int((grades == 0).sum()))[0]
    used = np.isin(flat, ids)
    row, at = row[used], np.searchsorted(ids, flat[used])
    share = np.array([(grades <= k).mean() for k in range(top)])
    cuts = np.log(share / (1 - share))
    # Thresholds are the first one and logarithms of the gaps, so they stay in order.
    params = np.concatenate([np.zeros(len(ids)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        gradient = _gradient(params, row, at, grades, top)
        gradient[: len(ids)] -= DECAY * params[: len(ids)]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params += RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Ordinal(ids, params[: len(ids)], _cuts(params[len(ids) :]))


def _cuts(params: np.ndarray) -> np.ndarray:
    return params[0] + np.concatenate([[0], np.cumsum(np.exp(params[1:]))])


def _gradient(params: np.ndarray, row: np.ndarray, at: np.ndarray, grades: np.ndarray, top: int) -> np.ndarray:
    """Gradient of the mean log likelihood."""
    n, n_ids = len(grades), len(params) - top
    cuts = np.concatenate([[-np.inf], _cuts(params[n_ids:]), [np.inf]])
    eta = np.bincount(row, weights=params[at], minlength=n)
    sigmoid = lambda x: 1 / (1 + np.exp(np.clip(-x, -500, 500)))
    low, high = sigmoid(cuts[grades] - eta), sigmoid(cuts[grades + 1] - eta)
    likely = np.maximum(high - low, 1e-12)
    by_eta = low + high - 1
    by_high, by_low = high * (1 - high) / likely, low * (1 - low) / likely
    by_cut = np.bincount(grades, by_high, top + 1)[:top] - np.bincount(grades, by_low, top + 1)[1:]
    gaps = np.exp(params[n_ids + 1 :])
    by_params = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
    return np.concatenate([np.bincount(at, by_eta[row], n_ids), by_params]) / n


def telling(flat: np.ndarray, marked: np.ndarray, n_marked: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """The features whose log odds between marked and other rows are far from 0, and those odds."""
    inside = np.bincount(flat[marked], minlength=1 << BITS).astype(np.float32)
    outside = np.bincount(flat[~marked], minlength=1 << BITS).astype(np.float32)
    odds = np.log((inside + 0.5) / (n_marked - inside + 0.5)) - np.log((outside + 0.5) / (n_other - outside + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (inside + 0.5) + 1 / (outside + 0.5))
    ids = np.flatnonzero((z >= TELLING) & (inside + outside > 0))
    best = np.sort(ids[np.argsort(-z[ids], kind="stable")[:FEATURES]])
    return best, odds[best]


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2: clean, toxic, and toxic with at least the median density of telling features."""
    toxic = toxic > 0
    grades = toxic.astype(np.int64)
    if not toxic.any() or toxic.all():
        return np.zeros(len(rows), dtype=np.int64)
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    ids, odds = telling(flat, toxic[row], int(toxic.sum()), int((~toxic).sum()))
    hits = np.bincount(row, np.isin(flat, ids[odds > 0]), len(rows))
    density = hits / np.maximum([len(r) for r in rows], 1)
    grades[toxic & (density >= np.median(density[toxic]))] = 2
    return grades if (grades == 1).any() else np.minimum(grades, 1)


def sample_features(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, labelled: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids and labels of at most `labelled` documents."""
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("long").alias("__label")
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    chosen = bounded_labels(known, texts, "__id", ["__label"], labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, distinct = words_of(batch.column(1))
            sets = [features(w) for w in distinct.to_pylist()]
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                rows.append(sorted(set().union(*(sets[c] for c in np.unique(codes[a:b]).tolist()))))
            columns = [batch.column(0), pa.array(rows, type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "ids"])

    rows = map_batches(chosen.select("__label", "__text"), run, "label long, ids array<int>").toArrow()
    ids = rows.column("ids").combine_chunks()
    flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets)
    return np.split(flat, offsets[1:-1] - offsets[0]) if len(ids) else [], np.asarray(rows.column("label"), dtype=np.int64)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED
) -> Ordinal:
    """A model from labels (id, toxic)."""
    rows, toxic = sample_features(docs, labels, id_col, text_col, "toxic", labelled)
    return fit(rows, graded(rows, toxic))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows with severity, p_toxic (grade above 0) and grade (the likeliest) after them."""
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, distinct = words_of(batch.column(1))
            by_word = np.zeros(len(distinct))
            found: dict[int, list[int]] = {}
            for k, word in enumerate(distinct.to_pylist()):
                known = [f for f in features(word) if f in weight]
                if known:
                    found[k] = known
                    by_word[k] = 1
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            hit = np.flatnonzero(by_word[codes]) if len(codes) else codes
            # Words that share a feature count it once in a text, as in training.
            sets = [found[c] for c in codes[hit].tolist()]
            flat = np.array([f for s in sets for f in s], dtype=np.int64)
            where = np.repeat(doc[hit], [len(s) for s in sets])
            pairs = np.unique(where << BITS | flat)
            eta = np.bincount(pairs >> BITS, [weight[f] for f in (pairs & ((1 << BITS) - 1)).tolist()], batch.num_rows)
            above = model.above(eta)
            ladder = np.concatenate([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))], axis=1)
            likeliest = np.argmax(ladder[:, :-1] - ladder[:, 1:], axis=1).astype(np.int32)
            columns = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(likeliest)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "severity", "p_toxic", "grade"])

    schema = struct_schema(rows, "row", "severity double, p_toxic double, grade int")
    return map_batches(rows, run, schema)


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reject: float = REJECT,
    labelled: int = LABELLED,
) -> DataFrame:
    """The documents that are less likely than `reject` to have a grade above 0."""
    scored = score(docs, fit_toxicity(docs, labels, id_col, text_col, labelled), text_col)
    return scored.where(F.col("p_toxic") < reject).select("row.*")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("row.doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= REJECT).alias("rejected"))
