"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's features are properties of its whole text (letter classes, repeated and
distinct words, repeated lines, lengths), each also cut at quantiles of the training rows.
Weights are learned from pairs of a preferred and another document by logistic loss on
the difference of their features. The threshold is a quantile of the training scores, by
default the share of documents not preferred; a score is the chance by which a document
beats one that stands at the threshold.

The fit uses every labelled document: means, deviations, cuts and the threshold come from
all of them, and each is in at least one pair. All pairs of two sides would be quadratic, so
both sides are put in the order of a hash of the id and the smaller one is gone through
again and again; at least `PAIRS` pairs are made. Sums are made in the tasks, which
send one array each; the driver holds numbers of features, never rows. Quantiles are read
off counts in `BINS` equal steps, narrowed `ZOOMS` times. Every document is then scored in
one pass.

Defined cases: null and empty texts are scored by features that are all 0; labels with a
null id or label are ignored, the largest label of a repeated id counts; if one of the
labels is missing, every score is that of the other label, 0.25 or 0.75, and 0.5 if both
are; repeated rows
are scored each; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import map_batches, segment_sums, struct_schema, table, words_of
from vulnlake.operators.ordered import with_running
from vulnlake.session import write_out

PAIRS = 40_000
#: Steps between the bounds of a quantile, and how often one step becomes the new bounds.
BINS, ZOOMS = 256, 4
#: Quantile cuts per feature, weight decay and Newton steps of the fit.
CUTS, DECAY, STEPS = 8, 1e-3, 8
#: Classes of bytes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "exclaim": b"!?",
    "table": b"|\t",
    "symbol": b"#$%&*+<=>@[\\]^_`{}~/",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}
#: Labels of this remainder of the hash of an id are kept for measuring.
FOLDS, HELD_OUT = 3, 1


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = texts.cast(pa.large_binary())
    bounds = np.asarray(pc.binary_length(raw), dtype=np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
    starts = np.cumsum(bounds) - bounds
    full = np.flatnonzero(bounds)
    n = len(texts)
    columns = [np.log1p(bounds)]
    for members in CLASSES.values():
        inside = np.zeros(256, dtype=np.uint8)
        inside[list(members)] = 1
        count = np.zeros(n)
        if len(full):
            count[full] = np.add.reduceat(inside[data], starts[full], dtype=np.int64)
        columns.append(np.sqrt(count / np.maximum(bounds, 1)))
    offsets, codes, _ = words_of(texts)
    words = np.diff(offsets)
    row = np.repeat(np.arange(n), words)
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    columns += [np.log1p(words), bounds / np.maximum(words, 1), segment_sums(same, offsets) / np.maximum(words, 1)]
    columns.append(_distinct(row, codes, n) / np.maximum(np.sqrt(words), 1))
    lines = pc.split_pattern(texts, "\n")
    cuts = np.asarray(lines.offsets, dtype=np.int64)
    cuts = cuts - cuts[0]
    line_codes = np.asarray(lines.flatten().dictionary_encode().indices, dtype=np.int64)
    line_row = np.repeat(np.arange(n), np.diff(cuts))
    columns.append(1 - _distinct(line_row, line_codes, n) / np.maximum(np.diff(cuts), 1))
    return np.stack(columns, axis=1)


def _distinct(row: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each row has."""
    pairs = np.unique(row * (codes.max(initial=0) + 1) + codes)
    return np.bincount(pairs // (codes.max(initial=0) + 1), minlength=n).astype(float)


@dataclass(frozen=True)
class Ranking:
    """Standardised features with their cuts, their weights and the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    weights: np.ndarray
    threshold: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        steps = x[:, :, None] > self.cuts[None]
        return np.concatenate([z, steps.reshape(len(x), -1)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.raw(x), -500, 500)))


def _totals(rows: DataFrame, columns: list[str], of: Callable[..., np.ndarray]) -> np.ndarray | float:
    """Sum over all rows of an array that `of` makes of each batch; every task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + of(*(_matrix(c) for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([np.ravel(total).tolist()])], ["total"])

    sent = map_batches(rows.select(*columns), run, "total array<double>").toArrow().column("total")
    return sum((np.asarray(part.values) for part in sent if len(part) > 1), 0.0)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of equally long lists as one row each."""
    if not pa.types.is_list(column.type):
        return np.asarray(column)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _quantiles(rows: DataFrame, values: Callable[..., np.ndarray], columns: list[str], counts: np.ndarray,
               low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Quantiles (k, q) of k lists of numbers within bounds; `values` gives a batch's numbers as (k, n), NaN for none.

    The middle of the two neighbouring places is taken; a place is known to a step of the last bounds.
    """
    lists, wanted = len(low), len(at)
    place = (counts[:, None] - 1) * at
    ends = []
    for rank in (np.floor(place), np.ceil(place)):
        under = np.repeat(low[:, None], wanted, axis=1)
        over = np.repeat(high[:, None], wanted, axis=1)
        for _ in range(ZOOMS):
            # A step at the very end keeps the greatest value inside.
            steps = under[..., None] + (over - under)[..., None] * np.arange(1, BINS) / BINS

            def below(*batch: np.ndarray, steps: np.ndarray = steps) -> np.ndarray:
                found = np.sort(values(*batch), axis=1)
                return np.array([np.searchsorted(found[k], steps[k].ravel()) for k in range(lists)], dtype=float)

            smaller = _totals(rows, columns, below).reshape(lists, wanted, BINS - 1)
            step = (smaller <= rank[..., None]).sum(axis=2)
            width = (over - under) / BINS
            under, over = under + step * width, under + (step + 1) * width
        ends.append((under + over) / 2)
    return (ends[0] + ends[1]) / 2


def fit(rows: DataFrame, quantile: float | None = None, pairs: int = PAIRS) -> Ranking:
    """Learn from rows (id, label, x): features `x`, preferred where `label` is over 0."""
    width = text_features(pa.array([""])).shape[1]
    sizes = rows.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    good, bad = int(sizes[0]), int(sizes[1])
    if not good + bad:
        return Ranking(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(2 * width), 0.0)
    spread = (
        rows.select(F.posexplode("x").alias("at", "x"))
        .groupBy("at")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"), F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("at")
        .toArrow()
    )
    mean, scale, low, high = (np.asarray(spread.column(c)) for c in ("mean", "scale", "low", "high"))
    scale = np.maximum(scale, 1e-9)
    at = np.arange(1, CUTS) / CUTS
    # Cuts at the quantiles of either side, so that rare kinds of text are told apart too.
    sides = [n for n in (good, bad) if n]

    def by_side(label: np.ndarray, x: np.ndarray) -> np.ndarray:
        wanted = [label > 0] * bool(good) + [label <= 0] * bool(bad)
        return np.concatenate([np.where(side[:, None], x, np.nan).T for side in wanted])

    counts = np.repeat(sides, width)
    found = _quantiles(rows, by_side, ["label", "x"], counts, np.tile(low, len(sides)), np.tile(high, len(sides)), at)
    cuts = np.concatenate(np.split(found, len(sides)), axis=1)
    blank = Ranking(mean, scale, cuts, np.zeros(width * (1 + cuts.shape[1])), 0.0)
    if not good or not bad:
        odds = np.log(3.0) if good else -np.log(3.0)
        return Ranking(mean, scale, cuts, blank.weights, -odds)
    paired = write_out(_pairs(rows, good, bad, pairs), "pairs")
    n = paired.count()
    weights = np.zeros(len(blank.weights))
    for _ in range(STEPS):

        def slopes(left: np.ndarray, right: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
            d = blank.expand(left) - blank.expand(right)
            lose = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))
            return np.concatenate([d.T @ lose, np.ravel((d * (lose * (1 - lose))[:, None]).T @ d)])

        total = _totals(paired, ["left", "right"], slopes) / n
        gradient, curve = np.split(total, [len(weights)])
        curve = curve.reshape(len(weights), -1) + DECAY * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, gradient - DECAY * weights)
    model = Ranking(mean, scale, cuts, weights, 0.0)
    share = bad / (good + bad) if quantile is None else quantile
    # No score is beyond the sum of what every feature and cut can add.
    most = np.array([1e-9 + np.abs(weights) @ np.concatenate([np.full(width, 8.0), np.ones(len(weights) - width)])])
    threshold = _quantiles(rows, lambda x: model.raw(x)[None], ["x"], np.array([good + bad]), -most, most, np.array([share]))
    return Ranking(mean, scale, cuts, weights, float(threshold[0, 0]))


def _pairs(rows: DataFrame, good: int, bad: int, least: int) -> DataFrame:
    """Pairs (left, right) of the features of a preferred and another row; each row is in one at least."""
    ordered = with_running(
        rows.withColumn("hash", F.xxhash64(F.col("id").cast("string"))), ["hash", "id"],
        sums={"left_n": (F.col("label") > 0).cast("long"), "right_n": (F.col("label") <= 0).cast("long")},
    )
    n = max(good, bad)
    rounds = -(-least // n)
    # In every further round the sides are moved on by one place against each other.
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("turn")

    def side(count: int, of: str, wanted: object, moved: bool) -> DataFrame:
        places = F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // count).cast("long"))
        mine = ordered.where(wanted).select((F.col(f"{of}_n") - 1).alias("place"), F.col("x").alias(of))
        again = mine.select("place", of, F.explode(places).alias("lap"))
        slots = again.select((F.col("place") + F.col("lap") * count).alias("slot"), of).where(F.col("slot") < n)
        slot = (F.col("slot") + F.col("turn")) % n if moved else F.col("slot")
        return slots.select("slot", of, turns).select("turn", slot.alias("slot"), of)

    left = side(good, "left", F.col("label") > 0, False)
    return left.join(side(bad, "right", F.col("label") <= 0, True), ["turn", "slot"]).select("left", "right")


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    quantile: float | None = None,
) -> Ranking:
    """A ranking from all labels (id, 0 or 1)."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("long")).alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x))], ["id", "x"])

    # Features are far shorter than texts, so they are what travels to the labels.
    found = map_batches(texts, run, T.StructType([texts.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    return fit(write_out(found.join(known, "id"), "labelled"), quantile)


def score(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """Rows (row, score): all columns of a document as a struct, and its score from 0 to 1."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = model.score(text_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["row", "score"])

    return map_batches(rows, run, struct_schema(rows, "row", "score double"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = score(docs, fit_quality(docs, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
