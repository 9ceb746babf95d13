"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

`base_spans` finds the plain kinds (email, ip, card, phone) by their exact patterns; these
spans always stay. `candidates` also proposes what the patterns miss: addresses written
with (at) and (dot) or without a dot, numbers in groups without a leading plus, card
numbers that fail their checksum. Four labelers vote for or against each candidate or
abstain: the strict pattern, a gazetteer of endings, country codes and issuer prefixes,
the words around it, and its shape. Expectation-maximisation over the counts of vote
patterns, of which there are 81 per kind at most, estimates how reliable each labeler is
and how likely each pattern is personal data. A logistic span classifier is trained on
these estimates from `SAMPLE` candidates at most, chosen by a hash; candidates that it
accepts are added.

Defined cases: null and empty texts have no spans; positions count code points, the end
is exclusive; without candidates nothing is added; repeated rows are searched each; an
empty table gives an empty result; other columns stay as they are. All patterns take time
in proportion to the text, so very long texts and runs of one class are no special case.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import map_batches, struct_schema, table
from vulnlake.session import write_out

KINDS = ("email", "ip", "card", "phone")
SAMPLE, ROUNDS, STEPS, DECAY, ACCEPT = 20_000, 40, 15, 1e-2, 0.5
#: Code points around a candidate that count as its context.
AROUND = 40
#: Hashed context words in the classifier's features.
WORD_BITS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WRITTEN = re.compile(r"(?:@| ?\((?:at)\) ?| ?\[(?:at)\] ?)([A-Za-z0-9-]+)(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)([A-Za-z0-9-]+))*")
_GROUPS = re.compile(r"(?<![0-9A-Za-z+.,])\(?[0-9][0-9 ().-]{5,}[0-9](?![0-9A-Za-z])")
_NATIONAL = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}")
_WORD = re.compile(r"\w+")

#: Common endings of domain names, country calling codes and words near personal data.
ENDINGS = frozenset("com org net edu gov info io dev app co us uk de fr es it nl eu ch at be pt br mx ar".split())
CALLING = ("1", "33", "34", "44", "49", "31", "39", "41", "43", "32", "351", "52", "54", "55", "61", "81", "86", "91")
CUES = {
    "email": frozenset("mail email e contact write correo adresse courriel kontakt".split()),
    "ip": frozenset("ip host server address addr login from client".split()),
    "card": frozenset("card visa mastercard credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon telefono appelez contact".split()),
}
AGAINST = frozenset("version isbn page section figure table order item invoice total year vol chapter release".split())


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the plain patterns, by kind and then start."""
    found: list[tuple[str, int, int]] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            low = match.end()
        else:
            low = at + 1
        at = text.find("@", low)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that may be personal data; none overlaps a base span."""
    starts = sorted(s for _, s, _ in base)
    reach = list(accumulate((e for _, _, e in sorted(base, key=lambda x: x[1])), max))
    found: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        before = bisect_left(starts, end)  # base spans that begin before this one ends
        if not before or reach[before - 1] <= start:
            found.append((kind, start, end))

    if "@" in text or "(at)" in text or "[at]" in text:
        low = 0
        for m in _WRITTEN.finditer(text):
            start = m.start()
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                add("email", start, m.end())
            low = m.end()
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 7 <= digits <= 19:
                add("card" if digits >= 13 else "phone", *m.span())
    return found


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, int, int, int]:
    """Votes of the pattern, gazetteer, context and shape labelers: 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "email":
        ending = re.split(r"[.\])@]| ", span.lower())[-1]
        known = 1 if ending in ENDINGS else 0
        shape = 1 if "." in span or "dot" in span else -1
        pattern = 1 if base else 0
    elif kind == "ip":
        known, shape, pattern = (-1 if span.startswith(("0.", "127.")) else 1), 1, 1 if base else -1
    elif kind == "card":
        known = 1 if digits.startswith(("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")) else -1
        shape = 1 if luhn(digits) else -1
        pattern = 1 if base else -1
    else:
        known = (1 if digits.startswith(CALLING) else -1) if "+" in span else 0
        shape = 1 if 9 <= len(digits) <= 15 else -1
        pattern = 1 if base or _NATIONAL.fullmatch(span) else -1
    around = _around(text, start, end)
    context = 1 if around & CUES[kind] else -1 if around & AGAINST else 0
    return pattern, known, context, shape


def _around(text: str, start: int, end: int) -> set[str]:
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    return {w.lower() for w in _WORD.findall(before) + _WORD.findall(after)}


def span_features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Numbers of the features that a span has."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    k = KINDS.index(kind)
    shape = [
        min(digits, 19),
        20 + min(len(re.findall(r"[ -]", span)), 4),
        25 + ("+" in span),
        27 + ("(" in span),
        29 + ("." in span),
        31 + ("@" in span),
        33 + (kind == "card" and luhn("".join(c for c in span if c.isdigit()))),
        35 + bool(_NATIONAL.fullmatch(span)),
    ]
    words = {37 + (xxhash.xxh32_intdigest(w) & ((1 << WORD_BITS) - 1)) for w in _around(text, start, end)}
    cues = [37 + (1 << WORD_BITS) + (1 if _around(text, start, end) & CUES[kind] else 0)]
    width = 39 + (1 << WORD_BITS)
    return [k * width + x for x in (*shape, *sorted(words), *cues)]


N_FEATURES = len(KINDS) * (39 + (1 << WORD_BITS))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """EM over (kind, votes, count): how likely each vote pattern is personal data."""
    likely: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        cast = np.array([v for v, _ in own]) + 1  # 0 against, 1 none, 2 for
        count = np.array([n for _, n in own], dtype=float)
        posterior = np.clip(0.5 + (cast - 1).sum(axis=1) / 6, 0.05, 0.95)
        for _ in range(ROUNDS):
            joint = []
            for weight in (count * posterior, count * (1 - posterior)):
                prior = (weight.sum() + 1) / (count.sum() + 2)
                logs = np.full(len(own), np.log(prior))
                for j in range(cast.shape[1]):
                    table = np.bincount(cast[:, j], weight, 3) + 0.5
                    logs += np.log(table / table.sum())[cast[:, j]]
                joint.append(logs)
            posterior = 1 / (1 + np.exp(np.clip(joint[1] - joint[0], -500, 500)))
        likely |= {(kind, v): float(p) for (v, _), p in zip(own, posterior)}
    return likely


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, the last one constant."""

    weights: np.ndarray

    def accepts(self, features: list[int]) -> bool:
        eta = self.weights[features].sum() + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500))) >= ACCEPT


def fit_classifier(features: list[list[int]], target: np.ndarray) -> SpanModel:
    """Logistic regression with soft targets, by Newton steps."""
    x = np.zeros((len(features), N_FEATURES + 1))
    for row, own in zip(x, features):
        row[own] = 1
    x[:, -1] = 1
    used = np.flatnonzero(x.any(axis=0)) if len(x) else np.array([N_FEATURES])
    small, weights = x[:, used], np.zeros(N_FEATURES + 1)
    inner = np.zeros(len(used))
    for _ in range(STEPS if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(small @ inner, -30, 30)))
        gradient = small.T @ (target - p) / len(x) - DECAY * inner
        curve = (small * (p * (1 - p))[:, None]).T @ small / len(x) + DECAY * np.eye(len(used))
        inner += np.linalg.solve(curve, gradient)
    weights[used] = inner
    if not len(x):
        weights[-1] = -1.0
    return SpanModel(weights)


def fit_spans(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SpanModel:
    """Label all candidates of a corpus by votes and train the span classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
                for kind, start, end, strict in spans:
                    cast = votes(text, kind, start, end, strict)
                    rows.append((kind, list(cast), span_features(text, kind, start, end)))
            columns = list(zip(*rows)) or [(), (), ()]
            types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "votes", "features"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = write_out(map_batches(texts, run, "kind string, votes array<int>, features array<int>"), "spans")
    # At most 81 patterns of each kind.
    counted = found.groupBy("kind", "votes").count().collect()
    likely = estimate([(r["kind"], tuple(r["votes"]), r["count"]) for r in counted])
    order = F.xxhash64("features", F.monotonically_increasing_id())
    rows = found.orderBy(order).limit(sample).collect()
    target = np.array([likely[r["kind"], tuple(r["votes"])] for r in rows])
    return fit_classifier([r["features"] for r in rows], target)


def detect(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the classifier adds."""
    base = base_spans(text)
    added = [s for s in candidates(text, base) if model.accepts(span_features(text, *s))]
    return base, added


def listed(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def find_spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Rows (row, base, spans): all columns of a document, its base spans and all its spans."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(x.as_py() or "", model) for x in batch.column(1)]
            base, spans = [listed(b) for b, _ in found], [listed(b + a) for b, a in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base), pa.array(spans)], ["row", "base", "spans"])

    return map_batches(rows, run, struct_schema(rows, "row", "base string, spans string"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents with personal data replaced, in the same columns; null texts stay null."""
    model = fit_spans(docs, text_col, sample)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(1):
                text = value.as_py()
                texts.append(text and redact_text(text, sum(detect(text, model), [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["row", "text"])

    done = map_batches(rows, run, struct_schema(rows, "row", "text string"))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit_spans(docs))
    counts = [F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("row.doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
