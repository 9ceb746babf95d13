"""SimHash near-duplicates: fingerprints of whole texts, compared bit-sliced.

A fingerprint bit is set if it is set in more than half of a text's shingle hashes.
Fingerprints within `RADIUS` bits are linked. By the pigeonhole principle two of them
agree in at least `PARTS - RADIUS` of `PARTS` bit ranges, so every choice of that many
ranges is a key, and only fingerprints with an equal key are compared. The comparison
itself is bit-sliced: fingerprints are stored as 64 vertical planes, the distances of all
rows to the row `d` places further are counted together in carry-save counters, and
blocks of rows drop out once all their counters have passed the radius.

Defined cases: a null or empty text, or one of white space, has fingerprint 0, which
links like any other. Fewer words than a shingle give one shingle of all words. Repeated
rows of one id keep that id in every output row. Null ids are left out of components'
minima and keep a row of their own. An empty table gives an empty result. Extra columns
are ignored by `simhash_components` and kept by `simhash_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import connected, least_labels, map_batches, table
from vulnlake.session import write_out

WORDS, RADIUS, PARTS, SEED = 3, 3, 5, 42
#: Fingerprints of one key that are compared in one piece; larger groups are tiled.
TILE = 2048
#: Rows of a task that are sliced into planes at once.
CHUNK = 1 << 17
#: Words of 64 rows each that are abandoned together.
BLOCK = 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of one text, as an unsigned 64-bit integer."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(starts)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS):
    """One row (id, fp) per document; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x.as_py() or b"", words) for x in batch.column(1)]
            fps = np.array(marks, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, "id long, fp long")


def key_masks(radius: int = RADIUS, parts: int = PARTS) -> list[int]:
    """Masks of every choice of parts - radius bit ranges."""
    edges = [64 * k // parts for k in range(parts + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(ranges, parts - radius)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of n fingerprints: plane k holds bit k of row i at bit i."""
    unit = 64 * BLOCK
    padded = np.zeros((len(fps) // unit + 2) * unit, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_shift(planes: np.ndarray, live: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Rows i in `live` (bit vector) whose row i + shift differs in at most `radius` bits.

    Carry-save counters over the planes, started so that they overflow at radius + 1;
    blocks of words in which every live row has overflowed are abandoned.
    """
    n_bits = radius.bit_length()
    start = (1 << n_bits) - 1 - radius
    blocks = np.flatnonzero(live.reshape(-1, BLOCK).any(axis=1))
    at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
    word, bit = divmod(shift, 64)
    last = planes.shape[1] - 1
    over = ~live[at]
    fill = [~np.uint64(0) if start >> j & 1 else np.uint64(0) for j in range(n_bits)]
    counters = [np.full(len(at), x, dtype=np.uint64) for x in fill]
    for k, plane in enumerate(planes):
        other = plane[np.minimum(at + word, last)]
        if bit:
            beyond = plane[np.minimum(at + word + 1, last)]
            other = (other >> np.uint64(bit)) | (beyond << np.uint64(64 - bit))
        carry = plane[at] ^ other
        for j in range(n_bits):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if k % 4 == 3:
            left = (~over).reshape(-1, BLOCK).any(axis=1)
            if not left.any():
                return np.zeros(0, dtype=np.int64)
            if left.sum() < 0.75 * len(left):
                keep = np.repeat(left, BLOCK)
                at, over = at[keep], over[keep]
                counters = [c[keep] for c in counters]
    found = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
    rows, bits = np.nonzero(found)
    return at[rows] * 64 + bits


def linked_in_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (row, smallest row of its group) among rows with an equal run number.

    `run` is sorted; links of one group in one run are as many as its rows at most.
    """
    n = len(fps)
    label = np.arange(n)
    _, counts = np.unique(run, return_counts=True)
    longest = int(counts.max(initial=0))
    if longest < 2:
        return label[:0], label[:0]
    planes = planes_of(fps)
    held, kept = [], 0
    for shift in range(1, longest):
        same = np.zeros(64 * planes.shape[1], dtype=bool)
        same[: n - shift] = run[shift:] == run[:-shift]
        if not same.any():
            break
        live = np.packbits(same, bitorder="little").view(np.uint64)
        rows = near_shift(planes, live, shift, radius)
        if len(rows):
            held.append((rows, rows + shift))
            kept += len(rows)
        if kept > 1 << 20:
            held, kept = [_star(n, held)], 0
    left, right = _star(n, held)
    return left, right


def _star(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not links:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    label = least_labels(n, *(np.concatenate(x) for x in zip(*links)))
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def near_links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all of `distinct.fp` within `radius` bits into their groups."""
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in key_masks(radius, parts)))
    keyed = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")
    )
    # Groups above a tile are cut into chunks; each pair of chunks is a run of its own.
    large = keyed.groupBy("choice", "bits").count().where(F.col("count") > tile)
    large = write_out(large.select("choice", "bits", F.ceil(F.col("count") / tile).alias("chunks")), "large")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiled = (
        keyed.join(large, ["choice", "bits"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    keys = ["choice", "bits", "low", "high"]
    spread = tiled.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 5

        def links(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fps = columns[4]
            if len(fps) > 1:
                left, right = linked_in_runs(fps.view(np.uint64), _runs(columns), radius)
                yield pa.RecordBatch.from_arrays([pa.array(fps[left]), pa.array(fps[right])], ["a", "b"])

        for batch in batches:
            new = [np.asarray(c).astype(np.int64) for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, new)]
            if len(rest[4]) >= CHUNK:
                cut = np.searchsorted(number := _runs(rest), number[-1])
                if cut:
                    yield from links([c[:cut] for c in rest])
                    rest = [c[cut:] for c in rest]
        yield from links(rest)

    return map_batches(spread, run, "a long, b long")


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns[:4]:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> DataFrame:
    """One row (id, fp, component) per document; component is the smallest id of the group."""
    marked = write_out(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = write_out(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    groups = connected(near_links(distinct, radius, parts))
    rooted = distinct.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = write_out(rooted, "rooted")
    least = write_out(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = write_out(rooted.join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select("id", "fp", F.coalesce("component", "id").alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group, the one with the smallest id.

    Rows that repeat an id are one document and stay together; rows with a null id stay.
    """
    groups = simhash_components(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = groups.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
