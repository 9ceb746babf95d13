"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by the `PREFIX` pivots nearest to it, in order. Pivots are vectors of
its own label from a sample bounded by `SAMPLE` rows; labels that the sample misses use
the sample's first pivots. Inverted lists per pivot bring together vectors that share one;
a pair with at least `SHARED` common pivots is verified by cosine in double precision, in
the list of its smallest common pivot only. Exact copies are one vector with a count
before any of that, so a hot vector is one entry; lists above `TILE` entries are cut into
chunks whose pairs are compared in tasks of their own. A task returns a count of links and
a link to the smallest vector of its group per vector, never the pairs themselves.

The index is approximate: tests hold its recall of links against brute force above 0.9.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and
rows with a null label or id, link with nothing and keep themselves; vectors of different
length are never compared; repeated rows are separate vectors linked with each other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import connected, least_labels, map_batches, table
from vulnlake.session import write_out

COSINE = 0.98
SAMPLE, PIVOTS, PREFIX, SHARED = 4096, 256, 12, 1
#: Entries of one inverted list that are compared in one piece.
TILE = 2048


def usable(vector: str, label: str, id_col: str):
    """Whether a row takes part in the comparison."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & F.col(label).isNotNull() & F.col(id_col).isNotNull() & finite & some, F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1 in double precision."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # large numbers must not overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(vectors: DataFrame, sample: int, pivots: int) -> dict[tuple, np.ndarray]:
    """Pivots by (label, length), and by (None, length) for labels without enough of them."""
    order = F.xxhash64("vector", "label")
    rows = vectors.select("label", "vector").orderBy(order).limit(sample).toArrow()
    chosen: dict[tuple, list[list[float]]] = {}
    for label, vector in zip(rows.column("label").to_pylist(), rows.column("vector").to_pylist()):
        for key in ((label, len(vector)), (None, len(vector))):
            own = chosen.setdefault(key, [])
            if len(own) < pivots:
                own.append(vector)
    return {key: units(pa.array(own)) for key, own in chosen.items()}


def describe(vectors: DataFrame, pivots: dict[tuple, np.ndarray], prefix: int = PREFIX) -> DataFrame:
    """The rows with `near`: numbers of the nearest pivots, nearest first.

    Lengths that the sample misses have no pivots; one list holds such vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            lengths = np.asarray(pc.list_value_length(batch.column("vector"))).tolist()
            near: list[list[int]] = [[0]] * len(labels)
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(labels, lengths)):
                groups.setdefault(key, []).append(k)
            for (label, length), at in groups.items():
                own = pivots.get((label, length))
                if own is None or len(own) < 2 * prefix:
                    own = pivots.get((None, length))
                if own is None:
                    continue
                x = units(batch.column("vector").take(pa.array(at)))
                order = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :prefix]
                for k, row in zip(at, order.tolist()):
                    near[k] = row
            columns = [*batch.columns, pa.array(near, type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return map_batches(vectors, run, f"{schema}, near array<int>")


def verified(
    ids: np.ndarray, x: np.ndarray, copies: np.ndarray, near: np.ndarray, chunk: np.ndarray, pivot: int, cross: bool, cosine: float, shared: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links per row, weighted by copies, and the smallest row of its group, among one list's rows."""
    n = len(ids)
    counts, left, right = np.zeros(n, dtype=np.int64), [], []
    has = np.zeros((n, near.max(initial=0) + 1), dtype=np.float32)
    has[np.arange(n)[:, None], near] = 1
    before = has[:, :pivot]
    for a in range(0, n, 512):
        part = slice(a, a + 512)
        ok = x[part] @ x.T >= cosine
        i, j = np.nonzero(ok)
        i = i + a
        keep = (i < j) & ((chunk[i] != chunk[j]) if cross else True)
        i, j = i[keep], j[keep]
        # A pair belongs to its smallest common pivot.
        keep = ~(before[i] * before[j]).any(axis=1) & ((has[i] * has[j]).sum(axis=1) >= shared)
        i, j = i[keep], j[keep]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        left.append(i)
        right.append(j)
    root = least_labels(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)
    return counts, root


def index_links(described: DataFrame, cosine: float = COSINE, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """Rows (a, b, links): a vector's number, one of its group, and links found with it."""
    width = F.size("vector")
    entries = described.select("gid", "copies", "label", "vector", "near", width.alias("width"), F.explode("near").alias("pivot"))
    key = ["label", "width", "pivot"]
    large = entries.groupBy(*key).count().where(F.col("count") > tile)
    large = write_out(large.select(*key, F.ceil(F.col("count") / tile).cast("int").alias("chunks")), "large")
    chunks = F.coalesce("chunks", F.lit(1))
    tiled = (
        entries.join(large, key, "left")
        .withColumn("own", F.pmod(F.xxhash64("gid"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select("gid", "copies", *key, "low", "high", "own", "vector", "near")
    )
    runs = [*key, "low", "high"]
    spread = tiled.repartition(*runs).sortWithinPartitions(*runs, "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def links(rows: pa.RecordBatch) -> pa.RecordBatch:
            gid = np.asarray(rows.column("gid"))
            pivot, low, high = (rows.column(c)[0].as_py() for c in ("pivot", "low", "high"))
            near = np.asarray(rows.column("near").flatten()).reshape(len(gid), -1)
            copies, own = np.asarray(rows.column("copies")), np.asarray(rows.column("own"))
            counts, root = verified(gid, units(rows.column("vector")), copies, near, own, pivot, low != high, cosine, shared)
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(gid[at]), pa.array(gid[root[at]]), pa.array(counts[at])], ["a", "b", "links"])

        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            marks = [np.asarray(rows.column(c)) for c in runs]
            new = np.zeros(rows.num_rows, dtype=bool)
            new[0] = True
            for mark in marks:
                new[1:] |= mark[1:] != mark[:-1]
            cuts = np.flatnonzero(new).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield links(rows.slice(a, b - a))
            rest = rows.slice(cuts[-1])
        if rest is not None and rest.num_rows > 1:
            yield links(rest)

    return map_batches(spread, run, "a long, b long, links long")


def near_vectors(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    sample: int = SAMPLE,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    shared: int = SHARED,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per input row."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")
    )
    takes_part = usable("vector", "label", "id")
    alone = rows.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = write_out(rows.where(takes_part), "vectors")
    groups = rows.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    groups = write_out(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    chosen = choose_pivots(groups, sample, pivots)
    described = write_out(describe(groups.select("gid", "copies", "label", "vector"), chosen, prefix), "described")
    found = write_out(index_links(described, cosine, shared), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    components = write_out(connected(found.select("a", "b")), "components")
    rooted = (
        groups.select("gid", "least", "copies", "label", "vector")
        .join(components.withColumnRenamed("id", "gid"), "gid", "left")
        .join(counts.withColumnRenamed("a", "gid"), "gid", "left")
        .withColumn("root", F.coalesce("component", "gid"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    rooted = write_out(rooted.select("root", "least", "label", "vector", "n_links"), "rooted")
    least = write_out(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = write_out(rooted.join(least, "root").select("label", "vector", "n_links", "component_id"), "named")
    linked = rows.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.unionByName(alone).select("id", "n_links", "component_id", kept)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
