"""Helpers shared by the corpus operators: reading, batching, words, hashing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.session import write_out

#: Bytes of rows that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Size Arrow batches by bytes: 10,000 very long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes; a larger row stands alone."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        half = batch.num_rows // 2
        # Slices share their buffers, so measure what they really hold.
        yield from sliced((batch.slice(0, half),), limit)
        yield from sliced((batch.slice(half),), limit)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: row offsets, a code per word, the distinct words.

    Null texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(flat, ""))
    kept = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return kept, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets; empty segments are 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of several runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`mapInArrow` over batches of bounded size; a worker that waits for a task keeps no freed buffers."""
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def struct_schema(rows: DataFrame, column: str, more: str) -> T.StructType:
    """The schema of a column that is passed on whole, with more columns after it."""
    added = T._parse_datatype_string(more)
    return T.StructType([T.StructField(column, rows.schema[column].dataType), *added.fields])


def bounded_labels(
    labels: DataFrame, docs: DataFrame, id_col: str, columns: list[str], rows: int
) -> DataFrame:
    """At most `rows` labelled documents with distinct ids, in an order fixed by a hash of the id."""
    chosen = (
        labels.groupBy(id_col)
        .agg(*(F.max(c).alias(c) for c in columns))
        .where(F.col(id_col).isNotNull())
        .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
        .limit(rows)
    )
    chosen = write_out(chosen, "labels")
    # Bounded by `rows` ids and a few numbers each.
    return docs.join(F.broadcast(chosen), id_col)


def least_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links left-right."""
    label = np.arange(n)
    if not len(left):
        return label
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def connected(edges: DataFrame) -> DataFrame:
    """Components of links (a, b) between long ids: one row (id, component) per node.

    Large-star and small-star steps in turn, each from a written table, until the
    set of links stands still. Every step sends one row per link, groups by minima
    that combine before the shuffle, and keeps no component in one place.
    """
    columns = [F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")]
    links = (
        edges.select(*columns)
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = write_out(links, "links")
    state = _fingerprint(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = write_out(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_out(large.distinct(), "large")
        low = write_out(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = write_out(small, "links")
        now = _fingerprint(links)
        if now == state:
            break
        state = now
    nodes = links.groupBy("a").agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return nodes.withColumnRenamed("a", "id").unionByName(
        roots.join(nodes.select(F.col("a").alias("id")), "id", "left_anti")
    )


def _fingerprint(links: DataFrame) -> tuple[int, int]:
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = links.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return row[0], int(row[1])
