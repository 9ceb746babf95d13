"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(codes) bits, and an index lists the codes by
each segment's value. Round r probes every value that differs in r bits from a query's
segment. After it, each code within m * (r + 1) - 1 bits of the query has been seen, as
one of its m segments differs in at most r. A query is done when its k-th verified distance
lies within that bound; the others go on to the next round, with that distance as the
limit for what still counts.

Equal codes are one entry with the smallest ids that k results can need, cut before the
shuffle; equal queries are searched once. A pair is verified where it is first seen: in
the first segment among those that differ least.

Defined cases: rows whose vector is null, empty or holds null or non-finite numbers have no
code and are neither found nor searched for; null ids likewise; ties go to the smaller id;
a query does not find itself, but rows that repeat its id count as itself too; with fewer
than k other rows all are returned; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import map_batches, table
from vulnlake.session import write_out

K, EVERY, BITS = 10, 50, 64
#: Probes that a task makes at once.
PROBES = 1 << 18


def sign_codes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit j tells whether the components j, j + 64, ... sum above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(1)), dtype=np.int64)
            flat = np.asarray(batch.column(1).flatten(), dtype=np.float64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sums = np.bincount(row * BITS + place % BITS, flat, len(lengths) * BITS).reshape(-1, BITS)
            codes = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["id", "code"])

    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite
    return map_batches(rows.where(good).select(F.col(id_col).cast("long"), vector_col), run, "id long, code long")


def cut(bits: int, m: int) -> list[tuple[int, int]]:
    """(first bit, length) of m segments."""
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment(code, first: int, length: int):
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << length) - 1))


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest other rows of each query.

    `codes` and `queries` are rows (id, code).
    """
    spark = codes.sparkSession
    # k + 1 ids of a code at most: one of them may be the query.
    smallest = Window.partitionBy("code").orderBy("id")
    few = codes.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    listed = few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = write_out(listed, "codes")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    m = max(1, round(BITS / max(log2(n), 4)))
    segments = cut(BITS, m)
    pieces = F.explode(
        F.array(*(F.struct(F.lit(j).alias("seg"), segment(F.col("code"), *s).alias("value")) for j, s in enumerate(segments)))
    )
    by_segment = index.select("code", F.least(F.size("ids"), F.lit(k + 1)).alias("n"), pieces.alias("s"))
    by_segment = write_out(by_segment.select("code", "n", "s.seg", "s.value"), "segments")
    queries = write_out(queries.distinct(), "queries")
    active = queries.select(F.col("code").alias("query")).distinct().withColumn("limit", F.lit(BITS))
    active = write_out(active, "active")
    rounds: list[DataFrame] = []
    longest = max(length for _, length in segments)
    for r in range(longest + 1):
        hits = write_out(_round(active, by_segment, segments, r), "hits")
        rounds.append(hits)
        covered = m * (r + 1) - 1 if r < longest else BITS
        reached = _kth(active, rounds, k + 1)
        active = write_out(reached.where(F.col("limit") > covered), "active")
        if active.isEmpty():
            break
    seen = rounds[0]
    for hits in rounds[1:]:
        seen = seen.unionByName(hits)
    final = _kth(queries.select(F.col("code").alias("query")).distinct(), rounds, k + 1)
    nearest = (
        seen.join(final.hint("merge"), "query")
        .where("distance <= limit")
        .join(index, "code")
        .select("query", "distance", F.explode("ids").alias("neighbor_id"))
    )
    best = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    nearest = nearest.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = nearest.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("found"))
    lists = write_out(lists, "lists").withColumnRenamed("query", "code")
    others = F.slice(F.filter("found", lambda x: x["neighbor_id"] != F.col("id")), 1, k)
    return (
        queries.join(lists, "code")
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "x.neighbor_id", "x.distance")
    )


def flipped(r: int, n: int) -> np.ndarray:
    """All values of n bits of which r are set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(n), r)], dtype=np.int64)


def _round(active: DataFrame, by_segment: DataFrame, segments: list[tuple[int, int]], r: int) -> DataFrame:
    """Codes first seen with r differing bits in a segment: (query, code, n, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {n: flipped(r, n) for _, n in segments}
        for batch in batches:
            query, limit = (np.asarray(c) for c in batch.columns)
            for j, (first, n) in enumerate(segments):
                own = (query.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << n) - 1)
                step = max(1, PROBES // max(len(flips[n]), 1))
                for a in range(0, len(query), step):
                    values = (own[a : a + step, None] ^ flips[n][None, :]).ravel()
                    seg = np.full(len(values), j, dtype=np.int32)
                    columns = [np.repeat(x[a : a + step], len(flips[n])) for x in (query, limit)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, seg, values)], ["query", "limit", "seg", "value"])

    probes = map_batches(active.select("query", "limit"), run, "query long, limit int, seg int, value long")
    # Probes are many and alike, so their packed size says little: no broadcast of either side.
    found = probes.join(by_segment.hint("merge"), ["seg", "value"])
    xor = F.col("query").bitwiseXOR(F.col("code"))
    found = found.withColumn("distance", F.bit_count(xor)).where("distance <= limit")
    parts = [F.bit_count(segment(xor, *s)) for s in segments]
    first = F.lit(True)
    for j, part in enumerate(parts):
        first = first & F.when(F.col("seg") > j, part > r).otherwise(part >= r)
    return found.where(first).select("query", "code", "n", "distance")


def _kth(queries: DataFrame, rounds: list[DataFrame], k: int) -> DataFrame:
    """(query, limit): the distance of the k-th id seen so far, or all bits if there are fewer."""
    counts = None
    for hits in rounds:
        own = hits.groupBy("query", "distance").agg(F.sum("n").alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    running = Window.partitionBy("query").orderBy("distance")
    total = counts.groupBy("query", "distance").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(running))
    reached = total.where(F.col("total") >= k).groupBy("query").agg(F.min("distance").alias("limit"))
    return queries.select("query").join(reached, "query", "left").select("query", F.coalesce("limit", F.lit(BITS)).alias("limit"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = write_out(sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "signs")
    return top_k(codes, codes.where(F.col("id") % EVERY == 0))


ORACLE = f"""
WITH good AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
    CAST(list_sum([CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INTEGER) FOR i IN generate_series(1, {BITS})]) AS INTEGER) AS distance
  FROM good q, good e WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= {K}
"""
