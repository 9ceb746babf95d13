"""Suffix-array dedup: remove every byte of a long string that also starts elsewhere.

Blockwise construction with a difference cover, cut at the depth that matters. Let W be
the length of a string that counts as repeated, v the period of a difference cover D.

1. Cover sample: of every v suffixes those with position in D mod v are ranked by their
   first W - v + 1 bytes. For any two positions some shift below v brings both into D, so
   two suffixes that tie over W bytes have a common shift at which their sample ranks tie.
   A suffix without a tied sample rank within v positions therefore ties with no other.
2. Suffix buckets: the suffixes left are dealt into buckets and sorted one bucket at a
   time. Only ties of W bytes are asked for, so a suffix is sorted by a 64-bit
   fingerprint of its first W bytes; neighbours with equal keys are repeats. The
   fingerprint depends on a secret of the call, so no text can be made to collide; by
   chance n different strings hold about n * n / 2^65 equal pairs.
3. Each text removes the bytes that its repeated suffixes cover over W bytes.

Texts lie in a written table of blocks that is bucketed by block number, so that the
answers of both sorts come back to their block without moving text again. A block sends
each bucket one row of distinct sorted keys and gets one bit per key in return; strings
repeated inside a block, hot ones too, are one key. A task holds one bucket or one block.

Defined cases: texts are UTF-8 bytes, a null text is empty; texts below W bytes lose
nothing; equal rows are different places, so both lose what they share; a table without
rows gives none. Columns other than the text travel as they are, whatever their names.
One text must fit a task's memory about 30 times over.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import map_batches, mix64, segment_sums, table
from vulnlake.session import scratch_path

WIDTH = 200
#: A perfect difference set: every residue but 0 is one difference of two members.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: Bytes of text in a block, and of all text for each bucket of suffixes.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Bytes of a key that are sent: sample ranks may be coarse, fingerprints are whole.
SAMPLE_KEY, SUFFIX_KEY = 6, 8
#: Bytes that are mixed before they are summed.
GRAM = 8
#: Positions hashed at once, so that the arrays stay in a core's cache.
STRIDE = 1 << 15

#: Keys that a block sends to a bucket.
KEY_ROWS = "block long, bucket int, keys binary"


def make_blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """Rows (block, rest, sizes, data): whole texts end to end with their other columns."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(rest.alias("rest"), F.col(text_col).cast("binary").alias("text"))
    item = rows.schema["rest"].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("rest", T.ArrayType(item)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            filled = np.cumsum(sizes) // block_bytes
            cuts = np.flatnonzero(np.append(True, filled[1:] != filled[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(texts)]):
                bounds = pa.array([0, b - a], type=pa.int32())
                columns = [
                    pa.array([number]),
                    pa.ListArray.from_arrays(bounds, batch.column(0).slice(a, b - a)),
                    pa.ListArray.from_arrays(bounds, pa.array(sizes[a:b])),
                    pa.array([b"".join(texts[a:b])], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "rest", "sizes", "data"])
                number += 1

    return map_batches(rows, run, schema)


class Heads:
    """Hashes of fixed-length strings at positions of a block, for one width.

    Every overlapping run of `GRAM` bytes is first mixed with a secret that is drawn anew
    for each call of the operator, and a string's hash is a sum of its runs' values times
    powers of an odd base that is secret too. Sums of plain bytes would let texts be chosen
    that collide under every base.
    """

    def __init__(self, width: int, secret: int):
        self.width, self.secret = width, np.uint64(secret & 0xFFFFFFFFFFFFFFFF)
        base = (secret >> 64 << 3 | 5) & 0xFFFFFFFFFFFFFFFF
        n = STRIDE + width + 1
        up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def runs(self, part: np.ndarray) -> np.ndarray:
        """A value for the `GRAM` bytes from each place at which so many follow."""
        runs, bits = part.astype(np.uint64), 8
        while bits < 8 * GRAM:
            step = bits // 8
            runs = runs[:-step] | runs[step:] << np.uint64(bits)
            bits *= 2
        return mix64(runs ^ self.secret)

    def at(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hash of `width` bytes from each of the ascending places."""
        out = np.empty(len(places), dtype=np.uint64)
        cuts = np.searchsorted(places, np.arange(0, len(data) + STRIDE, STRIDE)).tolist()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            start = k * STRIDE
            values = self.runs(data[start : start + STRIDE + self.width])
            total = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * self.up[: len(values)], out=total[1:])
            near = places[a:b] - start
            out[a:b] = (total[near + self.width - GRAM + 1] - total[near]) * self.down[near]
        return mix64(out)


class Keys:
    """Distinct keys of a block in order, cut into buckets by their leading bits."""

    def __init__(self, values: np.ndarray, buckets: int):
        self.order = np.argsort(values)
        ordered = values[self.order]
        first = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, dtype=bool)
        self.number = np.cumsum(first) - 1
        self.distinct = ordered[first]
        self.often = np.bincount(self.number, minlength=len(self.distinct)) > 1
        edges = [(k << 64) // buckets for k in range(1, buckets)]
        inner = np.searchsorted(self.distinct, np.array(edges, dtype=np.uint64))
        self.cuts = np.concatenate([[0], inner, [len(self.distinct)]]).astype(np.int64)

    def rows(self, block: int, width: int) -> Iterator[tuple[int, int, bytes]]:
        """(block, bucket, keys): leading bytes of the keys, one plane of bytes after the other."""
        planes = self.distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
        for bucket, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            if a < b:
                yield block, bucket, planes[a:b].T.tobytes()

    def repeated(self, answers: list[dict] | None) -> np.ndarray:
        """Whether each value, in the order given at first, occurs again here or elsewhere."""
        again = self.often.copy()
        for answer in answers or ():
            a, b = self.cuts[answer["bucket"]], self.cuts[answer["bucket"] + 1]
            bits = np.unpackbits(np.frombuffer(answer["bits"], dtype=np.uint8), bitorder="little")
            again[a:b] |= bits[: b - a].astype(bool)
        out = np.empty(len(self.order), dtype=bool)
        out[self.order] = again[self.number]
        return out


class Texts:
    """A block's bytes with the places at which suffixes are sampled and compared."""

    def __init__(self, data: bytes, sizes: list[int], width: int, buckets: int, secret: int):
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.width, self.buckets, self.secret = width, buckets, secret

    def room(self, places: np.ndarray, width: int) -> np.ndarray:
        """Whether `width` bytes from each place lie in one text."""
        text = np.searchsorted(self.offsets, places, side="right") - 1
        return places + width <= self.offsets[text + 1]

    def samples(self) -> tuple[np.ndarray, Keys]:
        rounds = np.arange(0, len(self.data), PERIOD)[:, None] + np.array(COVER)
        places = rounds.ravel()
        places = places[places < len(self.data)]
        depth = self.width - PERIOD + 1
        places = places[self.room(places, depth)]
        return places, Keys(Heads(depth, self.secret).at(self.data, places), self.buckets)

    def suffixes(self, answers: list[dict] | None) -> tuple[np.ndarray, Keys]:
        """Places whose suffix has a tied sample within the period, with their keys."""
        places, keys = self.samples()
        tied = np.zeros(len(self.data) + PERIOD + 1, dtype=np.int32)
        tied[places[keys.repeated(answers)] + 1] = 1
        np.cumsum(tied, out=tied)
        starts = np.flatnonzero(tied[PERIOD:-1] > tied[: len(self.data)])
        starts = starts[self.room(starts, self.width)]
        return starts, Keys(Heads(self.width, self.secret).at(self.data, starts), self.buckets)

    def removed(self, samples: list[dict] | None, suffixes: list[dict] | None) -> np.ndarray:
        """Which bytes a repeated suffix covers."""
        starts, keys = self.suffixes(samples)
        starts = starts[keys.repeated(suffixes)]
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        change[starts] += 1
        change[starts + self.width] -= 1
        return np.cumsum(change[:-1]) > 0


def judge_buckets(rows: DataFrame, judge: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """Judge the keys of one bucket at a time: (block, bucket, bits), a bit for each key.

    `judge` gets the keys that each block sent to the bucket and gives a truth value a key.
    """
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")

    def answer(bucket: int, blocks: list[int], parts: list[bytes]) -> pa.RecordBatch:
        bits = [np.packbits(x, bitorder="little").tobytes() for x in judge(parts)]
        columns = [pa.array(blocks), pa.array([bucket] * len(blocks), type=pa.int32()), pa.array(bits, type=pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, parts = -1, [], []
        for batch in batches:
            for block, bucket, part in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if parts:
                        yield answer(now, blocks, parts)
                    now, blocks, parts = bucket, [], []
                blocks.append(block)
                parts.append(part)
        if parts:
            yield answer(now, blocks, parts)

    return map_batches(dealt, run, "block long, bucket int, bits binary")


def sort_buckets(rows: DataFrame, width: int) -> DataFrame:
    """Sort the keys of one bucket at a time; a key's bit tells whether it is seen again."""

    def judge(parts: list[bytes]) -> list[np.ndarray]:
        keys = []
        for part in parts:
            wide = np.zeros((len(part) // width, 8), dtype=np.uint8)
            wide[:, :width] = np.frombuffer(part, dtype=np.uint8).reshape(width, -1).T
            keys.append(wide.view(">u8").ravel().astype(np.uint64))
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(keys), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        return np.split(again, ends[:-1])

    return judge_buckets(rows, judge)


def key_rows(rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """A batch of rows of the schema `KEY_ROWS`."""
    block, bucket, keys = zip(*rows)
    columns = [pa.array(block), pa.array(bucket, type=pa.int32()), pa.array(keys, type=pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "keys"])


def answers(judged: DataFrame, column: str) -> DataFrame:
    """All answers of a block in one row (block, `column`), written once."""
    listed = _written(judged, column).groupBy("block")
    return listed.agg(F.collect_list(F.struct("bucket", "bits")).alias(column)).hint("shuffle_hash")


def stored_blocks(docs: DataFrame, text_col: str, scale: float = 1) -> tuple[DataFrame, int]:
    """Written blocks of the texts, bucketed by block number, and how many key buckets suit them.

    Blocks hold `scale` times `BLOCK_BYTES`.

    Only a catalog table can be bucketed. It is dropped at once: the frame holds on to
    its files and to their bucketing, and they go with the other scratch files.
    """
    spark = docs.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = make_blocks(docs, text_col, int(scale * BLOCK_BYTES))
    writer = made.write.format("parquet").option("compression", "zstd").bucketBy(parts, "block")
    writer.option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    try:
        blocks = spark.table(name)
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x)
        total = blocks.agg(F.sum(size)).first()[0] or 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return blocks, total // BUCKET_BYTES + 1


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (rest, n_bytes, n_removed, n_spans, kept) for every row of `docs`.

    `rest` is a struct of the columns other than the text, `kept` the remaining bytes.
    """
    if width < PERIOD:
        raise ValueError(f"width must be {PERIOD} at least")
    blocks, buckets = stored_blocks(docs, text_col)
    item = blocks.schema["rest"].dataType.elementType
    secret = secrets.randbits(125)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Texts]]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                yield row, Texts(row["data"].as_buffer(), row["sizes"].as_py(), width, buckets, secret)

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in each(batches):
            _, keys = texts.samples()
            if len(keys.distinct):
                yield key_rows(keys.rows(row["block"].as_py(), SAMPLE_KEY))

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in each(batches):
            _, keys = texts.suffixes(row["samples"].as_py())
            if len(keys.distinct):
                yield key_rows(keys.rows(row["block"].as_py(), SUFFIX_KEY))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in each(batches):
            gone = texts.removed(row["samples"].as_py(), row["suffixes"].as_py())
            starts = gone.copy()
            starts[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), texts.offsets)
            n_removed, n_spans = (segment_sums(x.astype(np.int64), texts.offsets).astype(np.int64) for x in (gone, starts))
            left = texts.data[~gone].tobytes()
            ends = np.cumsum(texts.sizes - n_removed).tolist()
            kept = [left[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            columns = [
                row["rest"].values,
                pa.array(texts.sizes),
                pa.array(n_removed),
                pa.array(n_spans),
                pa.array(kept, type=pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "n_bytes", "n_removed", "n_spans", "kept"])

    samples = map_batches(blocks.select("block", "sizes", "data"), send_samples, KEY_ROWS)
    known = blocks.join(answers(sort_buckets(samples, SAMPLE_KEY), "samples"), "block", "left")
    suffixes = map_batches(known.select("block", "sizes", "data", "samples"), send_suffixes, KEY_ROWS)
    suffixes = answers(sort_buckets(suffixes, SUFFIX_KEY), "suffixes")
    schema = T.StructType(
        [
            T.StructField("rest", item),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return map_batches(known.join(suffixes, "block", "left"), finish, schema)


def _written(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dedup_texts(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents without repeated strings, in the same columns.

    A cut inside a character takes the rest of that character with it.
    """
    rows = remove_repeats(docs, text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py().decode("utf-8", "ignore") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["rest", "text"])

    item = rows.schema["rest"].dataType
    schema = T.StructType([T.StructField("rest", item), T.StructField("text", T.StringType())])
    whole = map_batches(rows.select("rest", "kept"), run, schema)
    return whole.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = remove_repeats(docs)
    return rows.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
