"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised, ended by a separator id and cut into pieces of at most `LENGTH`
tokens; full pieces are sequences of their own. Pieces of one length are interchangeable,
so a packing is a list of bin patterns (length, count) with multiplicities, whose size
depends on the number of different lengths and not on the number of documents. On it
works a grouping genetic algorithm: crossover injects whole well-filled bins of one parent
into the other, drops the receiver's bins that would use a piece twice, and best-fits the
displaced pieces. Islands evolve as Spark tasks and pass their elite to the next island
between epochs. Pieces then take the places of their length in rank order.

Defined cases: a null text is an empty one and gives one piece that holds the separator
alone. Repeated ids are packed row by row and share the id in the result. A null id stays
null. An empty table gives an empty result. Extra columns are ignored. Ties between bins
go to the earlier pattern; the same input rows in the same partitions give the same result.
"""

from __future__ import annotations

import json
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vulnlake.llm.common import map_batches, ragged, sliced, table, words_of
from vulnlake.llm.merges import LONGEST, Merges
from vulnlake.session import write_out

LENGTH, SEPARATOR = 2048, 0
#: Latin-1 letters and digits, by their code points.
_JOINED = np.array([chr(k).isalnum() for k in range(256)])
TOKENIZER = "word_bpe_49k.json"
#: Distinct parts of words whose ids a task remembers, and words it encodes in one call.
REMEMBERED, AT_ONCE = 1 << 18, 4096
#: Bytes of texts whose ids are made at once.
SLICE_BYTES = 4 << 20
#: Signs that may part words; the first that is one token does.
PARTING = ("`", "^", "~", "|")
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 3, 6, 4

Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def parted(words: pa.LargeStringArray) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Heads and tails of words: signs behind a letter or digit are tokens of their own.

    Words of Latin-1 signs are lower-cased, which keeps their bytes in number, and cut
    before the ASCII punctuation at their end; other words stay as they are and have an
    empty tail, as do words that may spell a special token.
    """
    size = len(words)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + size + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    span = data[ends[0] : ends[-1]]
    odd = np.flatnonzero((span >= 0xC4) | np.append((span[:-1] == 0x3C) & (span[1:] == 0x7C), False)[: len(span)]) + ends[0]
    whole = np.zeros(size, dtype=bool)
    whole[np.searchsorted(ends, odd, side="right") - 1] = True
    heads = pc.ascii_rtrim(pc.utf8_lower(words), characters=string.punctuation)
    lengths = np.asarray(pc.binary_length(heads), dtype=np.int64)
    final = ends[:-1] + lengths - 1  # of the head's last byte
    last, before = (data[np.maximum(final - k, 0)].astype(np.int64) for k in (0, 1))
    point = np.where(last < 0x80, last, (before & 0x1F) << 6 | last & 0x3F)
    whole |= (lengths == 0) | ~_JOINED[np.minimum(point, 255)]
    heads = pc.if_else(pa.array(whole), words, heads)
    cut = np.where(whole, 0, ends[1:] - final - 1)
    bounds = np.concatenate([[0], np.cumsum(cut)])
    bytes_ = np.ascontiguousarray(data[ragged(ends[1:] - cut, cut)])
    tails = pa.LargeStringArray.from_buffers(size, pa.py_buffer(bounds), pa.py_buffer(bytes_))
    return heads.dictionary_encode(), tails.dictionary_encode()


class WordIds:
    """Token ids of words, by way of a remembered table of the words seen.

    The tokenizer drops white space and never merges across it, so the ids of a text are
    those of its words in turn, and those of a word are those of its head and its tail. New
    heads of Latin-1 letters are merged many at a time; other new parts are encoded in one
    call, parted by a sign that is one token; parts that hold this sign or spell a special
    token are encoded alone. Of a full table, what was seen in several batches stays.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.sign = next(c for c in PARTING if len(self.alone(c)) == 1)
        (self.sign_id,) = self.alone(self.sign)
        self.merges = Merges.of(path, self.alone)
        self.remembered = remembered
        self.part: dict[str, int] = {"": 0}
        self.flat = np.full(1, SEPARATOR, dtype=np.uint32)
        self.lengths = np.array([0, 1], dtype=np.int64)  # part 0 has no ids, part 1 is the separator
        self.used = np.zeros(2, dtype=np.int64)  # batches that hold a part

    def alone(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without the sign, end to end, and how many each has."""
        ids, lengths = [], []
        for at in range(0, len(words), AT_ONCE):
            joined = f" {self.sign} ".join(words[at : at + AT_ONCE])
            (coded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            some = np.array(coded.ids, dtype=np.uint32)
            marks = np.flatnonzero(some == self.sign_id)
            ids.append(np.delete(some, marks))
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(some)]])) - 1)
        return np.concatenate(ids), np.concatenate(lengths)

    def places(self, words: pa.Array) -> np.ndarray:
        """Two remembered parts for each word, its head and its tail."""
        if len(self.part) > self.remembered:
            self._forget()
        halves = parted(words)
        named = [half.dictionary.to_pylist() for half in halves]
        self._learn([p for parts in named for p in parts if p not in self.part])
        numbers = [np.fromiter(map(self.part.__getitem__, parts), dtype=np.int32, count=len(parts)) for parts in named]
        for some in numbers:
            self.used[some] += 1
        return np.stack([some[np.asarray(half.indices)] for some, half in zip(numbers, halves)], axis=1)

    def _learn(self, parts: list[str]) -> None:
        parts = list(dict.fromkeys(parts))
        if self.merges:
            letters = [p for p in parts if p.isalpha() and max(p) < "\u0100" and len(p.encode()) <= LONGEST]
            if letters:
                self._remember(letters, *self.merges.encode(letters))
                parts = [p for p in parts if p not in self.part]
        plain = [p for p in parts if "<|" not in p and self.sign not in p]
        if plain:
            self._remember(plain, *self.encode(plain))
        for part in parts if len(parts) > len(plain) else ():
            if part not in self.part:
                ids = self.alone(part)
                self._remember([part], np.array(ids, dtype=np.uint32), np.array([len(ids)]))

    def _remember(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.lengths)
        self.part.update(zip(parts, range(first, first + len(parts))))
        self.flat = np.concatenate([self.flat, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(parts), dtype=np.int64)])

    def _forget(self) -> None:
        """Keep the parts seen in most batches, half a table at most."""
        half = self.remembered // 2
        least = 2 if len(self.used) <= half else max(2, int(np.partition(self.used, -half)[-half]) + 1)
        stays = self.used >= least
        stays[:2] = True
        starts = np.cumsum(self.lengths) - self.lengths
        number = np.cumsum(stays) - 1
        self.flat = self.flat[ragged(starts[stays], self.lengths[stays])]
        self.lengths, self.used = self.lengths[stays], self.used[stays]
        kept, moved = stays.tolist(), number.tolist()
        self.part = {p: moved[k] for p, k in self.part.items() if kept[k]}

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the separator, and where each text starts."""
        offsets, codes, distinct = words_of(texts)
        places = self.places(distinct)[codes].ravel()
        places = np.insert(places, 2 * offsets[1:], 1)
        starts = np.cumsum(self.lengths) - self.lengths
        counts = self.lengths[places]
        ids = self.flat[ragged(starts[places], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[2 * offsets + np.arange(len(offsets))]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    tokenizer: str | None = None,
) -> DataFrame:
    """Pieces of every document with their rank among pieces of that length in their part.

    Columns id, piece, start, length, ids_crc32, part, rank.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        for batch in sliced(batches, SLICE_BYTES):
            ids, starts = words.batch(batch.column(1))
            sizes = np.diff(starts)
            n = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = ragged(np.zeros(len(n), dtype=np.int64), n)
            start = piece * length
            long = np.minimum(sizes[doc] - start, length)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            begin = 4 * (starts[doc] + start)
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(begin.tolist(), (begin + 4 * long).tolist())]
            order = np.argsort(long, kind="stable")
            grouped = long[order]
            first = np.flatnonzero(np.append(True, grouped[1:] != grouped[:-1])) if len(long) else order
            count = np.diff(np.append(first, len(long)))
            rank = np.empty(len(long), dtype=np.int64)
            rank[order] = seen[grouped] + ragged(np.zeros(len(count), dtype=np.int64), count)
            np.add.at(seen, long, 1)
            columns = [
                batch.column(0).take(pa.array(doc)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(long),
                pa.array(crc, type=pa.int64()),
                pa.array(np.full(len(doc), part, dtype=np.int32)),
                pa.array(rank),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return map_batches(rows, run, schema)


def best_fit(counts: dict[int, int], length: int, bins: Bins = ()) -> Bins:
    """Put `counts` pieces per length into the fullest bins that take them, longest first."""
    open_bins: dict[int, Bins] = {}
    free: list[int] = []

    def keep(pattern: tuple, times: int, room: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(free, room)
        open_bins[room].append((pattern, times))

    for pattern, times in bins:
        keep(pattern, times, length - sum(k * c for k, c in pattern))
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(free, size)
            if at == len(free):
                pattern, times, room = (), -(-left // (length // size)), length
            else:
                room = free[at]
                pattern, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], free[at]
            each = room // size
            full = min(times, left // each)
            if full:
                keep((*pattern, (size, each)), full, room - each * size)
                left -= full * each
                times -= full
            if times and left:
                some = min(left, each)
                keep((*pattern, (size, some)), 1, room - some * size)
                left -= some
                times -= 1
            if times and pattern:
                keep(pattern, times, room)
    return merged([b for room in free for b in open_bins[room]])


def merged(bins: Bins) -> Bins:
    """Equal patterns in one entry, their pieces longest first."""
    times: dict[tuple, int] = {}
    for pattern, n in bins:
        sizes: dict[int, int] = {}
        for size, count in pattern:
            sizes[size] = sizes.get(size, 0) + count
        key = tuple(sorted(sizes.items(), reverse=True))
        times[key] = times.get(key, 0) + n
    return list(times.items())


def fill(pattern: tuple[tuple[int, int], ...]) -> int:
    return sum(size * count for size, count in pattern)


def cost(bins: Bins, length: int) -> tuple[int, float]:
    """Number of bins, then how unevenly filled they are; smaller is better."""
    return sum(n for _, n in bins), -sum(n * (fill(p) / length) ** 2 for p, n in bins)


def crossover(giver: Bins, taker: Bins, counts: dict[int, int], length: int, rng: np.random.Generator) -> Bins:
    """Inject some of the giver's fullest bins, then what the taker's bins still allow."""
    left = dict(counts)
    child: Bins = []

    def take(pattern: tuple, times: int) -> None:
        times = min([times, *(left[size] // count for size, count in pattern)])
        if times > 0:
            child.append((pattern, times))
            for size, count in pattern:
                left[size] -= times * count

    ranked = sorted(giver, key=lambda b: -fill(b[0]))
    part = max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))
    for k in rng.permutation(part).tolist():
        pattern, times = ranked[k]
        take(pattern, int(rng.integers(1, times + 1)))
    worst = length * rng.uniform(0.9, 1.0)
    for pattern, times in sorted(taker, key=lambda b: -fill(b[0])):
        if fill(pattern) >= worst:
            take(pattern, times)
    return best_fit({size: n for size, n in left.items() if n}, length, child)


def evolve(counts: dict[int, int], start: list[Bins], length: int, seed: int, generations: int, size: int) -> Bins:
    """The best packing of one island after some generations."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(k * n for k, n in counts.items()) // length)
    people = [b for b in start if b]
    while len(people) < size:  # others start from bins of a random share of the pieces
        some = {k: int(rng.integers(0, n + 1)) for k, n in counts.items()}
        first = best_fit({k: n for k, n in some.items() if n}, length)
        rest = {k: n - some[k] for k, n in counts.items() if n > some[k]}
        people.append(best_fit(rest, length, first))
    people.sort(key=lambda b: cost(b, length))
    for _ in range(generations):
        if cost(people[0], length)[0] <= bound:
            break
        children = []
        for _ in range(size):
            i, j = rng.integers(0, len(people), 2).tolist()
            children.append(crossover(people[i], people[j], counts, length, rng))
        people = sorted(people + children, key=lambda b: cost(b, length))[:size]
    return people[0]


def pack_lengths(
    spark: SparkSession,
    counts: dict[int, int],
    length: int = LENGTH,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
) -> Bins:
    """Bins for `counts` pieces per length, of which there are at most `length` entries.

    The number of patterns is bounded by the number of lengths as well: every step of
    best fit uses up a length or closes an entry.
    """
    if not counts:
        return []
    elites: list[Bins] = [[]] * islands  # islands begin with random packings of their own
    bound = -(-sum(k * n for k, n in counts.items()) // length)
    for epoch in range(epochs):
        if epoch and min(cost(b, length)[0] for b in elites) <= bound:
            break
        migrated = [(elites[k], elites[k - 1]) for k in range(islands)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    best = evolve(counts, list(migrated[k]), length, 1000 * epoch + k, generations, population)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([json.dumps(best)])], ["island", "bins"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, bins string").collect()
        for island, bins in rows:
            elites[island] = [(tuple(map(tuple, p)), n) for p, n in json.loads(bins)]
    # A plain packing counts only where it needs fewer bins than evolution found.
    return min([*elites, best_fit(counts, length)], key=lambda b: cost(b, length)[0])


def places(bins: Bins) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as intervals of their ranks.

    Interval k holds ranks from `first` of length `size`; `each` of them share a bin, the
    bins count from `bin`, and the first of a bin stands at `offset`.
    """
    rows, used, first_bin = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for size, count in pattern:
            rows.append((size, used.get(size, 0), count, first_bin, offset))
            used[size] = used.get(size, 0) + count * times
            offset += size * count
        first_bin += times
    rows.sort()
    names = ("size", "first", "each", "bin", "offset")
    return {name: np.array([r[k] for r in rows], dtype=np.int64) for k, name in enumerate(names)}


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    tokenizer: str | None = None,
) -> DataFrame:
    """Every piece with its sequence and its place there.

    Columns id, piece, start, length, ids_crc32, sequence_id, offset. Full pieces have
    sequence numbers below 0.
    """
    spark = docs.sparkSession
    cut = write_out(pieces(docs, id_col, text_col, length, tokenizer), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per_part = write_out(per_part, "parts")
    totals = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `length` rows
    counts = {int(r["length"]): int(r["n"]) for r in totals if r["length"] < length}
    plan = places(pack_lengths(spark, counts, length))
    top = max((int(r["n"]) for r in totals), default=0) + 1
    if top * (length + 1) >= 1 << 63:
        raise ValueError("too many pieces of one length")
    keys = plan["size"] * top + plan["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            if len(keys):
                at = np.maximum(np.searchsorted(keys, long * top + rank, side="right") - 1, 0)
                nth, among = np.divmod(rank - plan["first"][at], plan["each"][at])
                sequence, offset = plan["bin"][at] + nth, plan["offset"][at] + among * long
            else:
                sequence = offset = np.zeros(len(long), dtype=np.int64)
            full = long == length
            sequence, offset = np.where(full, -1 - rank, sequence), np.where(full, 0, offset)
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names)

    # The counts grow with the number of parts, so they are not broadcast.
    before = per_part.select("length", "part", "before").hint("merge")
    ranked = cut.join(before, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, run, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
