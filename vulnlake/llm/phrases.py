"""Repeated-phrase automata: remove passages of words that an earlier document holds.

1. Confirm. A window is `WINDOW` consecutive words of one document. Every window names the
   least hash of its 5-word grams; windows of one wording name the same gram, so only
   windows whose gram is seen at two places can recur. Distinct windows left are sent, once
   per block of texts and with the block's smallest document id, to the bucket of their
   128-bit key, which tells each block whether a smaller id holds the window elsewhere.
2. Compile. The confirmed phrases of a block, each taken once, become Aho-Corasick automata
   (pyahocorasick) of at most `PHRASES` phrases, so that a block of copies needs no more
   memory than any other. An automaton reads each word as one of `SIGNS` signs, which keeps
   its nodes narrow; of phrases spelled alike, each gets into an automaton of its own.
3. Stream. All words of the block's documents that lie in a window of a gram seen twice run
   through each of its automata, which locate every occurrence (each holds its phrase's gram);
   those whose words are the phrase's own count. An occurrence goes if its document's id is
   larger than the smallest one that holds the phrase.

A common phrase is one key per block, whatever its number of occurrences, and no text
travels: blocks lie in a written table bucketed by block number. Keys chain a cryptographic
digest of each word through a bijective mix, so equal keys of different windows are a matter
of chance, about n * n / 2^129 for n windows. Grams, which only leave windows out, chain a
plain hash.

Defined cases: a null text has no words; a text below `WINDOW` words loses nothing; rows of
equal id are neither smaller nor larger than each other; a null id is neither smaller nor
larger than any, so such rows lose nothing and take nothing from others; an empty table
gives an empty result; other columns travel as they are, whatever their names. One text must
fit a task's memory about 60 times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import map_batches, mix64, segment_sums, table, words_of
from vulnlake.llm.suffix import (
    KEY_ROWS,
    SAMPLE_KEY,
    Keys,
    answers,
    judge_buckets,
    key_rows,
    sort_buckets,
    stored_blocks,
)

WINDOW, GRAM = 13, 5
#: Larger blocks than those of suffixes: the more a block holds, the fewer share a phrase.
BLOCK_SCALE = 1.5
#: Phrases in one automaton, and signs for words.
PHRASES, SIGNS = 1 << 17, 256
#: Bytes of a window's key with the least id that holds it.
PHRASE_KEY = 24

_START = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)


def chained(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from each start, in which their order counts."""
    out = np.full(len(starts), _START)
    for k in range(n):
        out = mix64(out ^ values[starts + k])
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of `width` neighbouring values, from each place at which so many follow."""
    low, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        low = np.minimum(low[:-step], low[step:])
        covered += step
    return low


class Passages:
    """The words of a block of documents with the windows that may recur."""

    def __init__(self, row: dict, window: int, buckets: int):
        sizes = np.array(row["sizes"].as_py(), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), row["data"].as_buffer())
        self.offsets, self.codes, self.words = words_of(texts)
        ids = row["ids"].values
        self.known = np.asarray(pc.is_valid(ids), dtype=bool)
        self.ids = np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), np.diff(self.offsets))
        self.window, self.buckets = window, buckets
        room = np.arange(len(self.codes)) + window <= self.offsets[1:][self.doc]
        #: Where windows start whose document has an id.
        self.here = room & self.known[self.doc]
        self.starts = np.flatnonzero(self.here)

    def anchors(self) -> tuple[np.ndarray, Keys]:
        """For each window the number of its run of equal least grams in its document, and a key per run."""
        if not len(self.starts):
            return self.starts, Keys(np.zeros(0, dtype=np.uint64), self.buckets)
        hashes = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)
        grams = chained(hashes[self.codes], np.arange(len(self.codes) - GRAM + 1), GRAM)
        low = window_minima(grams, self.window - GRAM + 1)[self.starts]
        doc = self.doc[self.starts]
        first = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))
        return np.cumsum(first) - 1, Keys(low[first], self.buckets)

    def lanes(self, places: np.ndarray) -> np.ndarray:
        """Both halves of the digest of the word at each of some places."""
        used, which = np.unique(self.codes[places], return_inverse=True)
        words = self.words.take(pa.array(used)).cast(pa.large_binary()).to_pylist()
        digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words)
        return np.frombuffer(digests, dtype="<u8").reshape(-1, 2).astype(np.uint64)[which].T

    def phrases(self, seen: list[dict] | None) -> Phrases:
        runs, keys = self.anchors()
        starts = self.starts[keys.repeated(seen)[runs]]
        change = np.zeros(len(self.codes) + 1, dtype=np.int8)
        change[starts] += 1
        change[starts + self.window] -= 1
        #: Places of the words in these windows; a window's own follow each other.
        self.stream = np.flatnonzero(np.cumsum(change[:-1]))
        first = np.searchsorted(self.stream, starts)
        high, low = (chained(lane, first, self.window) for lane in self.lanes(self.stream))
        return Phrases(starts, high, low, self.ids[self.doc[starts]], self.buckets)

    def removed(self, seen: list[dict] | None, smaller: list[dict] | None) -> np.ndarray:
        """Which words a window covers that a document with a smaller id holds."""
        phrases = self.phrases(seen)
        places, least, elsewhere = phrases.confirmed(smaller)
        change = np.zeros(len(self.codes) + 1, dtype=np.int32)
        while len(places):
            automaton, inside = self.compiled(places)
            starts, which = self.located(automaton, places)
            later = self.ids[self.doc[starts]] > least[which]
            starts = starts[elsewhere[which] | later]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + self.window, -1)
            places, least, elsewhere = places[~inside], least[~inside], elsewhere[~inside]
        return np.cumsum(change[:-1]) > 0

    @cached_property
    def signs(self) -> str:
        """One sign for each word that runs through the automata."""
        return (self.codes[self.stream] % SIGNS).astype(np.uint8).tobytes().decode("latin-1")

    def compiled(self, places: np.ndarray) -> tuple[ahocorasick.Automaton, np.ndarray]:
        """An automaton of the phrases at some places, as many as it takes, and which those are."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text, window = self.signs, self.window
        inside = np.zeros(len(places), dtype=bool)
        for k, first in enumerate(np.searchsorted(self.stream, places[:PHRASES]).tolist()):
            phrase = text[first : first + window]
            if phrase not in automaton:
                automaton.add_word(phrase, k)
                inside[k] = True
        automaton.make_automaton()
        return automaton, inside

    def located(self, automaton: ahocorasick.Automaton, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence in the block of an automaton's phrases: its start, the number of its phrase."""
        hits = np.fromiter((end << 32 | k for end, k in automaton.iter(self.signs)), dtype=np.int64)
        ends, which = self.stream[hits >> 32], hits & 0xFFFFFFFF
        starts = self.stream[(hits >> 32) + 1 - self.window]
        # Not across documents, nor across words left out.
        same = self.here[starts] & (ends - starts == self.window - 1)
        starts, which = starts[same], which[same]
        same = np.ones(len(starts), dtype=bool)
        for k in range(self.window):
            same &= self.codes[starts + k] == self.codes[places[which] + k]
        return starts[same], which[same]

    def kept(self, gone: np.ndarray) -> pa.Array:
        """The words left of each document, joined by one space."""
        ends = np.concatenate([[0], np.cumsum(~gone)])[self.offsets]
        words = self.words.take(pa.array(self.codes[~gone])).cast(pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), " ")


class Phrases:
    """Distinct windows of a block, in the order of their keys."""

    def __init__(self, starts: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray, buckets: int):
        order = np.lexsort((starts, ids, low, high))
        high, low, ids = high[order], low[order], ids[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(first)
        self.high, self.low, self.least, self.place = high[at], low[at], ids[at], starts[order][at]
        last = np.append(at[1:], len(order)) - 1
        self.most = ids[last] if len(at) else ids
        edges = [(k << 64) // buckets for k in range(1, buckets)]
        inner = np.searchsorted(self.high, np.array(edges, dtype=np.uint64))
        self.cuts = np.concatenate([[0], inner, [len(at)]]).astype(np.int64)

    def rows(self, block: int) -> Iterator[tuple[int, int, bytes]]:
        """(block, bucket, keys) as planes of bytes: both halves of the keys, then their least ids."""
        columns = (self.high, self.low, self.least.view(np.uint64) ^ _SIGN)
        planes = np.concatenate([c.astype(">u8").view(np.uint8).reshape(-1, 8) for c in columns], axis=1)
        for bucket, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            if a < b:
                yield block, bucket, planes[a:b].T.tobytes()

    def confirmed(self, smaller: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that some document here loses: a place, the least id here, whether a smaller one is elsewhere."""
        elsewhere = np.zeros(len(self.place), dtype=bool)
        for answer in smaller or ():
            a, b = self.cuts[answer["bucket"]], self.cuts[answer["bucket"] + 1]
            bits = np.unpackbits(np.frombuffer(answer["bits"], dtype=np.uint8), bitorder="little")
            elsewhere[a:b] = bits[: b - a].astype(bool)
        some = elsewhere | (self.most > self.least)
        return self.place[some], self.least[some], elsewhere[some]


def larger_than_least(parts: list[bytes]) -> list[np.ndarray]:
    """For each key that blocks sent to a bucket, whether another block holds it with a smaller id."""
    planes = [np.frombuffer(part, dtype=np.uint8).reshape(PHRASE_KEY, -1).T for part in parts]
    ends = np.cumsum([len(p) for p in planes])
    high, low, ids = np.ascontiguousarray(np.concatenate(planes)).view(">u8").astype(np.uint64).T
    order = np.lexsort((ids, low, high))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.empty(len(order), dtype=bool)
    out[order] = ids[order] > least
    return np.split(out, ends[:-1])


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (rest, n_words, n_removed, kept) for every row of `docs`.

    `rest` is a struct of the columns other than the text, `kept` the remaining words.
    Ids must be whole numbers.
    """
    if window < GRAM:
        raise ValueError(f"a window holds {GRAM} words at least")
    blocks, buckets = stored_blocks(docs, text_col, BLOCK_SCALE)
    item = blocks.schema["rest"].dataType.elementType
    ids = F.col("rest").getField(id_col).cast("array<long>").alias("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Passages]]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                yield row, Passages(row, window, buckets)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, passages in each(batches):
            _, keys = passages.anchors()
            if len(keys.distinct):
                yield key_rows(keys.rows(row["block"].as_py(), SAMPLE_KEY))

    def send_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, passages in each(batches):
            phrases = passages.phrases(row["anchors"].as_py())
            if len(phrases.place):
                yield key_rows(phrases.rows(row["block"].as_py()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, passages in each(batches):
            gone = passages.removed(row["anchors"].as_py(), row["phrases"].as_py())
            columns = [
                row["rest"].values,
                pa.array(np.diff(passages.offsets)),
                pa.array(segment_sums(gone.astype(np.int64), passages.offsets).astype(np.int64)),
                passages.kept(gone),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "n_words", "n_removed", "kept"])

    anchors = map_batches(blocks.select("block", "sizes", "data", ids), send_anchors, KEY_ROWS)
    known = blocks.join(answers(sort_buckets(anchors, SAMPLE_KEY), "anchors"), "block", "left")
    phrases = map_batches(known.select("block", "sizes", "data", ids, "anchors"), send_phrases, KEY_ROWS)
    known = known.join(answers(judge_buckets(phrases, larger_than_least), "phrases"), "block", "left")
    schema = T.StructType(
        [
            T.StructField("rest", item),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return map_batches(known.select("rest", "sizes", "data", ids, "anchors", "phrases"), finish, schema)


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = remove_phrases(docs)
    return rows.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as texts; lists of words per document are rebuilt from what no window covers.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q
  FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY phrase) AS least FROM windows)
  WHERE least < doc_id
), lost AS (
  SELECT doc_id, count(*) AS n, list(q) AS places FROM gone GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""
