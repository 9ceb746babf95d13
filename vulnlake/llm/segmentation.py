"""Subword encoding and decoding with sampled segmentations, distinct by Gumbel top-k.

A text is a chain of units: a run of spaces with the characters up to the next space. No
piece of the vocabulary crosses a space, so a unit has a lattice of its own, and the
segmentations of a text are all choices of one path per unit. Longer units are also cut
between characters that no piece holds side by side, which loses no segmentation either.
A piece's weight falls with its rank in the vocabulary; characters without a piece are
spelled in byte pieces.

Sampling is a perturbed A-star search. The set of all segmentations has a Gumbel value;
following the best child fixes one unit after the other and yields the first sample,
leaving at each unit the set of segmentations that agree before it and differ there, with
a Gumbel value drawn below its parent's. The best set left yields the next sample, and so
on: distinct segmentations, drawn without replacement in proportion to their weight. The
value of the best set left after the last sample turns each probability into an inclusion
score, given as a logarithm since long texts have very many segmentations. A path is drawn from one uniform number by the cumulated weights of its unit's
lattice, so sets that leave paths out skip those paths' intervals. Once a path has used up
half of the number's bits it goes on with a new one; such paths are left out by drawing
again. All numbers are hashes of the row key, the sample and the unit: a row gives the same
samples in any partition.

Defined cases: null and empty texts have one segmentation without pieces; a text with
fewer segmentations than asked for gives all of them, with log inclusion 0; repeated rows give
equal samples; a null key counts as 0; an empty table gives an empty result. Decoding an
encoded text gives the text back, whatever its characters; a null list decodes to null,
and ids outside the vocabulary are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import map_batches, mix64, ragged, segment_sums, sliced, table

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
#: Bytes of text that a task encodes at once; a worker holds some 300 times as many.
AT_ONCE = 1 << 20
#: A path goes on with a new number once its probability since the last one is below this.
SPENT = 2.0**-24
#: A piece of rank r weighs (r + SHIFT) ** -SHARPNESS; a byte piece weighs BYTE.
SHIFT, SHARPNESS, BYTE = 10.0, 0.5, 1e-3

#: Characters from a unit's end at which totals stay in the range of doubles, whatever the pieces.
NEAR = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(" *[^ ]+| +")


class Vocabulary:
    """Pieces with weights, found by a hash of their characters."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = [b""] * self.size
        ids, texts, weights = [], [], []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.text[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.text[i] = piece.encode()
                ids.append(i)
                texts.append(piece)
                weights.append((SHIFT - model.get_score(i)) ** -SHARPNESS)
        hashes = hash_texts(texts)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.weights = np.array(weights)[order]
        self.longest = max(map(len, texts))
        self.pairs = np.array(sorted({_pair(a, b) for x in texts for a, b in zip(x, x[1:])}), dtype=np.int64)
        # The first piece of each value of a hash's leading bits, and how many share one at most.
        leading = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.begin = np.searchsorted(leading, np.arange((1 << 20) + 1)).astype(np.int32)
        self.maybe = self.begin[1:] > self.begin[:-1]
        self.crowd = int(np.diff(self.begin).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places among the pieces."""
        leading = (hashes >> np.uint64(44)).astype(np.int64)
        at = np.flatnonzero(self.maybe[leading])
        asked, place = hashes[at], self.begin[leading[at]].astype(np.int64)
        same = self.hashes[place] == asked
        for k in range(1, self.crowd):
            left = np.flatnonzero(~same)
            further = np.minimum(self.begin[leading[at[left]]] + k, len(self.hashes) - 1)
            hit = self.hashes[further] == asked[left]
            place[left[hit]], same[left[hit]] = further[hit], True
        return at[same], place[same]

    def pieces_of_unit(self, unit: str) -> list[str]:
        """A long unit cut wherever no piece holds the two neighbouring characters."""
        codes = np.frombuffer(unit.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        place = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        cuts = [0, *(np.flatnonzero(self.pairs[place] != pairs) + 1).tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:])]


def _pair(a: str, b: str) -> int:
    return ord(a) << 32 | ord(b)


def hash_texts(pieces: list[str]) -> np.ndarray:
    state = np.zeros(len(pieces), dtype=np.uint64)
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        state[at] = _extend(state[at], codes[first[at] + k])
    return state


def _extend(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix64(state * _BASE + code + np.uint64(1))


@dataclass
class Lattices:
    """Lattices of several units, node by node.

    Edges of a node are in order of their length; `chance` is an edge's probability given
    its node and `below` the sum of chances before it.
    """

    first: np.ndarray  # first node of each unit
    last: np.ndarray  # its end node
    edges: np.ndarray  # first edge of each node, with one more at the end
    target: np.ndarray
    piece: np.ndarray  # id, or the vocabulary's size and a character to spell in bytes
    chance: np.ndarray
    below: np.ndarray


def lattices(units: list[str], vocabulary: Vocabulary) -> Lattices:
    codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the unit's end
    node = np.arange(len(codes)) + np.repeat(np.arange(len(units)), sizes)
    state = np.zeros(len(codes), dtype=np.uint64)
    here = np.arange(len(codes))
    parts = []
    spelled = np.ones(len(codes), dtype=bool)
    for n in range(1, min(vocabulary.longest, int(sizes.max(initial=0))) + 1):
        fits = left[here] >= n
        here, state = here[fits], state[fits]
        state = _extend(state, codes[here + n - 1])
        at, place = vocabulary.find(state)
        parts.append((here[at], np.full(len(at), n), vocabulary.ids[place], vocabulary.weights[place]))
        if n == 1:
            spelled[here[at]] = False
            bare = np.flatnonzero(spelled)
            width = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
            parts.append((bare, np.ones(len(bare), dtype=np.int64), vocabulary.size + codes[bare].astype(np.int64), BYTE**width))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        first = np.arange(len(units))
        return Lattices(first, first, np.zeros(len(units) + 1, dtype=np.int64), none, none, none * 1.0, none * 1.0)
    n_nodes = len(codes) + len(units)
    edges = np.zeros(n_nodes + 1, dtype=np.int64)
    np.cumsum(sum(np.bincount(node[p[0]], minlength=n_nodes) for p in parts), out=edges[1:])
    n_edges = int(edges[-1])
    source, length = np.empty(n_edges, dtype=np.int64), np.empty(n_edges, dtype=np.int64)
    piece, weight = np.empty(n_edges, dtype=np.int64), np.empty(n_edges)
    free = edges[node]  # the next free edge of each character's node; shorter pieces come first
    for at, long, ids, weights in parts:
        slot = free[at]
        source[slot], length[slot], piece[slot], weight[slot] = at, long, ids, weights
        free[at] += 1
    start = node[source]
    target = start + length
    # A node's total is total * 2 ** power: in long units it leaves the range of doubles.
    total, power = np.ones(n_nodes), np.zeros(n_nodes, dtype=np.int64)
    far = left[source].astype(np.min_scalar_type(int(sizes.max())))
    by_left = np.argsort(far, kind="stable")
    steps = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=int(sizes.max()) + 1))])[1:]
    for k, (a, b) in enumerate(zip(steps, steps[1:]), 1):
        e = by_left[a:b]
        if len(e):
            own = start[e]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if k <= NEAR:
                total[own[new]] = np.add.reduceat(weight[e] * total[target[e]], new)
                continue
            up = power[target[e]]
            most = np.maximum.reduceat(up, new)
            up -= np.repeat(most, np.diff(np.append(new, len(e))))
            sums = np.add.reduceat(np.ldexp(weight[e] * total[target[e]], up), new)
            total[own[new]], more = np.frexp(sums)
            power[own[new]] = most + more
    chance = weight * total[target] / total[start]
    scaled = np.flatnonzero(far > NEAR)
    chance[scaled] = np.ldexp(chance[scaled], power[target[scaled]] - power[start[scaled]])
    running = np.concatenate([[0.0], np.cumsum(chance)])
    below = np.maximum(running[:-1] - running[edges[start]], 0.0)
    first = ends - sizes + np.arange(len(units))
    return Lattices(first, first + sizes, edges, target, piece, chance, np.maximum(below, 0.0))


@dataclass
class Paths:
    """Drawn paths: their edges end to end, and each one's interval in its unit's order.

    A path that took more than one number has no interval: its `low` is 2.
    """

    edges: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    width: np.ndarray
    log_width: np.ndarray


def draw(lattice: Lattices, units: np.ndarray, u: np.ndarray, again: Callable[[np.ndarray, int], np.ndarray]) -> Paths:
    """One path per entry of `units`, by a number from 0 to 1.

    `again` gives new numbers for some entries, and is told how many edges they have.
    """
    n = len(units)
    low, width, counts = np.zeros(n), np.ones(n), np.zeros(n, dtype=np.int64)
    log_width, renewed = np.zeros(n), np.zeros(n, dtype=bool)
    at, node, u = np.arange(n), lattice.first[units], u.copy()
    steps = []
    moving = node < lattice.last[units]
    at, node, u = at[moving], node[moving], u[moving]
    end = lattice.last[units]
    while len(at):
        edge = lattice.edges[node].copy()
        final = lattice.edges[node + 1] - 1
        open_ = np.flatnonzero(edge < final)
        while len(open_):
            up = open_[u[open_] >= lattice.below[edge[open_] + 1]]
            edge[up] += 1
            open_ = up[edge[up] < final[up]]
        below, chance = lattice.below[edge], lattice.chance[edge]
        before = width[at]
        low[at] += before * below
        width[at] = since = before * chance
        u = np.clip((u - below) / chance, 0.0, 1.0 - 2.0**-53)
        counts[at] += 1
        steps.append((at, edge))
        node = lattice.target[edge]
        moving = node < end[at]
        at, node, u = at[moving], node[moving], u[moving]
        spent = np.flatnonzero(since[moving] < SPENT)
        if len(spent):
            u[spent] = again(at[spent], len(steps))
            log_width[at[spent]] += np.log(width[at[spent]])
            width[at[spent]], renewed[at[spent]] = 1.0, True
    log_width += np.log(width)
    low[renewed], width[renewed] = 2.0, np.exp(log_width[renewed])
    start = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), dtype=np.int64)
    for k, (at, edge) in enumerate(steps):
        edges[start[at] + k] = edge
    return Paths(edges, counts, low, width, log_width)


def uniform(keys: np.ndarray, purpose: int, sample: int, unit: np.ndarray) -> np.ndarray:
    """A number strictly between 0 and 1 per entry."""
    x = mix64(keys + np.uint64((2 * sample + purpose) * int(_BASE) % (1 << 64)))
    x = mix64(x ^ (unit.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Search:
    """Samples without replacement for the texts of one batch."""

    def __init__(self, texts: pa.Array, keys: np.ndarray, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.n = len(texts)
        units, self.units, counts = split_units(texts, vocabulary)
        self.lattice = lattices(units, vocabulary)
        self.text = np.repeat(np.arange(self.n), counts)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        self.place = np.arange(len(self.units)) - self.offsets[self.text]
        self.keys = mix64(keys.view(np.uint64))

    def samples(self, k: int) -> tuple[list[tuple], np.ndarray]:
        """(live, ids, offsets, log p, Gumbel) per sample, and the value of the best set left."""
        n, total = self.n, len(self.units)
        row_keys = self.keys[self.text]
        gumbel = -np.log(-np.log(uniform(self.keys, 0, 0, np.full(n, -1))))
        live = np.ones(n, dtype=bool)
        out, trees = [], []
        best = np.full(n, -1)  # the unit at which the next sample leaves its parent
        parent = np.full(n, -1)
        for s in range(k):
            u = uniform(row_keys, 0, s, self.place)
            if s == 0:
                fresh = np.ones(total, dtype=bool)
                base = None
            else:
                leave = np.where(live, best, 1 << 60)[self.text]
                fresh = self.place >= leave
                base = self._inherit(trees, parent, best, live)
                at = np.flatnonzero((self.place == leave) & live[self.text])
                u[at] = self._skip(trees, parent, best, at, u[at])
            paths = self._draw(np.flatnonzero(fresh), u[fresh], row_keys, s)
            if base is not None:
                self._redraw(trees, parent, best, np.flatnonzero(fresh), at, paths, row_keys, s)
            low, width, log_width = np.zeros(total), np.ones(total), np.zeros(total)
            counts = np.zeros(total, dtype=np.int64)
            if base is not None:
                low, width, log_width = base["low"].copy(), base["width"].copy(), base["log_width"].copy()
                counts = base["counts"].copy()
            low[fresh], width[fresh], counts[fresh] = paths.low, paths.width, paths.counts
            log_width[fresh] = paths.log_width
            merged = np.empty(int(counts.sum()), dtype=np.int64)
            start = np.cumsum(counts) - counts
            merged[ragged(start[fresh], counts[fresh])] = paths.edges
            if base is not None:
                kept = ~fresh
                merged[ragged(start[kept], counts[kept])] = base["edges"][ragged(base["start"][kept], base["counts"][kept])]
            log_p = segment_sums(log_width, self.offsets)
            running = np.concatenate([[0.0], np.cumsum(log_width)])
            before = running[:-1] - running[self.offsets[self.text]]
            rest = 1.0 - width
            if s:
                # At the unit of departure the paths of the parents are left out as well.
                for _, widths, _ in self._excluded(trees, parent, best, at):
                    rest[at] -= widths
            open_ = fresh & (rest > 1e-15) & live[self.text]
            value = np.full(total, -np.inf)
            e = -np.log(uniform(row_keys[open_], 1, s, self.place[open_]))
            phi = before[open_] + np.log(rest[open_])
            value[open_] = phi - np.log(np.exp(np.minimum(phi - gumbel[self.text[open_]], 700)) + e)
            trees.append({"low": low, "width": width, "log_width": log_width, "counts": counts, "edges": merged, "start": start, "value": value, "from": (parent.copy(), best.copy())})
            out.append((live.copy(), merged, start, counts, log_p, gumbel.copy()))
            # The best set left over all samples so far.
            top, parent, best = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
            for j, tree in enumerate(trees):
                most, where = _maxima(tree["value"], self.offsets)
                better = most > top
                top[better], parent[better], best[better] = most[better], j, where[better]
            for j, tree in enumerate(trees):
                used = np.flatnonzero((parent == j) & (top > -np.inf))
                if s + 1 < k:
                    tree["value"][self.offsets[used] + best[used]] = -np.inf
            live, gumbel = top > -np.inf, top
        return out, gumbel

    def _draw(self, at: np.ndarray, u: np.ndarray, row_keys: np.ndarray, s: int, turn: int = 0) -> Paths:
        """Paths for the units `at`; `turn` sets draws apart that are done again."""

        def again(some: np.ndarray, step: int) -> np.ndarray:
            keys = mix64(row_keys[at[some]] + np.uint64((step << 32) + turn))
            return uniform(keys, 0, s, self.place[at[some]])

        return draw(self.lattice, self.units[at], u, again)

    def _redraw(self, trees: list[dict], parent: np.ndarray, best: np.ndarray, fresh: np.ndarray, at: np.ndarray, paths: Paths, row_keys: np.ndarray, s: int) -> None:
        """Draw again, in `paths`, where a path without an interval is one that its set leaves out."""
        found = self._excluded(trees, parent, best, at)
        own = np.searchsorted(fresh, at)  # places of the units of departure among the drawn ones
        turn = 0
        while True:
            start = np.cumsum(paths.counts) - paths.counts
            same = []
            for lows, _, who in found:
                for j, tree in enumerate(trees):
                    near = np.flatnonzero((who == j) & (lows == 2.0) & (tree["log_width"][at] == paths.log_width[own]))
                    for k in near.tolist():
                        a, b, n = start[own[k]], tree["start"][at[k]], tree["counts"][at[k]]
                        if n == paths.counts[own[k]] and np.array_equal(paths.edges[a : a + n], tree["edges"][b : b + n]):
                            same.append(k)
            if not same:
                return
            turn += 1
            k = np.unique(same)
            u = uniform(mix64(row_keys[at[k]] + np.uint64(turn)), 0, s, self.place[at[k]])
            new = self._draw(at[k], self._skip(trees, parent, best, at[k], u), row_keys, s, turn)
            redrawn = np.zeros(len(paths.counts), dtype=bool)
            redrawn[own[k]] = True
            counts = paths.counts.copy()
            counts[own[k]] = new.counts
            edges = np.empty(int(counts.sum()), dtype=np.int64)
            first = np.cumsum(counts) - counts
            edges[ragged(first[own[k]], new.counts)] = new.edges
            edges[ragged(first[~redrawn], counts[~redrawn])] = paths.edges[ragged(start[~redrawn], counts[~redrawn])]
            paths.edges, paths.counts = edges, counts
            paths.low[own[k]], paths.width[own[k]], paths.log_width[own[k]] = new.low, new.width, new.log_width

    def _inherit(self, trees: list[dict], parent: np.ndarray, best: np.ndarray, live: np.ndarray) -> dict:
        """Each text's parent sample, in one table."""
        if len(trees) == 1:
            return trees[0]
        own = np.maximum(parent, 0)[self.text]
        pick = lambda name: np.choose(own, [t[name] for t in trees])
        counts = pick("counts")
        start = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), dtype=np.int64)
        for j, tree in enumerate(trees):
            at = np.flatnonzero(own == j)
            edges[ragged(start[at], counts[at])] = tree["edges"][ragged(tree["start"][at], tree["counts"][at])]
        return {"low": pick("low"), "width": pick("width"), "log_width": pick("log_width"), "counts": counts, "start": start, "edges": edges}

    def _excluded(self, trees: list[dict], parent: np.ndarray, best: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Intervals that the set at each unit of departure leaves out, and whose they are (-1: none), per ancestor."""
        text = self.text[at]
        now, found = parent[text], []
        for _ in trees:
            lows, widths = np.full(len(at), 2.0), np.zeros(len(at))
            older = np.full(len(at), -1)
            for j, tree in enumerate(trees):
                own = np.flatnonzero(now == j)
                lows[own], widths[own] = tree["low"][at[own]], tree["width"][at[own]]
                # A parent that left its own parent at this very unit leaves that path out too.
                before, place = tree["from"]
                same = place[text[own]] == best[text[own]]
                older[own] = np.where(same, before[text[own]], -1)
            found.append((lows, widths, now))
            now = older
        return found

    def _skip(self, trees: list[dict], parent: np.ndarray, best: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Numbers spread over what the excluded intervals leave."""
        found = self._excluded(trees, parent, best, at)
        lows, widths = np.stack([x[0] for x in found]), np.stack([x[1] for x in found])
        widths = np.where(lows < 2.0, widths, 0.0)
        order = np.argsort(lows, axis=0)
        lows, widths = np.take_along_axis(lows, order, 0), np.take_along_axis(widths, order, 0)
        u = u * np.maximum(1.0 - widths.sum(axis=0), 0.0)
        for low, width in zip(lows, widths):
            u = np.where(u >= low, u + width, u)
        return np.minimum(u, 1.0 - 2.0**-53)

    def ids(self, merged: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a sample end to end, and where each text's begin and end."""
        piece = self.lattice.piece[merged]
        per_text = np.concatenate([[0], np.cumsum(counts)])[self.offsets]
        return spell(piece, per_text, self.vocabulary)


def _maxima(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value between neighbouring offsets and its place there."""
    n = len(offsets) - 1
    top, where = np.full(n, -np.inf), np.full(n, -1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        top[full] = np.maximum.reduceat(values, offsets[full])
        own = np.repeat(top, np.diff(offsets))
        first = np.flatnonzero((values == own) & (values > -np.inf))
        text = np.searchsorted(offsets, first, side="right") - 1
        where[text[::-1]] = (first - offsets[text])[::-1]
    return top, where


def log_inclusion(above: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x))) of log chances above the threshold; 0 where nothing is left out."""
    chance = -np.expm1(-np.exp(np.clip(above, -30, 30)))
    return np.where(above < -30, above, np.log(chance))


def by_spaces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have single spaces between words only, then the others."""
    texts = batch.column(1).fill_null("")
    odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.equal(texts, ""))
    for part in (batch.filter(pc.invert(odd)), batch.filter(odd)):
        if part.num_rows:
            yield part


def split_units(texts: pa.Array, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units, the number of each text's units in turn, and how many each text has.

    Texts in which each space stands alone between words are cut at the spaces; one that is
    empty or has other spaces makes the batch go through the pattern.
    """
    lists = pc.split_pattern(texts, " ")
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    units = [" " + w for w in coded.dictionary.to_pylist()]
    codes = np.asarray(coded.indices, dtype=np.int64)
    if " " in units:
        number: dict[str, int] = {}
        found = [_UNIT.findall(" " + x) if x else [] for x in texts.to_pylist()]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        codes = np.array([number.setdefault(u, len(number)) for x in found for u in x], dtype=np.int64)
        units = list(number)
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    long = np.flatnonzero(lengths > vocabulary.longest).tolist()
    if long:
        sizes, parts, done = np.ones(len(units), dtype=np.int64), [], 0
        for k in long:
            cut = vocabulary.pieces_of_unit(units[k])
            sizes[k] = len(cut)
            parts += units[done:k] + cut
            done = k + 1
        units = parts + units[done:]
        text = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(text, sizes[codes], len(counts)).astype(np.int64)
        codes = ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])
    return units, codes, counts


def spell(piece: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by byte pieces."""
    bare = np.flatnonzero(piece >= vocabulary.size)
    if not len(bare):
        return piece, offsets
    spelled = [[vocabulary.bytes[b] for b in chr(c).encode()] for c in (piece[bare] - vocabulary.size).tolist()]
    widths = np.ones(len(piece), dtype=np.int64)
    widths[bare] = [len(x) for x in spelled]
    out = np.repeat(piece, widths)
    start = np.cumsum(widths) - widths
    out[ragged(start[bare], widths[bare])] = [b for x in spelled for b in x]
    return out, np.concatenate([[0], np.cumsum(widths)])[offsets]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, text: list[bytes]) -> list[bytes]:
    """The bytes that ids between neighbouring offsets stand for, without the first space."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(text)):
        raise ValueError("an id is outside the vocabulary")
    lengths = np.array([len(x) for x in text], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(text), dtype=np.uint8)[ragged(starts[ids], lengths[ids])].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[offsets].tolist()
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends, ends[1:])]


def encode_samples(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    samples: int = SAMPLES,
    model: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """Up to `samples` distinct segmentations per row, the one with the largest Gumbel value first.

    Columns id, sample, n_pieces, log_p, log_inclusion and ids; with `digest` the CRC-32 of
    the ids as little-endian 32-bit numbers, and whether decoding them gives the text
    back, stand in place of the ids.
    """
    path = model or public_tokenizers.path(MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in (part for whole in sliced(batches, AT_ONCE) for part in by_spaces(whole)):
            texts = batch.column(1).fill_null("")
            keys = np.asarray(batch.column(0).fill_null(0), dtype=np.int64)
            search = Search(texts, keys, vocabulary)
            found, left = search.samples(samples)
            raw_texts = texts.cast(pa.binary()).to_pylist() if digest else []
            for s, (live, merged, _, counts, log_p, _) in enumerate(found):
                ids, offsets = search.ids(merged, counts)
                at = np.flatnonzero(live)
                inclusion = log_inclusion(log_p - left)
                columns = [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.full(len(at), s, dtype=np.int32)),
                    pa.array(np.diff(offsets)[at]),
                    pa.array(log_p[at]),
                    pa.array(inclusion[at]),
                ]
                names = ["id", "sample", "n_pieces", "log_p", "log_inclusion"]
                if digest:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    ends = (4 * offsets).tolist()
                    crc = [zlib.crc32(raw[ends[k] : ends[k + 1]]) for k in at.tolist()]
                    back = decode_ids(ids, offsets, vocabulary.text)
                    exact = [back[k] == raw_texts[k] for k in at.tolist()]
                    columns += [pa.array(crc, type=pa.int64()), pa.array(exact, type=pa.bool_())]
                    names += ["ids_crc32", "exact"]
                else:
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    columns.append(lists.take(pa.array(at)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    last = "ids_crc32 long, exact boolean" if digest else "ids array<int>"
    return map_batches(rows, run, f"id long, sample int, n_pieces long, log_p double, log_inclusion double, {last}")


def decode(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) for lists of piece ids."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Vocabulary(path).text
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            back = decode_ids(np.concatenate([np.zeros(0, dtype=np.int64), *lists]), offsets, text)
            whole = [x.decode("utf-8", "replace") if given.is_valid else None for x, given in zip(back, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, type=pa.string())], ["id", "text"])

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_batches(chosen, run, "id long, text string")


def op10_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")
