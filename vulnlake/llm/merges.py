"""Byte-pair merges of many plain words at once.

A tokenizer with end-of-word marks splits a word into its bytes and then joins the pair of
neighbours that comes first in its list of merges, the leftmost of equals, until no pair is
in the list. Words of one length are rows of a matrix here: every round joins one pair in
each row and looks up the two pairs that are new, so the work is a few array operations for
a hundred thousand words. Only words of lower-case Latin-1 letters come here; no other step
of the tokenizer changes or cuts them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: Bytes of the longest word taken.
LONGEST = 32
#: Words of the vocabulary that are compared with the tokenizer at first.
PROBES = 200
_NEVER = np.int32(1 << 30)


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    def __init__(self, model: dict):
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        signs = byte_signs()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.final = np.array([vocab[c + mark] for c in signs], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, joined = (np.array([vocab[x] for x in names], dtype=np.int64) for names in (*zip(*pairs), map("".join, pairs)))
        self.size = len(vocab) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int32), joined[order].astype(np.int32)
        # What letters begin with, by their codes: pairs inside a word and pairs at its end.
        codes = np.arange(256)
        self.first = self.find(self.inner[codes[:, None]], self.inner[codes])
        self.last = self.find(self.inner[codes[:, None]], self.final[codes])

    @classmethod
    def of(cls, path: str, alone: Callable[[str], list[int]]) -> Merges | None:
        """Merges of a tokenizer, or none where words of letters are made in another way."""
        with open(path, encoding="utf-8") as file:
            tokenizer = json.load(file)
        model = tokenizer["model"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in plain):
            return None
        merges = cls(model)
        # Words out of the vocabulary show whether anything else changes or cuts them.
        mark = model["end_of_word_suffix"]
        names = (name.removesuffix(mark) for name in list(model["vocab"])[:: len(model["vocab"]) // PROBES])
        words = [w for w in names if w.isascii() and w.isalpha() and w.islower() and len(w) <= LONGEST]
        ids, lengths = merges.encode(words)
        same = [i for w in words for i in alone(w)] == ids.tolist() and lengths.all()
        return merges if same else None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair in the list, `_NEVER` if it is not there, and what it becomes."""
        asked = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.ranks[at], _NEVER), self.joined[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of 1 to `LONGEST` bytes end to end, and how many each has."""
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(words))
        begin = np.cumsum(sizes) - sizes
        out = np.zeros((len(words), LONGEST), dtype=np.int32)
        lengths = sizes.copy()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            letters = data[begin[rows][:, None] + np.arange(size)]
            ids = self.inner[letters].astype(np.int32)
            ids[:, -1] = self.final[letters[:, -1]]
            self._merge(rows, letters, ids, out, lengths)
        inside = np.arange(LONGEST) < lengths[:, None]
        return out[inside].astype(np.uint32), lengths

    def _merge(self, rows: np.ndarray, letters: np.ndarray, ids: np.ndarray, out: np.ndarray, lengths: np.ndarray) -> None:
        ranks, joined = (x[letters[:, :-1], letters[:, 1:]] for x in self.first)
        if ids.shape[1] > 1:
            ranks[:, -1], joined[:, -1] = (x[letters[:, -2], letters[:, -1]] for x in self.last)
        while True:
            size = ids.shape[1]
            best = ranks.argmin(axis=1) if size > 1 else np.zeros(len(rows), dtype=np.int64)
            open_ = ranks[np.arange(len(rows)), best] < _NEVER if size > 1 else np.zeros(len(rows), dtype=bool)
            done = rows[~open_]
            out[done, :size] = ids[~open_]
            lengths[done] = size
            rows, ids, best = rows[open_], ids[open_], best[open_]
            if not len(rows):
                return
            ranks, joined = ranks[open_], joined[open_]
            row = np.arange(len(rows))
            ids[row, best] = joined[row, best]
            # The right half of the pair goes; so does the pair itself, of which its left neighbour takes the place.
            stays = np.ones(ids.shape, dtype=bool)
            stays[row, best + 1] = False
            ids = ids[stays].reshape(len(rows), -1)
            ranks, joined = (x[stays[:, 1:]].reshape(len(rows), -1) for x in (ranks, joined))
            for at in (best - 1, best):
                some = np.flatnonzero((at >= 0) & (at < size - 2))
                k = at[some]
                ranks[some, k], joined[some, k] = self.find(ids[some, k], ids[some, k + 1])
