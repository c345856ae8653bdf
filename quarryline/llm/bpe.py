"""Byte-pair encoding of many short words at once, after the merge table of a byte-level tokenizer file.

All words lie behind each other in one array of symbols. Each round finds the earliest merge that every word
still has, carries it out wherever the word holds that pair, and lets go of the words that have none left.
A merge makes a symbol that no other merge makes, so merges that hold it come later in the table, and doing
all places of one merge in one round is what doing them one by one from the left would give.
"""

from __future__ import annotations

import json

import numpy as np

#: Rank of a pair that is not in the table.
NONE = np.int32((1 << 31) - 1)
_SLOT_BITS = 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merge table; fits tokenizers whose words end in a suffix and in which each merge makes a symbol of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.final = np.array([ids[c + suffix] for c in alphabet], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        if len(set(self.made.tolist())) != len(self.made):
            raise ValueError("a symbol is made by two merges")
        self.width = np.uint64(max(ids.values()) + 1)
        left, right = (np.array([ids[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.keys, self.ranks = np.full(1 << _SLOT_BITS, -1, np.int64), np.full(1 << _SLOT_BITS, NONE)
        key = left * self.width + right
        for rank, (k, at) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << _SLOT_BITS) - 1)
            self.keys[at], self.ranks[at] = k, rank

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLIER) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by open addressing."""
        key = left.astype(np.uint64) * self.width + right.astype(np.uint64)
        at, key = self._slot(key), key.astype(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], NONE)
        todo = np.nonzero((there != key) & (there >= 0))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << _SLOT_BITS) - 1)
            there = self.keys[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words behind each other, how many each has); words are normalised and not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        rank = np.full(len(symbol), NONE)
        rank[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[ends - 1] = NONE
        word, done, sizes = np.arange(len(words)), [], np.zeros(len(words), np.int64)
        while len(word):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                out = np.repeat(over, lengths)
                done.append((word[over], symbol[out]))
                sizes[word[over]] = lengths[over]
                symbol, rank, word, lengths, least = symbol[~out], rank[~out], word[~over], lengths[~over], least[~over]
                if not len(word):
                    break
            hit = rank == np.repeat(least, lengths)
            again = np.nonzero(hit[1:] & hit[:-1])[0] + 1
            for at in again.tolist():  # three or more equal symbols in a row: every other place, from the left
                hit[at] = not hit[at - 1]
            at = np.nonzero(hit)[0]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            last = np.cumsum(lengths) - 1
            lengths = lengths - np.diff(np.searchsorted(at, np.concatenate([[0], last + 1])))
            final = np.zeros(len(symbol), bool)
            final[last] = True
            final[at] |= final[at + 1]
            at = at - np.arange(len(at))  # one symbol goes behind each earlier place
            symbol, rank, final = symbol[stay], rank[stay], final[stay]
            before = at[at > 0] - 1
            changed = np.concatenate([at, before[~final[before]]])
            changed = changed[~final[changed]]
            rank[at] = NONE
            rank[changed] = self._rank(symbol[changed], symbol[changed + 1])
        return self._in_order(done, sizes)

    @staticmethod
    def _in_order(done: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that ended in different rounds, in the words' order."""
        out = np.empty(int(sizes.sum()), np.int32)
        first = np.cumsum(sizes) - sizes
        for word, ids in done:
            n = sizes[word]
            out[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes
