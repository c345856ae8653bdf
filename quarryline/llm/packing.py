"""Packing of tokenised documents into few sequences by linear grouping.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver. There the large
lengths are rounded up within groups of equal cardinality; a linear programme over configurations of the few
rounded sizes (column generation, a knapsack prices the columns) says how many sequences of which
configuration to open; actual lengths take the places of rounded ones; best fit then puts the small lengths
and what rounding down left over into the gaps. All of it works on runs of equal sequences, so the plan's
size depends on the capacity, not on the number of documents. Each piece finds its place by its length and
its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm.bpe import Merges
from quarryline.llm.common import keep, shuffle_partitions
from quarryline.llm.workers import released, runs

CAPACITY, END_ID = 4096, 1
#: Lengths above capacity / LARGE are grouped, into GROUPS groups.
LARGE, GROUPS = 8, 64
#: Pivots of the linear programme at most; stopping early only costs quality.
PIVOTS = 800
#: Words whose ids a task remembers twice over: the newest so many, and the generation before.
REMEMBERED = 120_000
#: Bytes of text that are taken apart together; bounds the memory of a worker, not what is read.
SLICE = 1_000_000
#: A run of these at a word's end, after a letter, is a token sequence of its own for this tokenizer.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

_tokenizers: dict[str, Words] = {}


class _Known(dict):
    """Words and their ids; a word that is not there is noted and gives None."""

    def __init__(self):
        super().__init__()
        self.asked: set[bytes] = set()

    def __missing__(self, word: bytes) -> None:
        self.asked.add(word)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(text: str) -> bool:
    """Whether a text is letters only and the tokenizer's NFC and lower case leave it so; some letters become a letter and a mark."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


def _folded(word: bytes) -> bytes | None:
    """The normalised form of a word of letters below U+0250, whose lower case is the same everywhere; None for other words."""
    text = word.decode()
    if not text.isalpha():
        return None
    if text.isascii():
        return word.lower()
    text = unicodedata.normalize("NFC", text).lower()
    return text.encode() if max(text) < "\u0250" and text.isalpha() else None


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters that end with ASCII white space."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


_BLANK = re.compile(r"[\x20\t\n\r\f\v]")


class Words:
    """Ids of words as little-endian unsigned 32-bit numbers, each word encoded once while it is remembered.

    ASCII white space ends words for this tokenizer and A-Z count as lower case, so the ids of a text are
    those of its words. Texts that may hold special tokens are not lower-cased, for that could make some.
    Words of letters, each one run of merges for this tokenizer, are merged many at a time; others go through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.before = _Known(), _Known()

    def _encode(self, new: list[bytes]) -> None:
        letters, folded, mixed = [], [], []
        for w in new:
            plain = _folded(w)
            if plain is None:
                mixed.append(w)
            else:
                letters.append(w)
                folded.append(plain)
        if letters:
            ids, sizes = self.merges.encode(folded)
            data, lo = ids.astype("<u4").tobytes(), 0
            for w, hi in zip(letters, (4 * np.cumsum(sizes)).tolist(), strict=True):
                self.known[w] = data[lo:hi]
                lo = hi
        for w, e in zip(mixed, self.tokenizer.encode_batch_fast([w.decode() for w in mixed], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, before = self.known, self.before
        rest, parts = set(), []
        for w in new:
            if (got := before.get(w)) is not None:
                known[w] = got
                continue
            core = w.rstrip(MARKS)
            if len(core) < len(w) and b"<|" not in w and _letters(core.decode()[-1:]):
                parts.append((w, core, tail := w[len(core) :]))
                for part in (core, tail):
                    if part not in known:
                        if (got := before.get(part)) is not None:
                            known[part] = got
                        else:
                            rest.add(part)
            else:
                rest.add(w)
        self._encode(list(rest))
        for w, core, tail in parts:
            known[w] = known[core] + known[tail]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; a long text goes in parts, for white space ends words."""
        if max(map(len, texts), default=0) <= SLICE:
            return self._ids(texts)
        return [b"".join(self._ids([part])[0] for part in _parts(t)) for t in texts]

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = _Known(), self.known
        known = self.known
        split = [(t.encode().lower() if "<|" not in t else t.encode()).split() for t in texts]
        found = [list(map(known.__getitem__, words)) for words in split]
        if known.asked:
            new, known.asked = known.asked, set()
            self._learn(new)
            found = [[got if got is not None else known[w] for w, got in zip(words, have, strict=True)] if None in have else have for words, have in zip(split, found, strict=True)]
        return [b"".join(got) for got in found]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path].ids(texts)


def _pieces(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(docs: list, texts: list[str]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for doc, tokens in zip(docs, token_bytes(texts, path), strict=True):
            tokens += end
            for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                ids = tokens[at : at + 4 * capacity]
                for column, value in zip(out, (doc, piece, at // 4, len(ids) // 4, zlib.crc32(ids)), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at, texts in runs(batch.column("text"), SLICE):
                    yield cut(batch.column("doc_id").slice(at, len(texts)).to_pylist(), texts)
        finally:  # the worker serves other tasks next
            if path in _tokenizers:
                _tokenizers[path].forget()

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than capacity are cut, others are whole."""
    return docs.select("doc_id", "text").mapInArrow(released(_pieces(path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(size numbers of a configuration, how many sequences)]: the rounded-down optimum of the linear programme."""
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    basis, inverse = list(range(k)), np.diag([1 / c[i] for i, c in enumerate(columns)])
    x = inverse @ np.array(demand, float)
    most = capacity // min(sizes)
    for _ in range(PIVOTS):
        price = inverse.sum(axis=0)
        # best value by number of items; each layer adds one item to the layer before
        value, came = np.zeros(capacity + 1), []
        for _layer in range(most):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for i in range(k):
                if price[i] > 1e-12:
                    w = sizes[i]
                    cand = value[: capacity + 1 - w] + price[i]
                    better = cand > best[w:] + 1e-12
                    best[w:][better] = cand[better]
                    pick[w:][better] = i
            value = best
            came.append(pick)
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(came):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        columns.append(column)
        basis[out] = len(columns) - 1
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return [(tuple(i for i in range(k) for _ in range(int(columns[b][i]))), int(np.floor(v + 1e-9))) for b, v in zip(basis, x, strict=True) if v >= 1 - 1e-9]


@dataclass
class Plan:
    """Runs (length, first rank, number, first sequence, offset): rank first + j goes to sequence first + j."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    open: list[int] = field(default_factory=list)

    def free(self, left: int, first: int, number: int) -> None:
        """Sequences first to first + number - 1 have left places free at their end."""
        if left and number:
            if left not in self.gaps:
                self.gaps[left] = []
                bisect.insort(self.open, left)
            self.gaps[left].append((first, number))

    def take(self, left: int) -> tuple[int, int]:
        got = self.gaps[left].pop()
        if not self.gaps[left]:
            del self.gaps[left]
            self.open.remove(left)
        return got

    def best_fit(self, length: int, rank: int, number: int) -> None:
        """Each piece goes where least is left over; equal pieces fill a gap as often as they fit."""
        while number:
            at = bisect.bisect_left(self.open, length)
            if at < len(self.open):
                left = self.open[at]
                first, many = self.take(left)
            else:
                left, first = self.capacity, self.sequences
                many = max(1, number // (left // length))
                self.sequences += many
            each = min(left // length, number)
            use = min(many, number // each)
            if use < many:
                self.free(left, first + use, many - use)
            for j in range(each):
                self.runs.append((length, rank, use, first, self.capacity - left + j * length))
                rank += use
            number -= each * use
            self.free(left - each * length, first, use)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Places for histogram[length] pieces of each length."""
    out = Plan(capacity)
    taken = dict.fromkeys(histogram, 0)
    out.best_fit(capacity, 0, histogram.get(capacity, 0))
    taken[capacity] = histogram.get(capacity, 0)
    large = sorted((x for x in histogram if capacity // LARGE < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        # linear grouping: runs (length, number) of each group, largest first; a group's size is its largest length
        members: list[list[list[int]]] = []
        share, room = -(-total // groups), 0
        for x in large:
            left = histogram[x]
            while left:
                if not room:
                    members.append([])
                    room = share
                use = min(left, room)
                members[-1].append([x, use])
                left, room = left - use, room - use
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = sorted(merged, reverse=True)
        for config, number in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            first = out.sequences
            out.sequences += number
            # substitution: the slots' actual lengths change together only where a run of some slot ends
            slots = []
            for i in config:
                need, runs = number, []
                while need and merged[sizes[i]]:
                    x, n = merged[sizes[i]][0]
                    use = min(need, n)
                    runs.append((x, use))
                    need -= use
                    if use == n:
                        merged[sizes[i]].pop(0)
                    else:
                        merged[sizes[i]][0][1] -= use
                slots.append(runs)
            ends = sorted({e for runs in slots for e in np.cumsum([n for _, n in runs]).tolist()} | {number})
            at = 0
            cursors = [[0, 0] for _ in slots]
            for end in ends:
                offset = 0
                for runs, cursor in zip(slots, cursors, strict=True):
                    if cursor[0] < len(runs):
                        x = runs[cursor[0]][0]
                        out.runs.append((x, taken[x], end - at, first + at, offset))
                        taken[x] += end - at
                        offset += x
                        cursor[1] += end - at
                        if cursor[1] == runs[cursor[0]][1]:
                            cursor[0], cursor[1] = cursor[0] + 1, 0
                out.free(capacity - offset, first + at, end - at)
                at = end
    for x in sorted(histogram, reverse=True):
        if histogram[x] > taken[x]:
            out.best_fit(x, taken[x], histogram[x] - taken[x])
    return out


def ranked(cut: DataFrame) -> DataFrame:
    """Numbers the pieces of each length from 0. Lengths are dealt out by a hash of the id, so a frequent length is no single task's."""
    parts = 4 * shuffle_partitions(cut.sparkSession)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "start", "ids_crc32"))
    return dealt.withColumn("place", within).join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place") - 1).alias("rank"))


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, planned = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = planned[at, 3] + rank - planned[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(planned[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a piece of the end id alone. Repeated rows are packed each, ids may be null. An
    empty table gives an empty result; other columns, whatever their names, are not looked at. Long texts are
    encoded in parts that end at white space and cut into pieces of capacity ids.
    """
    cut = keep(pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path or default_tokenizer(), capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, capacity).runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(((runs[:, 0] << 48) | runs[:, 1], runs))
    return ranked(cut).mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
