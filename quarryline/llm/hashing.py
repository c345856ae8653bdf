"""Vectorised 64-bit hashing of words and word shingles, whole batches at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes of text that are hashed together; bounds the memory of a worker, not what is read.
SLICE = 500_000
WORDS = 5
_STEP = 0x9E3779B97F4A7C15
#: Odd and 3 modulo 4, so that swapped letters never cancel.
_BASE = 0xD1342543DE82EF95 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(21).integers(0, 1 << 64, 64, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are summed up together; powers of the base reach no further.
_REACH = 1 << 16


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x + U((_STEP * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int) -> np.ndarray:
    p = np.full(_REACH, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_BASE), _powers(_BASE_INVERSE)


def _sums_at(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The polynomial sum of the bytes before each of the rising edges, one block of bytes after the other."""
    out = np.zeros(len(edges), np.uint64)
    total, scale, step, done = 0, 1, pow(_BASE, _REACH, 1 << 64), 0
    for lo in range(0, len(data), _REACH):
        block = np.cumsum(_TABLE[data[lo : lo + _REACH]] * _UP[: len(data) - lo])
        upto = int(np.searchsorted(edges, lo + len(block), side="right"))
        here = edges[done:upto] - lo
        out[done:upto] = U(total) + U(scale) * np.where(here > 0, block[here - 1], U(0))
        done, total, scale = upto, (total + scale * int(block[-1])) & _MASK, (scale * step) & _MASK
    return out


def slices(texts: list, most: int = SLICE):
    """Runs of texts of about ``most`` bytes; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


#: Separates words at everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(texts: list[bytes], separates: np.ndarray = _SPACE):
    """(hash, document number, start, end) of each word; ASCII white space separates, A-Z is lower-cased."""
    joined = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = separates[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    # a power of the inverse takes a word's place out of its sum, in two factors
    far = np.array([pow(_BASE_INVERSE, _REACH * i, 1 << 64) for i in range(len(data) // _REACH + 1)], np.uint64)
    hashes = mix((_sums_at(data, ends) - _sums_at(data, starts)) * _DOWN[starts % _REACH] * far[starts // _REACH])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(limits, starts, side="right").astype(np.int64), starts, ends


def grams(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of the n values from each place on."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * _PLACE[j]
    return mix(total, salt)


def shingle_sets(texts: list[bytes]):
    """(document number, token) of the distinct shingles of each text, sorted by both; the words of a shorter text are one shingle."""
    h, doc, _, _ = words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    token = grams(h, WORDS, 1)
    owner = doc[: len(token)]
    inside = owner == doc[WORDS - 1 :] if len(token) else np.zeros(0, bool)
    short = np.nonzero((counts > 0) & (counts < WORDS))[0]
    whole = np.zeros(len(short), np.uint64)
    for j in range(WORDS - 1):
        has = counts[short] > j
        whole[has] += h[first[short[has]] + j] * _PLACE[j]
    whole = mix(whole + counts[short].astype(np.uint64) * _PLACE[WORDS + 1], 2)
    owner, token = np.concatenate([owner[inside], short]), np.concatenate([token[inside], whole])
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


def set_ids(owner: np.ndarray, token: np.ndarray, n: int):
    """(size, identity) of each set; equal sets have equal identities, empty ones 0."""
    sizes = np.bincount(owner, minlength=n)
    ids = np.zeros(n, np.uint64)
    np.add.at(ids, owner, mix(token, 3))
    return sizes, np.where(sizes > 0, mix(ids + sizes.astype(np.uint64), 4), U(0)).view(np.int64)
