import numpy as np
import pyarrow as pa

from quarryline.llm import bpe, hashing, workers


def test_words_hash_alike_wherever_they_stand():
    words = ["alpha", "Bé", "x" * 200_000, "q", "alpha"]
    alone = [int(hashing.words([w.encode()])[0][0]) for w in words]
    long = "pad " * 40_000 + " ".join(words) + " pad" * 30_000
    h, doc, starts, ends = hashing.words([b"", long.encode(), b"ALPHA"])
    assert h[40_000 : 40_000 + len(words)].tolist() == alone and alone[0] == alone[4] == int(h[-1])
    assert doc[0] == 1 and doc[-1] == 2 and (ends > starts).all() and len(set(alone)) == 4


def test_runs_are_small_and_whole():
    texts = ["a" * 10, None, "b" * 700, "", "c" * 5] * 200
    got = [(at, run) for at, run in workers.runs(pa.array(texts, pa.string()), 600)]
    assert [t for _, run in got for t in run] == [t or "" for t in texts]
    assert all(len(run) == 1 or sum(map(len, run)) <= 600 for _, run in got) and [at for at, _ in got] == np.cumsum([0, *(len(run) for _, run in got[:-1])]).tolist()
    assert list(workers.runs(pa.array([], pa.binary()))) == []


def test_memory_is_given_back_after_errors_too(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))

    def broken(batches):
        yield from batches
        raise ValueError("x")

    for run in (lambda b: iter(b), broken):
        try:
            assert list(workers.released(run)(iter([1, 2]))) == [1, 2]
        except ValueError:
            pass
    assert calls == [1, 1]


def test_alphabet_names_each_byte_once():
    found = bpe.byte_alphabet()
    assert len(set(found)) == 256 and found[ord("a")] == "a" and found[32] == chr(0x120) and all(len(c) == 1 for c in found)
