import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import packing


def check(plan, histogram):
    slots = defaultdict(list)
    for length, rank, number, first, offset in plan.runs:
        for j in range(number):
            slots[first + j].append((offset, length))
    for used in slots.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end
            end += length
        assert end <= plan.capacity
    ranks = defaultdict(list)
    for length, rank, number, *_ in plan.runs:
        ranks[length] += range(rank, rank + number)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    return len(slots)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_every_piece_has_one_place(histogram):
    check(packing.plan(histogram, 64, 8), histogram)


def test_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 4097, 4000), np.minimum(4096, rng.exponential(900, 12000).astype(int) + 1), np.full(3000, 1366)])
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    used = check(packing.plan(histogram), histogram)
    assert used <= 1.01 * -(-int(lengths.sum()) // 4096) + 2


TEXTS = [None, "", "Hello  world's\n\nIT'S 123!?", "ÉÀ naïve é x́ ́y", "<|endoftext|> a<|startoftext|>b", "tab\there\r\nnbsp x y 　z", "word " * 9000, "\U0001f600 ok"]


def test_pieces_and_places(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["alpha", "be", "Gamma", "delta-x"], k=rng.randint(1, 900))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, TEXTS[3]), (None, "none")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            want.append((i, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for used in by.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= 1.05 * sum(r.length for r in got) / 4096 + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, rank int")).count() == 0


def test_letters_that_become_a_letter_and_a_mark():
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    whole = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    letters = [chr(c) for c in range(128, 0x30000) if chr(c).isalpha()]
    texts = ["CUMHUR\u0130YET\u0130.", "b\u0130 and \u0958!? \u09dc, x", *(f"a{x}. {x}) {x} word" for x in letters)]
    assert packing.Words(path).ids(texts) == [whole(x) for x in texts]


def test_ids_of_random_texts_are_the_tokenizers():
    from tokenizers import Tokenizer

    path, rng = packing.default_tokenizer(), random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x2FFF) if chr(c).isalpha()] + [chr(c) for c in (0x130, 0x1E9E, 0x3A3, 0x149, 0x1C5, 0x345)] * 50
    usual = "abcdeÉÈüñßİAZ'.!,0 9Σσé̇Ａ"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.3 else rng.choice(usual) for _ in range(rng.randint(1, 12))) for _ in range(20000)]
    texts += ["word " * 300_000 + "İ. end", "a\tbc " * 250_000 + "d" * 1_100_000 + " e"]
    texts += ["a" * n for n in range(1, 40)] + ["zz" * 3000, "ab" * 2000 + ".", "<|endoftext|> A", "X<|endoftext|>"]
    words = packing.Words(path)
    got = [b for i in range(0, len(texts), 500) for b in words.ids(texts[i : i + 500])]
    plain = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in plain]
