import numpy as np

from quarryline.llm.ngram_join import may_link, sketches


def sketch(tokens):
    tokens = np.sort(np.array(sorted(tokens), np.uint64))
    return sketches(np.zeros(len(tokens), np.int64), tokens, np.array([len(tokens)]))[0]


def test_sketches_are_small_and_lose_no_link():
    """A quarter of a byte a segment; linking pairs always pass, large sets that share less than 0.45 do not."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7, 9, 40, 130, 500, 1000, 1025, 3000):
        for _ in range(30):
            a = set(rng.integers(0, 1 << 63, n).tolist())
            gone = int(rng.integers(0, n + 1))
            b = set(sorted(a)[gone:]) | set(rng.integers(0, 1 << 63, int(rng.integers(0, n + 1))).tolist())
            if not b:
                continue
            x, y = sketch(a), sketch(b)
            assert len(x) == max(1, (1 << (n.bit_length() - 1)) // 4)
            links = 100 * len(a & b) >= 80 * len(a | b)
            assert may_link(len(a), len(b), x, y) or not links
            if n >= 500 and 100 * len(a & b) < 45 * len(a | b):
                assert not may_link(len(a), len(b), x, y)
