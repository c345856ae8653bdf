import itertools
import random
import re

from quarryline.llm import decontamination as D


def test_masks_hit_every_window():
    for k in range(D.SUBSTITUTED + 1):
        for out in itertools.combinations(range(D.WINDOW), k):
            assert any(all(s + j not in out for j in m) for m in D.MASKS for s in range(D.WINDOW - m[-1]))


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def overlaps(a, b):
    for diagonal in range(-len(b) + 1, len(a)):
        lead = max(0, -diagonal)
        n = min(len(b) - lead, len(a) - diagonal - lead)
        same = [a[diagonal + lead + i] == b[lead + i] for i in range(n)]
        width = min(n, D.WINDOW)
        allowed = D.SUBSTITUTED if n >= D.WINDOW else n // D.LEAST
        if n >= D.LEAST and any(sum(same[i : i + width]) >= width - allowed for i in range(n - width + 1)):
            return True
    return False


def test_equals_every_alignment(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([8, 15, 20, 40])))) for i in range(25)] + [(98, None), (99, "")]
    rows = []
    for i in range(150):
        w = rng.choices(vocab, k=rng.choice([0, 5, 30, 100]))
        if rng.random() < 0.5:
            passage = rng.choice(items[:25])[1].split()[rng.randint(0, 3) :]
            for _ in range(rng.randint(0, 5)):
                passage[rng.randrange(len(passage))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    rows += [(1000, None), (1001, ""), (None, items[3][1] if len(items[3][1].split()) >= 13 else " ".join(items[3][1].split() * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.report(docs, bench).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = [j for j, x in items if overlaps(words(t), words(x))]
        # short alignments at a text's edge need a seed; whole windows never miss
        sure = [j for j, x in items if len(words(x)) >= D.WINDOW and overlaps(words(t), words(x))]
        mine = [int(x) for x in got[i].items.split(",") if x]
        assert set(mine) <= set(want) and (got[i].contaminated == bool(mine)) and got[i].n_items == len(mine)
        assert len(words(t)) < D.WINDOW or {j for j in sure if _full(words(t), words(dict(items)[j]))} <= set(mine)
    kept = {r.doc_id for r in D.decontaminate(docs, bench).collect()}
    assert kept == {i for i, r in got.items() if not r.contaminated}
    assert D.report(docs.where("false"), bench).count() == 0 and not any(r.contaminated for r in D.report(docs, bench.where("false")).collect())


def _full(a, b):
    """Some whole window agrees up to the substitutions; two of them leave four words in a row alone."""
    fours = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    return bool(fours(a) & fours(b)) and any(
        sum(x == y for x, y in zip(a[i : i + D.WINDOW], b[j : j + D.WINDOW])) >= D.WINDOW - D.SUBSTITUTED for i in range(len(a) - D.WINDOW + 1) for j in range(len(b) - D.WINDOW + 1)
    )


def holds(a, b):
    """Whether words a are contaminated by an item of words b, by trying every alignment."""
    width = min(len(b), D.WINDOW)
    allowed = D.SUBSTITUTED if width == D.WINDOW else width // D.LEAST
    for diagonal in range(-len(b) + 1, len(a)):
        lead = max(0, -diagonal)
        n = min(len(b) - lead, len(a) - diagonal - lead)
        same = [a[diagonal + lead + i] == b[lead + i] for i in range(n)]
        if n >= width > 0 and any(sum(same[i : i + width]) >= width - allowed for i in range(n - width + 1)) or D.LEAST <= n < width and all(same):
            return True
    return False


def test_equals_every_alignment_at_every_length(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9, 10, 11, 12, 13, 14, 20, 40])] + [(90, None), (91, ""), (None, "no id here but words that count in a row of their own")]
    rows = []
    for i in range(260):
        w = rng.choices(vocab, k=rng.choice([0, 1, 4, 12, 60]))
        passage = rng.choice(items[:18])[1].split()
        cut = rng.choice([0, 0, 0, rng.randint(0, 6)])
        passage = passage[cut:] if rng.random() < 0.5 else passage[: len(passage) - cut]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if passage:
                passage[rng.randrange(len(passage))] = rng.choice(vocab)
        at = rng.choice([0, len(w), rng.randrange(len(w) + 1)])
        w[at:at] = passage
        rows.append((i, " ".join(w)))
    rows += [(500, "no id here but words that count in a row of their own"), (501, "x " * 40000 + items[6][1] + " y" * 40000)]
    got = {r.doc_id: r for r in D.report(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, seed int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        assert [int(x) for x in got[i].items.split(",") if x] == [j for j, x in items if j is not None and holds(words(t), words(x))], (t[:300], got[i].items)
    assert got[500].contaminated and got[500].n_items == 0 and "6" in got[501].items.split(",")


def test_seeds_in_blocks_are_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(20))) for i in range(12)]
    rows = [(i, "a b c " + items[i % 12][1] + " d") for i in range(30)] + [(99, "nothing of it")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.report(docs, bench).collect()))
    monkeypatch.setattr(D, "MOST_BROADCAST", 100)
    assert sorted(map(tuple, D.report(docs, bench).collect())) == whole and sum(r[1] for r in whole) == 30
