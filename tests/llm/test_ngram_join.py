import random
import re

from quarryline.llm.components import connect
from quarryline.llm.ngram_join import ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "the"]
    passage = rng.choices(vocab, k=60)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1, 2])] = rng.choices(vocab, k=rng.choice([0, 1, 1]))
        else:
            w = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200]))
            if rng.random() < 0.4:
                w += passage
        rows.append((1000 - i, " ".join(w)))
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(3, 250)
    rows += [(2000, None), (2001, " \n"), (2002, "The  W1\tw2"), (2003, "the w1 w2"), (2003, "the w1 w2"), (2004, "x " * 30000)]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(99)}" for w in base)) for i in range(150)]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_and_chain(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string, set_id int")).count() == 0
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r.node: r.label for r in connect(links).collect()} == {i: 0 for i in range(41)} | {100: 99, 99: 99}
