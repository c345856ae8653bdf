import random
import re

from quarryline.llm import line_dedup


def words(line):
    return [w for w in re.split(r"[\x20\t\r\f\x0B]+", line.lower()) if w]


def near(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    lines = sorted((i, k, words(line)) for i, t in rows if t for k, line in enumerate(t.split("\n")))
    lines = [x for x in lines if len(x[2]) >= line_dedup.MIN_WORDS]
    return {(i, k) for n, (i, k, w) in enumerate(lines) if any((j, m) < (i, k) and near(v, w) for j, m, v in lines[:n])}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the"]
    pool, rows = [], []
    for i in range(n):
        out = []
        for _ in range(rng.randint(1, 7)):
            if pool and rng.random() < 0.6:
                w = list(rng.choice(pool))
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.choice([0, 1])] = rng.choices(vocab, k=rng.choice([0, 1]))
            else:
                w = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60]))
            pool.append(w)
            out.append(rng.choice([" ", "  "]).join(w))
        rows.append((rng.randrange(10**6) * 1000 + i, "\n".join(out)))
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(1, 160) + [(5, None), (6, ""), (7, "\n\n"), (8, "A b c d e\r\na B c d e\na b c x e\na b c d\nb c d e\na b c d e f"), (9, "z " * 3000 + "\n" + "z " * 2999 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in line_dedup.repeated_lines(docs).collect()} == brute(rows)


def test_texts_reports_and_edges(spark):
    rows = [(1, "one two three four five\nshort", "x"), (2, "one two three four six", "y"), (3, "keep me as I am here\none two three four five\n\nshort", "z"), (4, None, "n"), (5, "", "e"), (None, "one two three four five\nown", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.text, r.fp) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (rows[0][1], "x"), 3: ("keep me as I am here\n\nshort", "z"), 4: (None, "n"), 5: ("", "e"), None: ("own", "q")}
    told = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.report(docs).collect()}
    assert told[3] == (4, 1, "1") and told[2] == (1, 1, "0") and told[4] == (0, 0, "") and len(told) == 6
    assert line_dedup.report(docs.where("false")).count() == 0


def test_exact_repeats_of_any_length(spark):
    rows = corpus(3, 120) + [(1, "All rights\nreserved.\nAll  Rights\n\n \na b c d"), (2, "reserved.\na b c x\na b c d\nb c d"), (3, "\n\n"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    each = sorted((i, k, words(line)) for i, t in rows if t for k, line in enumerate(t.split("\n")))
    equal = {(i, k) for n, (i, k, w) in enumerate(each) if w and any(v == w for _, _, v in each[:n])}
    assert {(1, 2), (2, 0), (2, 2)} <= equal
    assert {tuple(r) for r in line_dedup.repeated_lines(docs, short=True).collect()} == brute(rows) | equal
    told = {r.doc_id: r.removed for r in line_dedup.report(docs, short=True).collect()}
    assert told[1] == "2" and told[2] == "0,2" and told[3] == told[4] == ""


def test_the_query_takes_short_repeats(spark):
    from quarryline.llm import queries
    from quarryline.tables import table

    small, seen, want = "/root/testdata/sf0.001", set(), set()
    for r in sorted(table(spark, small, "documents").collect(), key=lambda r: r.doc_id):
        for k, line in enumerate((r.text or "").split("\n")):
            w = tuple(words(line))
            if 0 < len(w) < line_dedup.MIN_WORDS and w in seen:
                want.add((r.doc_id, k))
            seen.add(w)
    got = {(r.doc_id, int(k)) for r in queries.op4_line_dedup(spark, small).collect() for k in r.removed.split(",") if k}
    assert want and want <= got
