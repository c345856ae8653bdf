import hashlib

from quarryline.llm.exact_dedup import exact_dedup


def test_groups_ties_and_nulls(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "Äbc"), (4, "äbc"), (5, None), (6, ""), (7, "x" * 50000), (7, "x" * 50000), (None, "abc"), (None, "only")]
    rows += [(100 + i, "HOT text" if i % 3 else "hot Text") for i in range(200)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    for r in got:
        texts = {low(t) for i, t in rows if i == r.doc_id and hashlib.sha256(low(t).encode()).hexdigest() == r.text_sha256}
        same = [i for i, t in rows if low(t) in texts]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
    for key in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == key) == 1


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string, norm string, sha int")).count() == 0
