import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from quarryline.functions import ids, lattice, text
from quarryline.operators import aggs, graph, joins, pack, ranking, windows


def test_window_counts_follow_the_golden_cases(spark):
    """Sites with none, one and several distinct references; a reference after the last site is never used."""
    rows = [(1, 1, "r", "a"), (1, 2, "s", None), (1, 3, "s", None), (1, 4, "r", "b"), (1, 5, "r", "c"), (1, 6, "r", "c"), (1, 7, "s", None), (1, 8, "r", "z"), (2, 1, "r", "q")]
    df = spark.createDataFrame([(o, t, k, v, o * 100 + t) for o, t, k, v in rows], "owner int, t int, kind string, v string, id int")
    got = windows.resolve_in_window(df, "owner", ["t"], F.col("kind") == "s", F.col("kind") == "r", "v", "id").collect()
    assert {r.id: (r.n_candidates, r.status) for r in got} == {102: (1, "exact"), 103: (0, "unresolved"), 107: (2, "candidate_set")}


def test_the_two_meets_differ(spark):
    df = spark.createDataFrame([(1, "exact"), (1, "?"), (2, "exact"), (2, "unresolved"), (3, None)], "k int, c string")
    got = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(lattice.meet_lenient(F.col("c")).alias("a"), lattice.meet_strict(F.col("c")).alias("b")).collect()}
    assert got == {1: ("exact", "unresolved"), 2: ("unresolved", "unresolved"), 3: ("exact", "unresolved")}


def test_guarded_zip_needs_equal_counts(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "g int, x int")
    b = spark.createDataFrame([(1, 5), (1, 4), (2, 7), (2, 8)], "g int, y int")
    assert sorted(map(tuple, joins.guarded_zip(a, b, ["g"], ["x"], ["y"], ["y"]).select("x", "y").collect())) == [(10, 4), (11, 5), (20, None)]


def test_consume_once_keeps_leftovers(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "g int, x int")
    b = spark.createDataFrame([(1, 9), (3, 8)], "g int, y int")
    got = joins.consume_once(a, b, ["g"], ["x"], ["y"], ["y"]).select("x", "y", "side").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 9, "both"), (2, None, "left"), (3, None, "left"), (None, 8, "right")]))


def test_as_of_and_cascade(spark):
    sites = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    facts = spark.createDataFrame([(1, 2, 7), (1, 5, 8), (1, 5, 6), (2, 4, 9)], "k int, t int, v int")
    assert sorted(map(str, map(tuple, joins.as_of(sites, facts, "k", "t", "v").select("k", "t", "found").collect()))) == sorted(map(str, [(1, 1, None), (1, 5, 8), (2, 3, None)]))
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    tries = [spark.createDataFrame(x, "k int, candidate int") for x in ([(1, 10)], [(1, 11), (2, 20), (2, 21)])]
    assert sorted(map(str, map(tuple, joins.cascade(keys, tries, "k").select("k", "candidate", "level").collect()))) == sorted(map(str, [(1, 10, 0), (2, 20, 1), (2, 21, 1), (3, None, None)]))


def random_graph(seed, n=25, m=45):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = set()
    for s in list(out):
        todo = deque(out[s])
        while todo:
            x = todo.popleft()
            if (s, x) not in found:
                found.add((s, x))
                todo.extend(out.get(x, ()))
    return found


def test_graphs_against_plain_loops(spark):
    pairs = random_graph(1)
    edges = spark.createDataFrame(pairs, "a int, b int")
    want = reach(pairs)
    assert {tuple(r) for r in graph.closure(edges).collect()} == want
    cyclic = {r.node: (r.component, r.size) for r in graph.cyclic_components(edges).collect()}
    groups = {x: {y for y in range(25) if (x, y) in want and (y, x) in want} for x in range(25)}
    assert cyclic == {x: (min(g), len(g)) for x, g in groups.items() if g}
    both = reach(pairs + [(b, a) for a, b in pairs])
    nodes = {x for p in pairs for x in p}
    assert {r.node: r.label for r in graph.weak_components(edges).collect()} == {x: min(y for y in nodes if y == x or (x, y) in both) for x in nodes}
    widest = {(r.a, r.b): r.confidence for r in graph.widest_path(edges.withColumn("confidence", (F.col("a") + F.col("b")) % 3)).collect()}
    strong = {c: reach([(a, b) for a, b in pairs if (a + b) % 3 >= c]) for c in (0, 1, 2)}
    assert widest == {p: max(c for c in (0, 1, 2) if p in strong[c]) for p in want}


def test_slices_and_ancestors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6)], "a int, b int")
    got = graph.bounded_slice(edges, spark.createDataFrame([(1,)], "trigger int"), 4).collect()
    assert {(r.node, r.depth) for r in got} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    found = graph.first_definition(df([("x",), ("y",), ("z",), ("c",)], "node"), df([("x", "y"), ("y", "z"), ("c", "d"), ("d", "c")], "node parent"), df([("z",)], "node")).collect()
    assert {r.node: (r.definer, r.depth) for r in found} == {"x": ("z", 2), "y": ("z", 1), "z": ("z", 0), "c": (None, None)}


def test_global_rank_and_packing(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame([(s, int(s == "b"), i, n) for s, i, n in rows], "scope string, phase int, id int, n int")
    got = ranking.global_rank(df, "scope", "phase", ["n", "id"], parts=7).collect()
    order = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    assert {r.id: r["rank"] for r in got} == {r[1]: k + 1 for k, r in enumerate(order)}
    packets = defaultdict(list)
    for r in pack.next_fit(df, "scope", ["id"], "n", 6, 100).orderBy("scope", "id").collect():
        packets[r.scope, r.packet].append(r.n)
    assert all(len(p) <= 6 and (sum(p) <= 100 or len(p) == 1) for p in packets.values())
    for (s, k), p in packets.items():
        following = packets.get((s, k + 1))
        assert following is None or len(p) == 6 or sum(p) + following[0] > 100


def test_identifiers_and_texts(spark):
    row = spark.createDataFrame([("9 a--b__c!", 4097, "f(a, g('x,)', [1,2]), \"q\") + h(", "((const char *) (int) x)", 0x00010203)], "s string, n long, c string, e string, v int").select(
        ids.symbol_fragment(F.col("s")).alias("f"), ids.address(ids.clear_low_bit(F.col("n"))).alias("a"), text.calls("c").alias("calls"), ids.stable_id("k", F.lit(None).cast("int")).alias("i"), text.version_of(F.col("v")).alias("v"),
        text.bounded(F.col("s"), 3).alias("b"), text.is_new_family(F.lit("newThing:")).alias("n"),
    ).first()
    assert row.f == "n_9_a_b_c" and row.a == "0x00001000" and row.i.startswith("k:") and len(row.i) == 22 and row.v == "1.2.3" and row.b.startswith("9 a...") and row.n
    assert [(c.name, c.arguments) for c in row.calls] == [("f", ["a", "g('x,)', [1,2])", '"q"']), ("g", ["'x,)'", "[1,2]"])]
    assert text.split_arguments("") == [] and text.split_arguments("a,") == ["a", ""]


def test_bounded_lists(spark):
    df = spark.createDataFrame([(1, i % 5) for i in range(20)] + [(2, 9)], "k int, v int")
    assert {r.k: (r.ids, r.overflow) for r in aggs.top_k_overflow(df, "k", "v", 3).collect()} == {1: ("0,1,2", 2), 2: ("9", 0)}
    assert {r.c: r.n for r in aggs.zero_filled(spark.createDataFrame([("x",)], "c string"), "c", ["x", "y"]).collect()} == {"x": 1, "y": 0}
