import random
from collections import defaultdict, deque

from quarryline.operators import matching, slices


def test_parameters_choose_in_order(spark):
    rng = random.Random(3)
    parameters, types = [], []
    for f in range(60):
        parameters += [(f, p, rng.choice("abcdx")) for p in range(rng.randint(0, 5))]
        types += [(f, f"t{f}_{i}", rng.choice("abcde"), rng.choice([None, None, 0, 1, 2, 7])) for i in range(rng.randint(0, 6))]
    got = matching.match_parameters(spark.createDataFrame(parameters, "f int, position int, name string"), spark.createDataFrame(types, "f int, type_id string, name string, position int"), "f").collect()
    want = {}
    for f in range(60):
        free = sorted((t for t in types if t[0] == f), key=lambda t: (1 << 40 if t[3] is None else t[3], t[1]))
        for _, p, name in (x for x in parameters if x[0] == f):
            loose = [t for t in free if t[3] is None]
            tries = [t for t in free if t[2] == name][:1] or [t for t in free if t[3] == p][:1] or loose[p : p + 1]
            want[f, p] = tries[0][1] if tries else None
            free = [t for t in free if t not in tries]
    assert {(r.f, r.position): r.type_id for r in got} == want


def queue_slice(roots, edges, external, depth_cap, functions, most):
    """The same, edge by edge."""
    rank = {"exact": 2, "candidate_set": 1}
    depth, weak, via, traced, why = {r: 0 for r in roots}, {r: 2 for r in roots}, defaultdict(set), [], set()
    todo = deque(sorted(roots))
    while todo:
        caller = todo.popleft()
        for e in sorted((e for e in edges if e[1] == caller), key=lambda e: (e[2], e[3], e[4] or "", e[0])):
            if len(traced) >= most:
                why.add("edge_limit")
                continue
            traced.append(e[0])
            target, r = e[4], rank.get(e[5], 0)
            if not target or not r:
                continue
            if depth[caller] >= depth_cap:
                why.add("depth_limit")
                continue
            path = min(weak[caller], r)
            if target not in depth:
                if len(depth) >= functions:
                    why.add("function_limit")
                    continue
                depth[target], weak[target] = depth[caller] + 1, path
                via[target].add(e[0])
                if target not in external:
                    todo.append(target)
            elif depth[target] == depth[caller] + 1:
                weak[target] = min(weak[target], path)
                via[target].add(e[0])
    return depth, weak, via, traced, why


def test_slices_are_what_a_queue_finds(spark):
    rng = random.Random(8)
    nodes = [f"n{i}" for i in range(40)]
    edges = []
    for i in range(170):
        a, b = rng.choice(nodes), rng.choice([*nodes, None])
        edges.append((f"e{i}", a, rng.randrange(20), rng.choice(["direct", "dynamic"]), b, rng.choice(["exact", "exact", "candidate_set", "unresolved"])))
    external = set(rng.sample(nodes, 6))
    triggers = {f"t{i}": set(rng.sample(nodes, rng.choice([1, 1, 2]))) for i in range(14)}
    asked = spark.createDataFrame([(t, n) for t, ns in triggers.items() for n in ns], "trigger string, node string")
    given = spark.createDataFrame(edges, "edge string, caller string, site int, kind string, target string, classification string")
    for depth, functions, most in ((3, 9, 14), (2, 100, 100)):
        nodes_, traced, flags = slices.call_slices(asked, given, spark.createDataFrame([(x,) for x in external], "node string"), depth, functions, most)
        got, edges_got, why = defaultdict(dict), defaultdict(set), {r.trigger: r.reasons for r in flags.collect()}
        for r in nodes_.collect():
            got[r.trigger][r.node] = (r.depth, r.classification, tuple(r.via))
        for r in traced.collect():
            edges_got[r.trigger].add(r.edge)
        for t, roots in triggers.items():
            d, w, via, e, reasons = queue_slice(roots, edges, external, depth, functions, most)
            assert got[t] == {n: (d[n], ["unresolved", "candidate_set", "exact"][w[n]], tuple(sorted(via[n]))) for n in d}
            assert edges_got[t] == set(e) and why.get(t, "") == ",".join(sorted(reasons))


def test_caps_that_raise(spark):
    import pytest

    assert slices.within(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(ValueError, match="more than 4"):
        slices.within(spark.range(5), 4, "rows")
