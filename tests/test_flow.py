from quarryline.operators import flow
from quarryline.plans.graphs import flow_inputs


def test_fixed_order_and_order_free_agree_where_they_must(spark):
    roots, edges = flow_inputs(spark, "/root/testdata/sf0.001")
    free = {(r.node, r.atom): r for r in flow.best_path(roots, edges).collect()}
    fixed = {(r.node, r.atom): r for r in flow.best_path_parity(roots, edges).collect()}
    assert free and free.keys() == fixed.keys() and all(free[k].confidence == fixed[k].confidence for k in free)
    assert all(not free[k].hypothesis or fixed[k].hypothesis for k in free)


def test_small_flow(spark):
    roots = spark.createDataFrame([(1, "x", 3, False), (1, "y", 2, True)], "node int, atom string, confidence int, hypothesis boolean")
    edges = spark.createDataFrame([(1, 2, 3, False, "a"), (2, 3, 1, False, "b"), (1, 3, 1, True, "c"), (3, 1, 3, False, "d")], "src int, dst int, confidence int, hypothesis boolean, edge string")
    got = {(r.node, r.atom): (r.confidence, r.hypothesis, r.depth) for r in flow.best_path(roots, edges).collect()}
    assert got == {(1, "x"): (3, False, 0), (2, "x"): (3, False, 1), (3, "x"): (1, False, 2), (1, "y"): (2, True, 0), (2, "y"): (2, True, 1), (3, "y"): (1, True, 1)}
    path = {(r.node, r.atom): r.path for r in flow.best_path_parity(roots, edges).collect()}
    assert path[3, "x"] == "a,b" and path[3, "y"] == "c" and path[1, "x"] == ""


def test_purchase_components_are_what_union_and_find_gives(spark):
    from quarryline.plans import graphs

    small = "/root/testdata/sf0.001"
    links = [tuple(r) for r in graphs.purchase_edges(spark, small).collect()]
    up = {n: n for e in links for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert links and {r.node: r.label for r in graphs.purchase_components(spark, small).collect()} == {n: find(n) for n in up}
