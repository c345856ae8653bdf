"""Type-flow fixed points: which atoms reach a node, how surely, and by which path.

Roots give a node an atom with a confidence (1 to 3) and may be hypotheses; an edge passes atoms on with the
lesser confidence, and as a hypothesis if either is one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.graph import weak_components
from quarryline.operators.lineage import cut


def best_path(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """I5, order-free: (node, atom, confidence, hypothesis, depth).

    The best confidence over all paths; no hypothesis if some path of that confidence is none; the least length
    among those. Labels (confidence, hypothesis) are at most six per node and atom, so the loop over new labels ends.
    """
    step = cut(edges.select("src", "dst", F.col("confidence").alias("ec"), F.col("hypothesis").alias("eh")).distinct())
    known = fresh = cut(roots.select("node", "atom", "confidence", "hypothesis").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not fresh.isEmpty():
        depth += 1
        moved = fresh.join(step, fresh["node"] == step["src"]).select(F.col("dst").alias("node"), "atom", F.least("confidence", "ec").alias("confidence"), (F.col("hypothesis") | F.col("eh")).alias("hypothesis")).distinct()
        fresh = cut(moved.join(known, ["node", "atom", "confidence", "hypothesis"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.union(fresh)
    label = F.struct("confidence", (~F.col("hypothesis")).alias("sure"), (-F.col("depth")).alias("short"))
    best = known.groupBy("node", "atom").agg(F.max(label).alias("best"))
    return best.select("node", "atom", F.col("best.confidence").alias("confidence"), (~F.col("best.sure")).alias("hypothesis"), (-F.col("best.short")).alias("depth"))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Sweeps nodes, their edges and their atoms in sorted order until nothing improves."""
    roots, edges = rows[rows["edge"].isna()], rows[rows["edge"].notna()]
    state: dict = {}
    for r in roots.sort_values(["node", "atom", "confidence"]).itertuples():
        mine = (int(r.confidence), not r.hypothesis, 0, (), ())
        if mine > state.setdefault(r.node, {}).get(r.atom, (0,)):
            state[r.node][r.atom] = mine
    out = {n: list(g.sort_values(["dst", "edge"]).itertuples()) for n, g in edges.groupby("node")}
    nodes, sweeps, changed = sorted({*state, *out}), 0, True
    total = len(set(rows["node"]) | set(edges["dst"])) + 1
    while changed:
        sweeps, changed = sweeps + 1, False
        if sweeps > total:
            raise ValueError("no fixed point within nodes + 1 sweeps")
        for n in nodes:
            for e in out.get(n, ()):
                for atom in sorted(state.get(n, ())):
                    confidence, sure, _, _, path = state[n][atom]
                    if e.edge in path:
                        continue
                    longer = (*path, e.edge)
                    new = (min(confidence, int(e.confidence)), sure and not e.hypothesis, -len(longer), (), longer)
                    if new > state.setdefault(e.dst, {}).get(atom, (0,)):
                        state[e.dst][atom] = new
                        changed = True
    found = [(n, a, s[0], not s[1], ",".join(s[4]), sweeps) for n, atoms in state.items() for a, s in atoms.items()]
    return pd.DataFrame(found, columns=["node", "atom", "confidence", "hypothesis", "path", "sweeps"])


def best_path_parity(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """I5, in the fixed visiting order: (node, atom, confidence, hypothesis, path, sweeps).

    What ties keep depends on that order, so a weak component is swept as a whole; components never meet.
    edges has edge, a name for paths. A component has to fit one worker.
    """
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(roots.select(F.col("node").alias("a"), F.col("node").alias("b")))
    component = cut(weak_components(links)).withColumnRenamed("node", "member")
    nothing = lambda t: F.lit(None).cast(t)
    both = roots.select("node", "atom", "confidence", "hypothesis", nothing(edges.schema["dst"].dataType).alias("dst"), nothing("string").alias("edge")).unionByName(
        edges.select(F.col("src").alias("node"), nothing("string").alias("atom"), "confidence", "hypothesis", "dst", F.col("edge").cast("string").alias("edge"))
    )
    kind = roots.schema["node"].dataType.simpleString()
    return both.join(component, both["node"] == component["member"]).drop("member").groupBy("label").applyInPandas(_sweep, f"node {kind}, atom string, confidence int, hypothesis boolean, path string, sweeps int")
