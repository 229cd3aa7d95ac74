"""Problem 4: splits that keep related records together.

Entities and the links between them are contracted to components by Borůvka rounds: every component takes its minimum edge
to another one, the chosen edges hook components onto each other, pointer jumping flattens the trees, and edges are
relabelled and deduplicated. The number of components with edges at least halves per round. The chosen edges are a
spanning forest; labels and forest are written into the shared folder each round, so a lost executor costs one round. The
forest stays there: it is the evidence for every group, and tree_links() gives it out.

Components are then dealt to splits: those so large that they matter by themselves (heads, a share of all rows from which on
there cannot be many) go one by one to the split that lacks most; the rest, stratified by size band (powers of two), are
dealt systematically, the i-th of a band by the i-th point of a low-discrepancy sequence over the shares that the heads left
open.

Defined results
* NULL ends and self-loops are no links; repeated links and either direction mean the same; times play no part.
* Entities without links are components of their own. An empty entity table gives no rows.
* Ties between equal edge weights fall to the smaller pair of ids, so a run is deterministic.
* Shares that do not sum to 1 are normalised; NULL or negative ones count as 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import positions
from pulsegrid.session import discard, materialize

MAX_ROUNDS = 64
_GOLDEN = (math.sqrt(5) - 1) / 2


def contract(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, root of each name, places of the chosen edges): the Borůvka rounds of a list of edges in arrays.

    rank orders the edges and tells them all apart."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    live, chosen = np.arange(len(a)), []
    order = np.empty(len(a), np.int64)
    order[np.argsort(rank, kind="stable")] = np.arange(len(a))
    edge_of = np.argsort(order)
    while True:
        cx, cy = root[x[live]], root[y[live]]
        live, cx, cy = live[cx != cy], cx[cx != cy], cy[cx != cy]
        if not len(live):
            return names, root, np.unique(np.concatenate([*chosen, np.zeros(0, np.int64)]))
        least = np.full(len(names), len(a))
        np.minimum.at(least, cx, order[live])
        np.minimum.at(least, cy, order[live])
        comps = np.flatnonzero(least < len(a))
        edges = edge_of[least[comps]]
        chosen.append(np.unique(edges))
        far = np.where(root[x[edges]] == comps, root[y[edges]], root[x[edges]])
        up = np.arange(len(names))
        up[comps] = far
        mutual = comps[(up[far] == comps) & (comps < far)]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def spanning_forest(links: DataFrame, a: str, b: str, last_edges: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every linked node, root being the smallest id of its component, and the forest's edges (u, v).

    Rounds are jobs on the cluster until at most last_edges contracted edges are left; these take their rounds in one task.
    Either way an edge's weight is its hash, ties by its ids, so the forest is the same one."""
    spark = links.sparkSession
    u, v = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    edges = materialize(edges.select("u", "v", F.xxhash64("u", "v").alias("h"), F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    kind = dict(edges.dtypes)["u"]
    first, forest = edges, []
    for turn in range(MAX_ROUNDS):
        if edges.count() <= last_edges:  # of a written table: its footers
            break
        if not turn:
            nodes = materialize(nodes, "nodes")
        # the minimum edge of each component; a hash first keeps the hooked trees shallow, the ids break ties
        ends = F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("to")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("to")))).alias("e")
        least = (
            edges.select(F.struct("h", "u", "v").alias("w"), ends)
            .groupBy(F.col("e.c").alias("c"))
            .agg(F.min(F.struct("w", "e.to")).alias("m"))
            .select("c", F.col("m.to").alias("parent"), F.col("m.w.u").alias("u"), F.col("m.w.v").alias("v"))
        )
        least = materialize(least, "forest")
        forest.append(least)
        # two components that chose each other: the smaller becomes the root
        back = least.select(F.col("c").alias("p"), F.col("parent").alias("pp"))
        up = least.join(back, least["parent"] == back["p"], "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c")).otherwise(F.col("parent")).alias("parent"))
        spent = [nodes] if edges is first else [edges, nodes]
        for _ in range(MAX_ROUNDS):
            # every job goes four times as far up
            jumped = materialize(up, "hooks")
            spent.append(jumped)
            far = jumped.select("c", "parent", F.col("parent").alias("a0"))
            for k in range(3):
                over = jumped.select(F.col("c").alias(f"c{k}"), F.col("parent").alias(f"a{k + 1}"))
                far = far.join(over, far[f"a{k}"] == over[f"c{k}"])
            up = far.select("c", F.col("a3").alias("parent"), (F.col("a3") != F.col("parent")).alias("moved"))
            up = materialize(up, "jumps")
            spent.append(up)
            if up.where("moved").isEmpty():
                break
            up = up.select("c", "parent")
        up = up.select("c", "parent")
        nodes = materialize(nodes.join(up, nodes["root"] == up["c"], "left").select("node", F.coalesce("parent", "root").alias("root")), "nodes")
        left, right = up.select(F.col("c").alias("cu"), F.col("parent").alias("pu")), up.select(F.col("c").alias("cv"), F.col("parent").alias("pv"))
        edges = (
            edges.join(left, "cu")
            .join(right, "cv")
            .where("pu <> pv")
            .groupBy(F.least("pu", "pv").alias("cu"), F.greatest("pu", "pv").alias("cv"))
            .agg(F.min(F.struct("h", "u", "v")).alias("w"))
            .select("w.u", "w.v", "w.h", "cu", "cv")
        )
        edges = materialize(edges, "edges")
        discard(*spent)
    else:
        raise RuntimeError("the contraction did not end")

    def finish(batches):
        frames = [pdf for pdf in batches if len(pdf)]
        if frames:
            pdf = pd.concat(frames, ignore_index=True).sort_values(["h", "u", "v"], ignore_index=True)
            names, root, chosen = contract(pdf["cu"].to_numpy(), pdf["cv"].to_numpy(), np.arange(len(pdf)))
            yield pd.DataFrame({"is_edge": False, "x": names, "y": names[root]})
            yield pd.DataFrame({"is_edge": True, "x": pdf["u"].to_numpy()[chosen], "y": pdf["v"].to_numpy()[chosen]})

    last = materialize(edges.coalesce(1).mapInPandas(finish, f"is_edge boolean, x {kind}, y {kind}"), "forest")
    met = last.where("not is_edge").select(F.col("x").alias("__c"), F.col("y").alias("__r"))
    nodes = nodes.join(met, nodes["root"] == met["__c"], "left").select("node", F.coalesce("__r", "root").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("node").alias("least"))
    labelled = materialize(nodes.join(smallest, "root").select("node", F.col("least").alias("root")), "roots")
    discard(first, edges)
    trees = last.where("is_edge").select(F.col("x").alias("u"), F.col("y").alias("v"))
    for f in forest:
        trees = trees.unionByName(f.select("u", "v"))
    return labelled, trees.distinct() if forest else trees


def components(entities: DataFrame, entity: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """(entity, root): every entity with the smallest *listed* entity of its component, linked through unlisted ids too."""
    listed = entities.where(F.col(entity).isNotNull()).select(entity).distinct()
    nodes, _ = spanning_forest(links, a, b)
    met = listed.join(nodes, listed[entity] == nodes["node"], "left").select(entity, "root")
    names = met.where("root is not null").groupBy(F.col("root").alias("__r")).agg(F.min(entity).alias("__least"))
    return met.join(names, met["root"] == names["__r"], "left").select(entity, F.coalesce("__least", entity).alias("root"))


def tree_links(links: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v, root): the links of the spanning forest, one less than its members for each component."""
    nodes, trees = spanning_forest(links, a, b)
    return trees.join(nodes, trees["u"] == nodes["node"]).select("u", "v", "root")


def torn_groups(membership: DataFrame, root: str, split: str) -> DataFrame:
    """(root, splits) of each group that lies in more than one split."""
    return membership.groupBy(root).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def deal(sizes: DataFrame, root: str, size: str, targets: DataFrame, name: str, share: str, seed: int = 17) -> DataFrame:
    """(root, size, split): each component with its split. targets is a small table: (name, share), at most 100 rows (checked).

    A head holds at least a 64th of the smallest share and at least 1 / 100,000 of all rows, so there are at most 100,000."""
    spark = sizes.sparkSession
    goals = [(r[0], max(r[1] or 0.0, 0.0)) for r in targets.where(F.col(name).isNotNull()).groupBy(name).agg(F.max(share)).limit(101).orderBy(name).collect()]
    if len(goals) > 100:
        raise ValueError("more than 100 splits")
    total_share = sum(s for _, s in goals)
    if total_share <= 0:
        raise ValueError("targets need a positive share")
    goals = [(n, s / total_share) for n, s in goals]
    rows = sizes.where(F.col(root).isNotNull())
    total = rows.agg(F.sum(size)).first()[0] or 0
    least_head = total * max(min(s for _, s in goals if s > 0) / 64, 1e-5)
    heads = rows.where(F.col(size) >= max(least_head, 1)).orderBy(F.desc(size), root).select(root, size).collect()
    given = dict.fromkeys((n for n, _ in goals), 0)
    placed = []
    for r, n in heads:
        split = max(goals, key=lambda g: (g[1] * total - given[g[0]], g[1]))[0]
        given[split] += n
        placed.append((r, split))
    rest = total - sum(given.values())
    open_shares = [(n, max(s * total - given[n], 0.0)) for n, s in goals]
    weight = sum(s for _, s in open_shares) or 1.0
    open_shares = [(n, s / weight) for n, s in open_shares] if rest > 0 else goals
    types = dict(sizes.dtypes)
    heads_df = spark.createDataFrame(placed, f"__root {types[root]}, __head string")
    marked = rows.join(F.broadcast(heads_df), rows[root] == heads_df["__root"], "left").drop("__root")
    band = marked.withColumn("__band", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double"))).cast("int"))
    loose = band.where("__head is null")
    order = F.xxhash64(F.col(root), F.lit(seed))
    dealt = positions.with_position(loose, ["__band"], F.shiftrightunsigned(order, 54), [order, F.col(root)], "__i")
    point = F.pmod((F.col("__i") + 1) * F.lit(_GOLDEN) + F.col("__band") * F.lit(0.7548776662466927), F.lit(1.0))
    split: Column | None = None
    edge = 0.0
    for n, s in open_shares:
        edge += s
        split = F.when(point < edge, n) if split is None else split.when(point < edge, n)
    last = max(open_shares, key=lambda g: g[1])[0]
    tail = dealt.select(root, size, split.otherwise(last).alias("split"))
    return tail.unionByName(band.where("__head is not null").select(root, size, F.col("__head").alias("split")))
