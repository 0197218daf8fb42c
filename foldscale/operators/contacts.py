"""Contact graphs as edge tables, and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldscale.operators.spatial import map_blocks, self_pairs
from foldscale.shared import joined
from foldscale.sources.canonical import residues

# Which kind an edge keeps; ties go to the shorter distance.
PRIORITY = {
    "disulfide": 7, "salt_bridge": 6, "hydrogen_bond": 5, "cation_pi": 4, "pi_pi_parallel": 3,
    "pi_pi_perpendicular": 3, "hydrophobic": 2, "distance_contact": 1, "interface_contact": 1,
}
_EDGE = ["structure_id", "a", "b", "distance", "kind"]


def priority(kind):
    out = F.when(kind == "covalent_adjacency", 100)
    for k, v in PRIORITY.items():
        out = out.when(kind == k, v)
    return out.otherwise(0)


def _best(edges: DataFrame) -> DataFrame:
    """One edge per pair: the greatest priority, then the shortest distance."""
    best = F.min(F.struct((-priority(F.col("kind"))).alias("p"), "distance", "kind")).alias("e")
    return edges.groupBy("structure_id", "a", "b").agg(best).select("structure_id", "a", "b", "e.distance", "e.kind")


def _typed(atoms: DataFrame, found: DataFrame, ring_edges: bool) -> DataFrame:
    """Interactions as residue edges. Ring interactions name a pseudo atom and are left out unless asked for."""
    if not ring_edges:
        found = found.where(~F.col("kind").isin("cation_pi", "pi_pi_parallel", "pi_pi_perpendicular"))
    return (
        found.where("res_a != res_b")
        .select("structure_id", F.least("res_a", "res_b").alias("a"), F.greatest("res_a", "res_b").alias("b"), "distance", "kind")
    )


def residue_graph(atoms: DataFrame, cutoff: float = 8.0, interactions: DataFrame | None = None, ring_edges: bool = False, grid: bool | None = None) -> DataFrame:
    """Edges (a < b, residue ordinals): covalent neighbours, then centroid contacts, then typed interactions."""
    r = residues(atoms)
    by = Window.partitionBy("structure_id", "chain_index").orderBy("residue_index")
    nxt = lambda c: F.lead(c).over(by)
    d = [F.col(c) - nxt(c) for c in ("x", "y", "z")]
    chain = (
        r.select(
            "structure_id", F.col("res_ord").alias("a"), nxt("res_ord").alias("b"),
            F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"),
            F.abs(nxt("seq_number") - F.col("seq_number")).alias("step"), F.lit("covalent_adjacency").alias("kind"),
        )
        .where("step = 1")
        .select(*_EDGE)
    )
    near = self_pairs(r.select("structure_id", "res_ord", "x", "y", "z"), cutoff, "res_ord", grid).select(
        "structure_id", F.col("res_ord_a").alias("a"), F.col("res_ord_b").alias("b"), "distance",
        F.lit("distance_contact").alias("kind"),
    )
    edges = chain.unionByName(near)
    if interactions is not None:
        edges = edges.unionByName(_typed(atoms, interactions, ring_edges))
    return _best(edges)


def interface_graph(atoms: DataFrame, cutoff: float = 8.0, interactions: DataFrame | None = None, ring_edges: bool = False, grid: bool | None = None) -> DataFrame:
    """Edges between residues of different chains within ``cutoff`` of each other's centroid."""
    r = residues(atoms).select("structure_id", "res_ord", "chain_index", "x", "y", "z")
    edges = (
        self_pairs(r, cutoff, "res_ord", grid)
        .where("chain_index_a != chain_index_b")
        .select("structure_id", F.col("res_ord_a").alias("a"), F.col("res_ord_b").alias("b"), "distance", F.lit("interface_contact").alias("kind"))
    )
    if interactions is not None:
        chains = residues(atoms).select("structure_id", "res_ord", "chain_index")
        typed = _typed(atoms, interactions, ring_edges)
        for side in ("a", "b"):
            typed = joined(typed, chains.select("structure_id", F.col("res_ord").alias(side), F.col("chain_index").alias(f"chain_{side}")), ["structure_id", side])
        edges = edges.unionByName(typed.where("chain_a != chain_b").select(*_EDGE))
    return _best(edges)


def atom_graph(atoms: DataFrame, cutoff: float = 5.0, grid: bool | None = None) -> DataFrame:
    points = atoms.select("structure_id", "atom_ord", "x", "y", "z")
    return self_pairs(points, cutoff, "atom_ord", grid).select(
        "structure_id", F.col("atom_ord_a").alias("a"), F.col("atom_ord_b").alias("b"), "distance",
        F.lit("distance_contact").alias("kind"),
    )


def _statistics(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    """Graphs of many structures at once. Rows are nodes (``b`` null) and edges."""
    a, b = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(float)
    is_node = np.isnan(b)
    nodes = np.lexsort((a[is_node], group[is_node]))  # numbered in the order of structures and nodes
    g, width = group[is_node][nodes], int(a.max()) + 1
    keys = g * width + a[is_node][nodes]
    e = group[~is_node]
    left = np.searchsorted(keys, e * width + a[~is_node])
    right = np.searchsorted(keys, e * width + b[~is_node].astype(np.int64))
    n, count = len(keys), int(group[-1]) + 1
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    # triangles: edges point to the node of greater (degree, number); pairs of a node's arrows that an edge closes
    turn = (degree[left] > degree[right]) | ((degree[left] == degree[right]) & (left > right))
    low, high = np.where(turn, right, left), np.where(turn, left, right)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    edge, ends = low * n + high, np.searchsorted(low, low, "right")
    later, triangles = ends - np.arange(len(low)) - 1, np.zeros(n, np.int64)
    for s in range(0, len(low), 4096):
        m = later[s : s + 4096]
        p = np.repeat(np.arange(s, s + len(m)), m)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        x, y = np.minimum(high[p], high[q]), np.maximum(high[p], high[q])
        closed = np.zeros(len(p), bool)
        for want in (x * n + y, y * n + x):
            at = np.minimum(np.searchsorted(edge, want), max(len(edge) - 1, 0))
            closed |= edge[at] == want
        for c in (low[p], x, y):
            triangles += np.bincount(c[closed], minlength=n)
    label = np.arange(n)
    while len(left):  # the smallest node reachable, by minima over edges and jumps
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    pairs = degree * (degree - 1) / 2
    local = np.where(degree >= 2, triangles / np.maximum(pairs, 1), 0.0)
    size, edges = np.bincount(g, minlength=count), np.bincount(e, minlength=count)
    starts = np.searchsorted(g, np.arange(count + 1))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    out = pd.DataFrame({
        "structure_id": pdf["structure_id"].to_numpy()[first], "contact_count": edges,
        "graph_density": np.where(size < 2, 0.0, edges / np.maximum(size * (size - 1) / 2, 1)),
        "clustering_coefficient": np.bincount(g, weights=local, minlength=count) / np.maximum(size, 1),
        "connected_components": np.bincount(g[label == np.arange(n)], minlength=count),
        "degree_distribution": [degree[x:y].tolist() for x, y in zip(starts, starts[1:], strict=False)],
    })
    return out[size > 0]


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, density, mean local clustering (nodes with fewer than two neighbours count as 0), components and the degree
    of every node in order, from ``nodes(structure_id, node)`` and one edge per pair; a group is one structure's graph."""
    rows = nodes.select("structure_id", F.col("node").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(edges.select("structure_id", "a", "b"))
    ddl = "structure_id string, contact_count long, graph_density double, clustering_coefficient double, connected_components long, degree_distribution array<long>"
    return map_blocks(rows, ["structure_id"], _statistics, ddl)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of components per structure."""
    return graph_statistics(nodes, edges).select("structure_id", "connected_components")
