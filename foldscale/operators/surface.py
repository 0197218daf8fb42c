"""Solvent-accessible surface by rolling-sphere points (Shrake and Rupley), and shape complementarity of interfaces.

The point test is a NumPy kernel: atoms times 92 points times neighbours never become rows. A kernel works on runs of
cubes of space with their surroundings (``spatial.cubes``), many small structures or a piece of a large one at a time,
so memory is bounded and one structure spreads over tasks. One pass over the neighbours tells the points that are open
in the whole structure, in the atom's chain alone, and among heavy atoms, as bit sets of 92.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.functions.geometry import sphere_points
from foldscale.operators.spatial import cubes, map_blocks, neighbours
from foldscale.shared import joined

PROBE = 1.4
POINTS = np.array(sphere_points(92))
_ALL = np.packbits(np.ones((1, len(POINTS)), bool), axis=1, bitorder="little")
REACH = 2 * (max(chem.VDW_RADII.values()) + PROBE)


def covered(xyz: np.ndarray, radius: np.ndarray, group: np.ndarray, own: np.ndarray, tests: list, pairs: int = 16_384) -> list[np.ndarray]:
    """For each of ``tests`` (of atom and neighbour numbers) the points of ``own`` atoms inside a neighbour that passes, as
    packed bits (atoms x 12)."""
    out = [np.zeros((len(xyz), _ALL.shape[1]), np.uint8) for _ in tests]
    if not len(xyz):
        return out
    for here, i, j, d, square in neighbours(xyz, 2 * float(radius.max()), group, own):
        i = here[i]
        touch = np.flatnonzero(square < (radius[i] + radius[j]) ** 2)
        for a in range(0, len(touch), pairs):
            at = touch[a : a + pairs]
            p, q, r = i[at], j[at], radius[i[at]]
            # |x + r u - y|^2 - s^2 with d = x - y, for all points u at once
            rest = (d[at] @ POINTS.T) * (2 * r)[:, None] + (square[at] + r * r - radius[q] ** 2)[:, None]
            inside = rest <= 0
            k, u = np.nonzero(np.abs(rest) < 1e-9)  # too close to tell by this formula
            if len(k):
                e = xyz[p[k]] + POINTS[u] * r[k][:, None] - xyz[q[k]]
                inside[k, u] = (e * e).sum(axis=1) <= radius[q[k]] ** 2
            bits = np.packbits(inside, axis=1, bitorder="little")
            for total, test in zip(out, tests, strict=True):
                some = np.flatnonzero(test(p, q))
                if len(some):
                    first = np.flatnonzero(np.concatenate(([True], p[some][1:] != p[some][:-1])))
                    total[p[some][first]] |= np.bitwise_or.reduceat(bits[some], first, axis=0)
    return out


def _areas(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    xyz, r, own = pdf[["x", "y", "z"]].to_numpy(float), pdf["radius"].to_numpy(float), pdf["own"].to_numpy(bool)
    chain, heavy = pdf["chain_index"].to_numpy(), pdf["heavy"].to_numpy(bool)
    tests = [lambda i, j: np.ones(len(i), bool), lambda i, j: chain[i] == chain[j], lambda i, j: heavy[i] & heavy[j]]
    whole, alone, among = (~c[own] & _ALL for c in covered(xyz, r, group, own, tests))
    unit, mine = 4 * np.pi * r[own] * r[own] / len(POINTS), pdf[own]
    among = np.ascontiguousarray(np.where(heavy[own][:, None], among, 0).astype(np.uint8))
    among = np.concatenate((among, np.zeros((len(among), 4), np.uint8)), axis=1).view("<i8").reshape(-1, 2)
    points, points_alone = (np.bitwise_count(c).sum(axis=1, dtype=np.int64) for c in (whole, alone))
    return pd.DataFrame({
        "structure_id": mine["structure_id"], "atom_ord": mine["atom_ord"], "points": points, "points_alone": points_alone,
        "sasa": unit * points, "sasa_alone": unit * points_alone, "open_low": among[:, 0], "open_high": among[:, 1],
    })


def atom_sasa(atoms: DataFrame) -> DataFrame:
    """Per atom: accessible points and area in the whole structure and with its own chain only; for heavy atoms the
    points that are open among heavy atoms (``open_low``: points 0 to 63, ``open_high``: the rest)."""
    rows = atoms.select(
        "structure_id", "atom_ord", "chain_index", "x", "y", "z", (chem.vdw_radius(F.col("element")) + PROBE).alias("radius"),
        chem.is_heavy(F.col("element"), F.col("atom_name")).alias("heavy"),
    )
    ddl = "structure_id string, atom_ord long, points long, points_alone long, sasa double, sasa_alone double, open_low long, open_high long"
    return map_blocks(cubes(rows, REACH), ["structure_id", "cube_x", "cube_y", "cube_z"], _areas, ddl)


def residue_sasa(atoms: DataFrame, areas: DataFrame) -> DataFrame:
    """Area per residue, and relative to the residue type's maximum (null for other residues)."""
    return (
        joined(atoms.select("structure_id", "atom_ord", "res_ord", "residue_name"), areas.select("structure_id", "atom_ord", "sasa"), ["structure_id", "atom_ord"])
        .groupBy("structure_id", "res_ord", "residue_name")
        .agg(F.sum("sasa").alias("sasa"))
        .withColumn("rsa", F.col("sasa") / chem.max_area(F.col("residue_name")))
    )


def _scores(pdf: pd.DataFrame, group: np.ndarray, radius: float) -> pd.DataFrame:
    """For each interface: the facing dots' scores over the mean density weight of both dot sets."""
    count = int(group[-1]) + 1
    bits = np.ascontiguousarray(pdf[["open_low", "open_high"]].to_numpy("<i8")).view(np.uint8).reshape(len(pdf), 16)
    who, k = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little")[:, : len(POINTS)])
    dots = pdf[["x", "y", "z"]].to_numpy(float)[who] + POINTS[k] * pdf["radius"].to_numpy(float)[who][:, None]
    normal, side, g = POINTS[k], pdf["first"].to_numpy(bool)[who], group[who]
    total, weight = np.zeros(count), np.zeros((2, count))
    if len(dots):
        for here, i, j, d, square in neighbours(dots, radius, g, side, 256):
            i = here[i]
            facing = np.flatnonzero(~side[j] & (square > np.finfo(float).eps))
            i, j, u = i[facing], j[facing], d[facing] / np.sqrt(square[facing])[:, None]
            value = np.maximum((u * normal[i]).sum(axis=1) * -(u * normal[j]).sum(axis=1), 0.0)
            np.add.at(total, g[i], np.exp(-0.5 * square[facing]) * value)
        for s in (0, 1):
            weight[s] = np.bincount(g[side == s], minlength=count)
        for here, i, j, _, square in neighbours(dots, 2.0, g, np.ones(len(dots), bool), 1024):
            i = here[i]
            same = side[i] == side[j]
            np.add.at(weight, (side[i[same]].astype(int), g[i[same]]), 1.0 - square[same] / 4.0)
    some = (weight > 0).all(axis=0)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    score = np.where(some, total / np.where(some, weight.mean(axis=0), 1.0), 0.0)
    return pdf[["structure_id", "chain_a", "chain_b"]].iloc[first].assign(shape_complementarity=score)


def shape_complementarity(dotted: DataFrame, distance: float = 5.0) -> DataFrame:
    """A score for each interface from its patch atoms: ``dotted(structure_id, chain_a, chain_b, first, x, y, z, radius,
    open_low, open_high)``, ``first`` for atoms of ``chain_a``. Groups are interfaces."""
    return map_blocks(
        dotted, ["structure_id", "chain_a", "chain_b"], functools.partial(_scores, radius=distance),
        "structure_id string, chain_a string, chain_b string, shape_complementarity double", 2048,
    )
