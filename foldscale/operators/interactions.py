"""Typed interactions: disulfides, salt bridges, hydrogen bonds, ring stacking, hydrophobic contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.functions.geometry import cross, norm, sub, xyz
from foldscale.operators.spatial import cross_pairs, self_pairs
from foldscale.shared import stored

KINDS = ("disulfide", "salt_bridge", "hydrogen_bond", "cation_pi", "pi_pi_parallel", "pi_pi_perpendicular", "hydrophobic")
_OUT = ["structure_id", "kind", "atom_id_a", "atom_id_b", "res_a", "res_b", "distance"]
# Ring atoms, and the atoms that span the ring's plane with CG.
RINGS = {
    "PHE": (("CG", "CD1", "CD2", "CE1", "CE2", "CZ"), "CE2"),
    "TYR": (("CG", "CD1", "CD2", "CE1", "CE2", "CZ"), "CE2"),
    "TRP": (("CG", "CD1", "CD2", "NE1", "CE2", "CE3", "CZ2", "CZ3", "CH2"), "CE3"),
}


def _points(atoms: DataFrame) -> DataFrame:
    return atoms.select(
        "structure_id", "atom_ord", "atom_id", "res_ord", "residue_id", F.trim("residue_name").alias("res"),
        F.trim("atom_name").alias("name"), "x", "y", "z",
    )


def _pairs_out(df: DataFrame, kind) -> DataFrame:
    return df.select(
        "structure_id", kind.alias("kind"), "atom_id_a", "atom_id_b", F.col("res_ord_a").alias("res_a"),
        F.col("res_ord_b").alias("res_b"), "distance",
    ).where("kind is not null")


def rings(atoms: DataFrame) -> DataFrame:
    """Aromatic rings with all their atoms: centroid x, y, z and unit normal. One aggregation for all residue types."""
    every = sorted({n for names, _ in RINGS.values() for n in names})
    kinds = [(F.col("res") == residue, names, third) for residue, (names, third) in RINGS.items()]
    part = F.lit(False)
    for mine, names, _ in kinds:
        part |= mine & F.col("name").isin(*names)
    at = [F.min_by(F.when(F.col("name") == n, F.struct("x", "y", "z")), F.when(F.col("name") == n, F.col("atom_ord"))).alias(n) for n in every]
    g = _points(atoms).where(part).groupBy("structure_id", "res_ord", "residue_id", "res").agg(*at)
    points = third_point = None
    for mine, names, third in kinds:
        listed, third = F.array(*names), F.col(third)
        points = F.when(mine, listed) if points is None else points.when(mine, listed)
        third_point = F.when(mine, third) if third_point is None else third_point.when(mine, third)
    g = g.select("structure_id", "res_ord", "residue_id", "CG", "CD1", third_point.alias("third"), points.alias("p"))
    g = g.where(~F.exists("p", lambda q: q.isNull()))
    mean = [F.aggregate(F.transform("p", lambda q: q[c]), F.lit(0.0), lambda s, q: s + q) / F.size("p") for c in "xyz"]  # noqa: B023
    v = cross(sub(xyz("CD1"), xyz("CG")), sub(xyz("third"), xyz("CG")))
    keys = ["structure_id", "res_ord", "residue_id", F.concat("residue_id", F.lit(":CG")).alias("atom_id")]
    g = g.select(*keys, *(m.alias(c) for m, c in zip(mean, "xyz", strict=True)), F.struct(*(p.alias(c) for p, c in zip(v, "xyz", strict=True))).alias("v"))
    g = g.withColumn("size", norm(xyz("v")))
    normal = [F.when(F.col("size") > 0, F.col(f"v.{c}") / F.nullif("size", F.lit(0.0))).otherwise(float(c == "z")).alias(f"n{c}") for c in "xyz"]
    return g.select("structure_id", "res_ord", "residue_id", "atom_id", "x", "y", "z", *normal)


def polar(atoms: DataFrame, grid: bool | None = None) -> DataFrame:
    """Disulfides, else salt bridges, else hydrogen bonds between residues; pairs up to 4 Angstrom.

    Only atoms that can take part are joined: sulfur of cysteine, nitrogen and oxygen names.
    """
    p = _points(atoms).where(((F.col("res") == "CYS") & (F.col("name") == "SG")) | F.substring("name", 1, 1).isin("N", "O"))
    c = F.col
    sulfur = (c("res_a") == "CYS") & (c("name_a") == "SG") & (c("res_b") == "CYS") & (c("name_b") == "SG")
    kind = (
        F.when(sulfur & (c("distance") < 2.5), "disulfide")
        .when(chem.is_salt_bridge(c("res_a"), c("name_a"), c("res_b"), c("name_b"), c("distance")), "salt_bridge")
        .when((c("residue_id_a") != c("residue_id_b")) & chem.is_hydrogen_bond(c("name_a"), c("name_b"), c("distance")), "hydrogen_bond")
    )
    return _pairs_out(self_pairs(p, 4.0, "atom_ord", grid), kind)


def hydrophobic(atoms: DataFrame, grid: bool | None = None) -> DataFrame:
    p = _points(atoms).where(chem.is_hydrophobic_carbon(F.col("res"), F.col("name")))
    apart = (F.col("residue_id_a") != F.col("residue_id_b")) & (F.col("distance") < 4.5)
    return _pairs_out(self_pairs(p, 4.5, "atom_ord", grid).where(apart), F.lit("hydrophobic"))


def cation_pi(atoms: DataFrame, grid: bool | None = None, found: DataFrame | None = None) -> DataFrame:
    p = _points(atoms).where(chem.is_basic_nitrogen(F.col("res"), F.col("name")))
    r = (rings(atoms) if found is None else found).select("structure_id", "res_ord", "residue_id", "atom_id", "x", "y", "z")
    apart = (F.col("residue_id_a") != F.col("residue_id_b")) & (F.col("distance") < 6.0)
    return _pairs_out(cross_pairs(p, r, 6.0, grid).where(apart), F.lit("cation_pi"))


def pi_pi(atoms: DataFrame, grid: bool | None = None, found: DataFrame | None = None) -> DataFrame:
    cos = F.least(F.abs(sum((F.col(f"n{c}_a") * F.col(f"n{c}_b") for c in "yz"), F.col("nx_a") * F.col("nx_b"))), F.lit(1.0))
    angle = F.degrees(F.acos(cos))
    kind = F.when(angle < 30.0, "pi_pi_parallel").when(angle.between(60.0, 90.0), "pi_pi_perpendicular")
    apart = (F.col("residue_id_a") != F.col("residue_id_b")) & (F.col("distance") < 5.5)
    return _pairs_out(self_pairs(rings(atoms) if found is None else found, 5.5, "res_ord", grid).where(apart), kind)


def interactions(atoms: DataFrame, grid: bool | None = None) -> DataFrame:
    """All kinds: structure_id, kind, atom ids, residue ordinals, distance. The rings are found once."""
    found = stored(rings(atoms), "rings")
    parts = (cation_pi(atoms, grid, found), pi_pi(atoms, grid, found), hydrophobic(atoms, grid))
    out = polar(atoms, grid)
    for p in parts:
        out = out.unionByName(p)
    return out.select(*_OUT)


def interaction_counts(found: DataFrame) -> DataFrame:
    """A column ``<kind>_count`` for each kind."""
    return found.groupBy("structure_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in KINDS))
