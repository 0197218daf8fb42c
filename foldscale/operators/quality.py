"""Model quality: Ramachandran classes, missing backbone atoms, steric clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.operators.backbone import dihedrals
from foldscale.operators.spatial import self_pairs
from foldscale.shared import joined, stored

_MOST = max(chem.VDW_RADII.values())


def _judged(df: DataFrame) -> DataFrame:
    return df.where(F.upper(F.trim("residue_name")).isin(*chem.QUALITY_RESIDUES))


def clashes(atoms: DataFrame, overlap: float = 0.4, grid: bool | None = None) -> DataFrame:
    """Pairs of heavy atoms closer than the sum of their radii less ``overlap``, but for those of one residue and of
    neighbours in a chain's residue list."""
    if overlap < 0:
        raise ValueError("clash overlap must not be negative")
    p = _judged(atoms).where(chem.is_heavy(F.col("element"), F.col("atom_name")))
    p = p.select("structure_id", "atom_ord", "atom_id", "residue_id", "chain_index", "residue_index", "x", "y", "z", chem.vdw_radius(F.col("element")).alias("vdw"))
    next_to = (F.col("chain_index_a") == F.col("chain_index_b")) & (F.abs(F.col("residue_index_a") - F.col("residue_index_b")) == 1)
    return self_pairs(p, max(2 * _MOST - overlap, 0.01), "atom_ord", grid).where(
        (F.col("residue_id_a") != F.col("residue_id_b")) & ~next_to & (F.col("distance") < F.col("vdw_a") + F.col("vdw_b") - overlap)
    )


def residue_quality(atoms: DataFrame, overlap: float = 0.4, all_residues: bool = True, grid: bool | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """One row per judged residue; with ``all_residues`` false only those with a problem. ``pairs``: the clashes, if known."""
    torsions = dihedrals(atoms)
    last = torsions.groupBy("structure_id", "chain_index", "seq_number").agg(F.max_by(F.struct("phi", "psi"), "residue_index").alias("d"))
    there = _judged(atoms).groupBy("structure_id", "res_ord", "chain_index", "chain_label", "residue_index", "residue_id", "residue_name", "seq_number").agg(
        F.array_except(F.array(*(F.lit(n) for n in chem.BACKBONE)), F.collect_set("atom_name")).alias("missing_backbone")
    )
    pairs = clashes(atoms, overlap, grid) if pairs is None else pairs
    side = lambda x, y: pairs.select("structure_id", F.col(f"residue_id_{x}").alias("residue_id"), F.col(f"atom_id_{y}").alias("partner"), "atom_ord_a", "atom_ord_b")
    per = (
        side("a", "b").unionByName(side("b", "a"))
        .groupBy("structure_id", "residue_id")
        .agg(F.count("*").alias("clash_count"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("atom_ord_a", "atom_ord_b", "partner"))), lambda x: x["partner"])).alias("clash_atom_ids"))
    )
    out = (
        joined(joined(there, last, ["structure_id", "chain_index", "seq_number"], "left"), per, ["structure_id", "residue_id"], "left")
        .select(
            "structure_id", "residue_id", F.col("chain_label").alias("chain_id"), "residue_name", "seq_number", "res_ord",
            F.col("d.phi").alias("phi"), F.col("d.psi").alias("psi"),
            F.when(F.size("missing_backbone") == 0, chem.ramachandran(F.col("d.phi"), F.col("d.psi"), F.col("residue_name"))).alias("ramachandran"),
            "missing_backbone", F.coalesce("clash_count", F.lit(0)).cast("long").alias("clash_count"),
            F.coalesce("clash_atom_ids", F.array().cast("array<string>")).alias("clash_atom_ids"),
        )
    )
    if all_residues:
        return out
    return out.where((F.coalesce("ramachandran", F.lit("")) == "outlier") | (F.size("missing_backbone") > 0) | (F.col("clash_count") > 0))


def quality_summary(atoms: DataFrame, overlap: float = 0.4, grid: bool | None = None) -> DataFrame:
    """Seven counts per structure."""
    found = stored(clashes(atoms, overlap, grid).select("structure_id", *(f"{c}_{s}" for c in ("residue_id", "atom_id", "atom_ord") for s in "ab")), "clashes")
    pairs = found.groupBy("structure_id").agg(F.count("*").alias("clash_pair_count"))
    is_class = lambda c: F.count_if(F.col("ramachandran") == c).alias(f"ramachandran_{c}_count")
    judged = residue_quality(atoms, overlap, True, grid, found).groupBy("structure_id").agg(
        F.count("*").alias("quality_residue_count"),
        F.count("ramachandran").alias("ramachandran_evaluated_count"),
        is_class("favored"), is_class("allowed"), is_class("outlier"),
        F.count_if(F.size("missing_backbone") > 0).alias("missing_backbone_residue_count"),
    )
    return joined(judged, pairs, "structure_id", "left").withColumn("clash_pair_count", F.coalesce("clash_pair_count", F.lit(0)).cast("long"))
