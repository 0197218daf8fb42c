"""Ligands: binding sites and counts of interactions with the rest of the structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.functions.chemistry import LigandFilter
from foldscale.operators.spatial import cross_pairs
from foldscale.operators.surface import atom_sasa
from foldscale.shared import joined

COUNTS = ("hydrogen_bond", "salt_bridge", "hydrophobic", "contact")


def _tagged(atoms: DataFrame, ligands: LigandFilter) -> DataFrame:
    return atoms.where(chem.is_heavy(F.col("element"), F.col("atom_name"))).select(
        "structure_id", "res_ord", "residue_id", F.trim("residue_name").alias("res"), F.trim("atom_name").alias("name"),
        "x", "y", "z", "is_hetero", ligands.column(F.col("is_hetero"), F.col("residue_name")).alias("is_ligand"),
        chem.is_ligand_carbon(F.col("element"), F.col("atom_name")).alias("is_carbon"),
    )


def _pairs(atoms: DataFrame, ligands: LigandFilter, cutoff: float, grid: bool | None) -> DataFrame:
    """Heavy ligand atoms (``_a``) with all other heavy atoms (``_b``); the ligand side alone filters the join."""
    t = _tagged(atoms, ligands)
    return cross_pairs(t.where("is_ligand"), t.where("not is_ligand"), cutoff, grid)


def _counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d, c = F.col("distance"), F.col
    return pairs.where(d <= 4.5).groupBy(*keys).agg(
        F.count_if(chem.is_hydrogen_bond(c("name_a"), c("name_b"), d)).alias("hydrogen_bond"),
        F.count_if(chem.is_salt_bridge(c("res_a"), c("name_a"), c("res_b"), c("name_b"), d)).alias("salt_bridge"),
        F.count_if((d < 4.5) & c("is_carbon_a") & chem.is_hydrophobic_carbon(c("res_b"), c("name_b"))).alias("hydrophobic"),
        F.count_if(d < 4.5).alias("contact"),
    )


def ligand_features(atoms: DataFrame, ligands: LigandFilter | None = None, binding_distance: float = 5.0, areas: DataFrame | None = None, grid: bool | None = None) -> DataFrame:
    """One row per ligand residue: area, sorted binding-site residues (protein only), interaction counts."""
    if binding_distance <= 0:
        raise ValueError("binding distance must be positive")
    ligands = ligands or LigandFilter()
    areas = areas if areas is not None else atom_sasa(atoms)
    mine = atoms.where(ligands.column(F.col("is_hetero"), F.col("residue_name")))
    keys = ["structure_id", "res_ord"]
    base = joined(mine, areas, ["structure_id", "atom_ord"]).groupBy(*keys, "residue_id", "chain_label", "residue_name", "seq_number").agg(F.sum("sasa").alias("sasa"))
    pairs = _pairs(atoms, ligands, max(4.5, binding_distance), grid).withColumnRenamed("res_ord_a", "res_ord")
    site = pairs.where((F.col("distance") <= binding_distance) & ~F.col("is_hetero_b")).groupBy(*keys).agg(F.array_sort(F.collect_set("residue_id_b")).alias("site"))
    counts = _counts(pairs, keys)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined(joined(base, site, keys, "left"), counts, keys, "left").select(
        "structure_id", F.col("residue_id").alias("ligand_id"), "residue_name", F.col("chain_label").alias("chain_id"), "seq_number", "sasa",
        F.coalesce("site", F.array().cast("array<string>")).alias("binding_site_residues"),
        F.create_map(*(x for n in COUNTS for x in (F.lit(n), zero(n)))).alias("interactions"),
    )


def ligand_summary(atoms: DataFrame, ligands: LigandFilter | None = None, binding_distance: float = 5.0, areas: DataFrame | None = None, grid: bool | None = None) -> DataFrame:
    """Per structure with ligands: count, area sum and mean, distinct binding-site residues, interaction counts."""
    ligands = ligands or LigandFilter()
    per = ligand_features(atoms, ligands, binding_distance, areas, grid)
    n = lambda c: F.sum(F.col("interactions")[c])
    return per.groupBy("structure_id").agg(
        F.count("*").alias("ligand_count"), F.sum("sasa").alias("ligand_sasa_total"), F.avg("sasa").alias("ligand_sasa_mean"),
        F.size(F.array_distinct(F.flatten(F.collect_list("binding_site_residues")))).cast("long").alias("binding_site_residue_count"),
        n("hydrogen_bond").alias("protein_ligand_hbond_count"), n("salt_bridge").alias("protein_ligand_salt_bridge_count"),
        n("hydrophobic").alias("protein_ligand_hydrophobic_count"), n("contact").alias("protein_ligand_contact_count"),
    )
