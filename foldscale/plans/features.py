"""The feature table: one wide row per structure, from pre-aggregated frames joined on the structure id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions.chemistry import LigandFilter
from foldscale.operators import backbone, contacts, interactions, interface, ligands, quality, summary, surface
from foldscale.operators.interface import InterfaceParams
from foldscale.shared import joined, stored
from foldscale.sources.canonical import readable, residues

_ZERO_LONG = (
    "contact_count", "interface_contact_count", "interface_residue_count", "buried_residue_count", "exposed_residue_count",
    "helix_residue_count", "strand_residue_count", "coil_residue_count", *(f"{k}_count" for k in interactions.KINDS),
    "connected_components", "ligand_count", "binding_site_residue_count", "protein_ligand_hbond_count", "protein_ligand_salt_bridge_count",
    "protein_ligand_hydrophobic_count", "protein_ligand_contact_count", "interface_pair_count", "quality_residue_count",
    "ramachandran_evaluated_count", "ramachandran_favored_count", "ramachandran_allowed_count", "ramachandran_outlier_count",
    "clash_pair_count", "missing_backbone_residue_count",
)
_ZERO_DOUBLE = (
    "sasa_total", "graph_density", "clustering_coefficient", "ligand_sasa_total", "ligand_sasa_mean", "interface_bsa_total",
    "interface_area_total", "interface_sc_mean", "interface_bsa_max", "interface_area_max", "interface_sc_max",
)


def residue_features(atoms: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row per residue: area, relative area, state, torsions, mean B-factor."""
    atoms = stored(atoms, "atoms")
    areas = areas if areas is not None else surface.atom_sasa(atoms)
    keys = ["structure_id", "res_ord"]
    r = residues(atoms).select(*keys, "residue_id", "chain_id", "residue_name", "seq_number", "bfactor_mean")
    r = joined(r, surface.residue_sasa(atoms, areas).drop("residue_name"), keys)
    r = joined(r, backbone.secondary_structure(atoms).select(*keys, "secondary_structure"), keys)
    return readable(joined(r, backbone.dihedrals(atoms).select(*keys, "phi", "psi", "omega"), keys))


def features(
    atoms: DataFrame, ligand_filter: LigandFilter | None = None, binding_distance: float = 5.0,
    interface_params: InterfaceParams | None = None, clash_overlap: float = 0.4, grid: bool | None = None,
) -> DataFrame:
    """The 54 features with structure_id and source_path, a row for each file. Atoms, areas and other steps that several
    operators read are computed once and shared."""
    atoms = stored(atoms, "atoms")
    areas = stored(surface.atom_sasa(atoms), "areas")
    nodes = residues(atoms).select("structure_id", F.col("res_ord").alias("node"))
    edges = contacts.residue_graph(atoms, grid=grid)
    between = stored(contacts.interface_graph(atoms, grid=grid).select("structure_id", "a", "b"), "between")
    ends = between.select("structure_id", F.explode(F.array("a", "b")).alias("n"))
    per = surface.residue_sasa(atoms, areas).groupBy("structure_id").agg(
        F.sum("sasa").alias("sasa_total"), F.count_if(F.col("rsa") < 0.25).alias("buried_residue_count"),
        F.count_if(F.col("rsa") >= 0.25).alias("exposed_residue_count"),
    )
    state = lambda *s: F.count_if(F.col("secondary_structure").isin(*s))
    fold = backbone.secondary_structure(atoms).groupBy("structure_id").agg(
        state("H", "G", "I").alias("helix_residue_count"), state("E").alias("strand_residue_count"), state("C").alias("coil_residue_count")
    )
    paths = atoms.groupBy("structure_id").agg(F.min("source_path").alias("source_path"))
    parts = [
        summary.summary(atoms).drop("ligand_count"),
        summary.moments(atoms),
        contacts.graph_statistics(nodes, edges),
        between.groupBy("structure_id").agg(F.count("*").alias("interface_contact_count")),
        ends.groupBy("structure_id").agg(F.count_distinct("n").alias("interface_residue_count")),
        per,
        fold,
        interactions.interaction_counts(interactions.interactions(atoms, grid)),
        ligands.ligand_summary(atoms, ligand_filter, binding_distance, areas, grid),
        interface.interface_summary(interface.interfaces(atoms, interface_params, areas, grid)),
        quality.quality_summary(atoms, clash_overlap, grid),
    ]
    out = paths
    for p in parts:
        out = joined(out, p, "structure_id", "left")
    out = out.fillna(0, [*_ZERO_LONG]).fillna(0.0, [*_ZERO_DOUBLE]).fillna("", ["interface_chain_a", "interface_chain_b"])
    names = sorted(c for c in out.columns if c not in ("structure_id", "source_path"))
    return readable(out.select("structure_id", "source_path", *names))


def flat(table: DataFrame) -> DataFrame:
    """As written to Parquet: arrays as JSON text."""
    arrays = [f.name for f in table.schema if f.dataType.typeName() == "array"]
    return table.withColumns({c: F.to_json(c) for c in arrays})


__all__ = ["features", "flat", "residue_features"]
