"""Registered queries over synthetic structures; the same questions in SQL are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.operators import backbone, contacts, interactions, interface, ligands, quality, summary, superpose, surface
from foldscale.oracle import SQL
from foldscale.plans import features as plans
from foldscale.shared import stored
from foldscale.sources.canonical import canonicalise, residues
from foldscale.sources.scan import pdb_lines
from foldscale.sources.synthetic import altloc_rows, atoms_from_orders, lattice_atoms, ring_atoms, thinned

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _text(column: str):
    """An array as text, for comparison."""
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


@_query
def structure_summary(spark, sf_dir):
    return summary.summary(atoms_from_orders(spark, sf_dir))


def _centroid(df: DataFrame) -> DataFrame:
    return df.withColumns({f"c{c}": F.col("centroid")[i] for i, c in enumerate("xyz")}).drop("centroid")


@_query
def structure_moments(spark, sf_dir):
    m = _centroid(summary.moments(atoms_from_orders(spark, sf_dir)))
    return _rounded(m, "cx", "cy", "cz", "radius_of_gyration", "bfactor_mean", "bfactor_std")


def _edges(df: DataFrame) -> DataFrame:
    return _rounded(df, "distance").select("structure_id", "a", "b", "kind", "distance")


@_query
def residue_contact_graph(spark, sf_dir):
    """By the structure alone, without the grid."""
    return _edges(contacts.residue_graph(atoms_from_orders(spark, sf_dir), grid=False))


@_query
def residue_contact_graph_grid(spark, sf_dir):
    return _edges(contacts.residue_graph(atoms_from_orders(spark, sf_dir)))


@_query
def interface_contact_graph(spark, sf_dir):
    return _edges(contacts.interface_graph(atoms_from_orders(spark, sf_dir))).drop("kind")


@_query
def residue_interaction_graph(spark, sf_dir):
    """The residue graph with typed interactions merged in."""
    atoms = stored(atoms_from_orders(spark, sf_dir), "atoms")
    return _edges(contacts.residue_graph(atoms, interactions=interactions.interactions(atoms)))


@_query
def interface_interaction_graph(spark, sf_dir):
    atoms = stored(atoms_from_orders(spark, sf_dir), "atoms")
    return _edges(contacts.interface_graph(atoms, interactions=interactions.interactions(atoms)))


@_query
def atom_contact_graph(spark, sf_dir):
    g = contacts.atom_graph(atoms_from_orders(spark, sf_dir))
    return _rounded(g.groupBy("structure_id").agg(F.count("*").alias("edges"), F.sum("distance").alias("total")), "total", digits=3)


@_query
def large_structure_contacts(spark, sf_dir):
    """The atom graph of structures of 30,000 atoms."""
    g = contacts.atom_graph(lattice_atoms(spark, sf_dir))
    return _rounded(g.groupBy("structure_id").agg(F.count("*").alias("edges"), F.sum("distance").alias("total")), "total", digits=3)


def _graph(atoms: DataFrame) -> DataFrame:
    nodes = residues(atoms).select("structure_id", F.col("res_ord").alias("node"))
    return contacts.graph_statistics(nodes, contacts.residue_graph(atoms))


@_query
def residue_graph_statistics(spark, sf_dir):
    s = _graph(atoms_from_orders(spark, sf_dir)).withColumn("degrees", _text("degree_distribution"))
    return _rounded(s.drop("degree_distribution", "connected_components"), "graph_density", "clustering_coefficient", digits=6)


@_query
def residue_graph_components(spark, sf_dir):
    return _graph(atoms_from_orders(spark, sf_dir)).select("structure_id", "connected_components")


@_query
def typed_interactions(spark, sf_dir):
    found = interactions.interactions(atoms_from_orders(spark, sf_dir))
    return _rounded(found.groupBy("structure_id", "kind").agg(F.count("*").alias("n"), F.sum("distance").alias("total")), "total", digits=3)


@_query
def ring_interactions(spark, sf_dir):
    atoms = ring_atoms(spark, sf_dir)
    found = interactions.cation_pi(atoms).unionByName(interactions.pi_pi(atoms))
    return found.groupBy("structure_id", "kind").agg(F.count("*").alias("n"))


@_query
def backbone_torsions(spark, sf_dir):
    return _rounded(backbone.dihedrals(atoms_from_orders(spark, sf_dir)).select("structure_id", "res_ord", "phi", "psi", "omega"), "phi", "psi", "omega", digits=3)


@_query
def ramachandran_classes(spark, sf_dir):
    d = backbone.dihedrals(atoms_from_orders(spark, sf_dir))
    kind = chem.ramachandran(F.col("phi"), F.col("psi"), F.col("residue_name")).alias("class")
    return d.select("residue_name", kind).groupBy("residue_name", "class").agg(F.count("*").alias("n"))


@_query
def steric_clashes(spark, sf_dir):
    c = quality.clashes(atoms_from_orders(spark, sf_dir))
    g = c.groupBy("structure_id", F.col("residue_id_a").alias("residue_a"), F.col("residue_id_b").alias("residue_b")).agg(F.count("*").alias("n"), F.min("distance").alias("nearest"))
    return _rounded(g, "nearest")


@_query
def model_quality_summary(spark, sf_dir):
    return quality.quality_summary(atoms_from_orders(spark, sf_dir))


def _judged(df: DataFrame, *columns: str) -> DataFrame:
    df = df.withColumn("missing_backbone", F.concat_ws(",", "missing_backbone"))
    return _rounded(df, "phi", "psi", digits=3).select("structure_id", "residue_id", *columns, "phi", "psi", "ramachandran", "missing_backbone", "clash_count")


@_query
def problem_residues(spark, sf_dir):
    return _judged(quality.residue_quality(atoms_from_orders(spark, sf_dir), all_residues=False), "chain_id", "residue_name", "seq_number")


@_query
def quality_of_incomplete_models(spark, sf_dir):
    """Every judged residue of structures with a thirteenth of their atoms left out."""
    return _judged(quality.residue_quality(thinned(atoms_from_orders(spark, sf_dir))))


@_query
def states_of_incomplete_models(spark, sf_dir):
    return backbone.secondary_structure(thinned(atoms_from_orders(spark, sf_dir))).select("structure_id", "res_ord", "secondary_structure")


@_query
def backbone_hydrogen_bonds(spark, sf_dir):
    return backbone.hydrogen_bonds(atoms_from_orders(spark, sf_dir))


@_query
def secondary_structure_states(spark, sf_dir):
    return backbone.secondary_structure(atoms_from_orders(spark, sf_dir)).select("structure_id", "res_ord", "secondary_structure")


@_query
def accessible_surface_points(spark, sf_dir):
    return surface.atom_sasa(atoms_from_orders(spark, sf_dir)).groupBy("structure_id").agg(F.sum("points").alias("points"))


@_query
def residue_surfaces(spark, sf_dir):
    atoms = atoms_from_orders(spark, sf_dir)
    r = surface.residue_sasa(atoms, surface.atom_sasa(atoms)).select("structure_id", "res_ord", "sasa", "rsa")
    return _rounded(_rounded(r, "sasa"), "rsa", digits=6)


@_query
def chain_pair_contacts(spark, sf_dir):
    return interface.chain_contacts(atoms_from_orders(spark, sf_dir))


@_query
def ligand_binding_sites(spark, sf_dir):
    f = _rounded(ligands.ligand_features(atoms_from_orders(spark, sf_dir)), "sasa")
    counts = (F.col("interactions")[k].alias(k) for k in ("contact", "hydrogen_bond", "salt_bridge", "hydrophobic"))
    return f.select("structure_id", "ligand_id", "chain_id", "seq_number", "sasa", F.size("binding_site_residues").cast("long").alias("site_residues"), *counts)


@_query
def pdb_text_round_trip(spark, sf_dir):
    a = atoms_from_orders(spark, sf_dir)
    record = F.when(F.col("is_hetero"), "HETATM").otherwise("ATOM  ")
    line = F.format_string("%s%5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", record, "serial", "atom_name", "residue_name", "chain_label", "seq_number", "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
    back = canonicalise(pdb_lines(a.select("structure_id", line.alias("line"))))
    g = back.groupBy("structure_id", F.col("chain_label").alias("chain"), "residue_index", "residue_name").agg(F.count("*").alias("atoms"), F.sum("x").alias("x"))
    return _rounded(g, "x", digits=3)


@_query
def alternate_locations(spark, sf_dir):
    """Residues of parsed rows with alternate locations, insertion codes, blank chains and hetero residues."""
    a = canonicalise(altloc_rows(spark, sf_dir))
    names = F.array_sort(F.collect_list(F.struct("serial", "atom_name")))
    g = a.groupBy("structure_id", "res_ord", "chain_index", "residue_index", "residue_id").agg(F.count("*").alias("atoms"), F.concat_ws(",", F.transform(names, lambda x: x["atom_name"])).alias("names"), F.sum("x").alias("x"))
    return g.select("structure_id", *(F.col(c).cast("int").alias(c) for c in ("res_ord", "chain_index", "residue_index")), "residue_id", "atoms", "names", "x")


@_query
def structure_rmsd_pairs(spark, sf_dir):
    return _rounded(superpose.rmsd_pairs(atoms_from_orders(spark, sf_dir), superpose.RmsdParams(atoms="ca")), "rmsd")


@_query
def interface_features(spark, sf_dir):
    f = interface.interfaces(stored(atoms_from_orders(spark, sf_dir), "atoms"))
    return _rounded(_rounded(f, "bsa", "interface_area"), "shape_complementarity", digits=6)


@_query
def residue_features(spark, sf_dir):
    f = plans.residue_features(atoms_from_orders(spark, sf_dir))
    return _rounded(_rounded(_rounded(f, "bfactor_mean", "sasa"), "rsa", digits=6), "phi", "psi", "omega", digits=3)


@_query
def structure_features(spark, sf_dir):
    """All 54 features."""
    f = _centroid(plans.features(atoms_from_orders(spark, sf_dir))).drop("source_path")
    f = f.withColumn("degrees", _text("degree_distribution")).drop("degree_distribution")
    long = ("graph_density", "clustering_coefficient", "interface_sc_mean", "interface_sc_max")
    rest = [c.name for c in f.schema if c.dataType.typeName() == "double" and c.name not in long and not c.name.startswith("bfactor_m")]
    return _rounded(_rounded(f, *long, digits=6), *rest, "bfactor_mean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: SQL[k] for k in _QUERIES if k in SQL}
