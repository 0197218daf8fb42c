"""Per-structure counts and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions.chemistry import LigandFilter
from foldscale.sources.canonical import residues


def summary(atoms: DataFrame) -> DataFrame:
    """Chains, residues, atoms, hetero atoms and hetero residues (the unfiltered ligand count)."""
    return (
        residues(atoms)
        .groupBy("structure_id")
        .agg(
            (F.max("chain_index") + 1).cast("long").alias("chain_count"),
            F.count("*").alias("residue_count"),
            F.sum("atom_count").alias("atom_count"),
            F.sum(F.when(F.col("is_hetero"), F.col("atom_count")).otherwise(0)).alias("heteroatom_count"),
            F.count_if("is_hetero").alias("ligand_count"),
        )
    )


def moments(atoms: DataFrame) -> DataFrame:
    """Centroid, radius of gyration and B-factor statistics (population deviation)."""
    spread = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    return atoms.groupBy("structure_id").agg(
        F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("centroid"),
        F.sqrt(spread).alias("radius_of_gyration"),
        F.avg("temp_factor").alias("bfactor_mean"),
        F.stddev_pop("temp_factor").alias("bfactor_std"),
        F.min("temp_factor").alias("bfactor_min"),
        F.max("temp_factor").alias("bfactor_max"),
    )


def ligand_residues(atoms: DataFrame, ligands: LigandFilter | None = None) -> DataFrame:
    return residues(atoms).where((ligands or LigandFilter()).column(F.col("is_hetero"), F.col("residue_name")))
