"""Interfaces between chains: contacting pairs, buried areas, patches, complementarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.functions import chemistry as chem
from foldscale.operators.spatial import cross_pairs
from foldscale.operators.surface import PROBE, atom_sasa, shape_complementarity
from foldscale.shared import joined, stored


@dataclass(frozen=True)
class InterfaceParams:
    contact_distance: float = 8.0
    area_distance: float = 5.0
    sc_distance: float = 5.0

    def __post_init__(self):
        if min(self.contact_distance, self.area_distance, self.sc_distance) <= 0:
            raise ValueError("interface distances must be positive")


def _heavy(atoms: DataFrame) -> DataFrame:
    return atoms.where(chem.is_heavy(F.col("element"), F.col("atom_name"))).select("structure_id", "atom_ord", "chain_label", "res_ord", "residue_id", "x", "y", "z")


def chain_contacts(atoms: DataFrame, cutoff: float = 8.0, grid: bool | None = None) -> DataFrame:
    """Per contacting pair of chains (a < b): residue pairs whose closest heavy atoms are within ``cutoff``."""
    heavy = _heavy(atoms)
    return (
        cross_pairs(heavy, heavy, cutoff, grid)
        .where("chain_label_a < chain_label_b")
        .groupBy("structure_id", F.col("chain_label_a").alias("chain_a"), F.col("chain_label_b").alias("chain_b"), "res_ord_a", "res_ord_b")
        .agg(F.min("distance").alias("d"))
        .groupBy("structure_id", "chain_a", "chain_b")
        .agg(F.count("*").alias("contact_count"))
    )


def interfaces(atoms: DataFrame, params: InterfaceParams | None = None, areas: DataFrame | None = None, grid: bool | None = None) -> DataFrame:
    """One row per contacting pair of chains: contacts, patch residues per side, buried area, patch area, score."""
    params = params or InterfaceParams()
    areas = areas if areas is not None else atom_sasa(atoms)
    pairs = chain_contacts(atoms, params.contact_distance, grid)
    delta = joined(atoms.select("structure_id", "atom_ord", "chain_label"), areas, ["structure_id", "atom_ord"]).select(
        "structure_id", "atom_ord", "chain_label", F.greatest(F.col("sasa_alone") - F.col("sasa"), F.lit(0.0)).alias("delta")
    )
    per_chain = delta.groupBy("structure_id", "chain_label").agg(F.sum("delta").alias("delta"))
    side = lambda s: per_chain.select("structure_id", F.col("chain_label").alias(f"chain_{s}"), F.col("delta").alias(f"delta_{s}"))
    # patch atoms: heavy atoms and how near they are to another chain, for the area and for the score
    heavy = _heavy(atoms)
    radius = (chem.vdw_radius(F.col("element")) + PROBE).alias("radius")
    near = (
        cross_pairs(heavy, heavy.drop("residue_id", "res_ord", "atom_ord"), max(params.area_distance, params.sc_distance), grid)
        .where("chain_label_a != chain_label_b")
        .groupBy("structure_id", F.col("atom_ord_a").alias("atom_ord"), F.col("chain_label_b").alias("other"))
        .agg(F.min("distance").alias("distance"))
    )
    near = joined(near, atoms.select("structure_id", "atom_ord", F.col("chain_label").alias("own"), "residue_id", "x", "y", "z", radius), ["structure_id", "atom_ord"])
    near = joined(near, areas.select("structure_id", "atom_ord", F.greatest(F.col("sasa_alone") - F.col("sasa"), F.lit(0.0)).alias("delta"), "open_low", "open_high"), ["structure_id", "atom_ord"])
    near = stored(near.withColumns({"chain_a": F.least("own", "other"), "chain_b": F.greatest("own", "other")}).drop("other"), "patches")
    scores = shape_complementarity(
        near.where(F.col("distance") <= params.sc_distance).select("structure_id", "chain_a", "chain_b", (F.col("own") == F.col("chain_a")).alias("first"), "x", "y", "z", "radius", "open_low", "open_high"),
        params.sc_distance,
    )
    patch = (
        near.where(F.col("distance") <= params.area_distance)
        .groupBy("structure_id", "chain_a", "chain_b")
        .agg(
            F.sum("delta").alias("interface_area"),
            F.count_distinct(F.when(F.col("own") == F.col("chain_a"), F.col("residue_id"))).alias("interface_residue_count_a"),
            F.count_distinct(F.when(F.col("own") == F.col("chain_b"), F.col("residue_id"))).alias("interface_residue_count_b"),
        )
    )
    keys = ["structure_id", "chain_a", "chain_b"]
    out = joined(joined(pairs, side("a"), ["structure_id", "chain_a"]), side("b"), ["structure_id", "chain_b"])
    return joined(joined(out, patch, keys, "left"), scores, keys, "left").select(
        *keys, "contact_count",
        *(F.coalesce(f"interface_residue_count_{s}", F.lit(0)).cast("long").alias(f"interface_residue_count_{s}") for s in "ab"),
        (F.col("delta_a") + F.col("delta_b")).alias("bsa"),
        F.coalesce("interface_area", F.lit(0.0)).alias("interface_area"),
        F.coalesce("shape_complementarity", F.lit(0.0)).alias("shape_complementarity"),
    )


def interface_summary(found: DataFrame) -> DataFrame:
    """Count, sums, mean score, and the values of the pair with the greatest buried area (ties: first chains)."""
    best = F.min_by(F.struct("bsa", "interface_area", "shape_complementarity", "chain_a", "chain_b"), F.struct(-F.col("bsa"), "chain_a", "chain_b"))
    return found.groupBy("structure_id").agg(
        F.count("*").alias("interface_pair_count"), F.sum("bsa").alias("interface_bsa_total"),
        F.sum("interface_area").alias("interface_area_total"), F.avg("shape_complementarity").alias("interface_sc_mean"),
        best.alias("best"),
    ).select(
        "structure_id", "interface_pair_count", "interface_bsa_total", "interface_area_total", "interface_sc_mean",
        F.col("best.bsa").alias("interface_bsa_max"), F.col("best.interface_area").alias("interface_area_max"),
        F.col("best.shape_complementarity").alias("interface_sc_max"),
        F.col("best.chain_a").alias("interface_chain_a"), F.col("best.chain_b").alias("interface_chain_b"),
    )
