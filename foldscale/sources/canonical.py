"""From parsed atom rows to the canonical ``atoms`` table that all operators read.

Alternate locations are chosen per residue, and chains, residues and atoms get their ordinals and ids. All of it
is aggregation and windows keyed by structure, so structures never mix and partition freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_DDL = (
    "structure_id string, source_path string, source_format string, title string, chain string, seq_number int, "
    "insertion_code string, is_hetero boolean, residue_name string, serial int, atom_name string, alt_loc string, "
    "element string, x double, y double, z double, occupancy double, temp_factor double"
)


#: Between the name and the path in a structure's key.
SEPARATOR = "\x1f"


def name_of(key: str = "structure_id") -> Column:
    """A structure's name from its key."""
    return F.substring_index(key, SEPARATOR, 1)


def readable(df: DataFrame) -> DataFrame:
    """With structure names in place of keys, as results show them."""
    return df.withColumn("structure_id", name_of())


def select_altlocs(raw: DataFrame) -> DataFrame:
    """Keep blank alternate locations, and of the others the one with the greatest (occupancy sum, count, letter)."""
    residue = ["structure_id", "chain", "seq_number", "insertion_code", "is_hetero"]
    marked = raw.where("alt_loc is not null")
    best = (
        marked.groupBy(*residue, "alt_loc")
        .agg(F.sum("occupancy").alias("occ"), F.count("*").alias("n"))
        .groupBy(*residue)
        .agg(F.max(F.struct("occ", "n", "alt_loc")).alias("best"))
        .select(*(F.col(c).alias(f"_{c}") for c in residue), F.col("best.alt_loc").alias("_alt"))
    )
    same = None
    for c in residue:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    return (
        raw.join(best, same, "left")
        .where(F.col("alt_loc").isNull() | (F.col("alt_loc") == F.coalesce("_alt", "alt_loc")))
        .drop(*(f"_{c}" for c in residue), "_alt")
    )


def canonicalise(raw: DataFrame, keep_hetero: bool = True) -> DataFrame:
    """Raw rows (``RAW_DDL``) to atoms with ordinals and ids, in chain, residue and atom order.

    ``structure_id`` is a key: scans append the file's path to the name, so that files of one name are two structures.
    Ids of chains, residues and atoms begin with the name alone, as results do (``readable``).
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = raw.select(
        "structure_id", "source_path", "source_format", "title",
        F.coalesce(blank("chain"), F.lit("_")).alias("chain"),
        "seq_number", blank("insertion_code").alias("insertion_code"), "is_hetero",
        "residue_name", "serial", "atom_name", blank("alt_loc").alias("alt_loc"), blank("element").alias("element"),
        "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)).alias("occupancy"),
        F.coalesce("temp_factor", F.lit(0.0)).alias("temp_factor"),
    )
    if not keep_hetero:
        rows = rows.where(~F.col("is_hetero"))
    rows = select_altlocs(rows)
    key = ["chain", "seq_number", "insertion_code", "is_hetero"]
    order = [*key, "serial", "atom_name", "alt_loc"]
    one = Window.partitionBy("structure_id")
    chain = Window.partitionBy("structure_id", "chain")
    residue = Window.partitionBy("structure_id", *key).orderBy("serial", "atom_name", "alt_loc")
    ranked = (
        rows.withColumn("chain_index", F.dense_rank().over(one.orderBy("chain")) - 1)
        .withColumn("res_ord", F.dense_rank().over(one.orderBy(*key)) - 1)
        .withColumn("atom_ord", F.row_number().over(one.orderBy(*order)).cast("long") - 1)
        .withColumn("residue_index", F.dense_rank().over(chain.orderBy(*key[1:])) - 1)
        .withColumn("atom_index", F.row_number().over(residue) - 1)
        .withColumn("residue_name", F.first("residue_name").over(residue))
        .withColumn("chain_id", F.concat_ws(":", name_of(), "chain"))
        .withColumn(
            "residue_id",
            F.concat_ws(":", "chain_id", F.col("seq_number").cast("string"), F.coalesce("insertion_code", F.lit("_"))),
        )
        .withColumn("atom_id", F.concat_ws(":", "residue_id", F.col("atom_index").cast("string"), "atom_name"))
    )
    return ranked.select(
        "structure_id", "source_path", "source_format", "title", "chain_index", "chain_id",
        F.col("chain").alias("chain_label"), "residue_index", "res_ord", "residue_id", "residue_name", "seq_number",
        "insertion_code", "is_hetero", "atom_index", "atom_ord", "atom_id", "serial", "atom_name", "element",
        "x", "y", "z", "occupancy", "temp_factor",
    )


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue: ids, ordinals, atom count, centroid, mean B-factor."""
    keys = [
        "structure_id", "res_ord", "chain_index", "chain_id", "chain_label", "residue_index", "residue_id",
        "residue_name", "seq_number", "insertion_code", "is_hetero",
    ]
    return atoms.groupBy(*keys).agg(
        F.count("*").alias("atom_count"),
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.avg("z").alias("z"),
        F.avg("temp_factor").alias("bfactor_mean"),
    )
