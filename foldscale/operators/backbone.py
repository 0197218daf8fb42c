"""Backbone torsions, Ramachandran classes and secondary structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldscale.functions.geometry import distance, dot, sub, torsion, xyz
from foldscale.operators.spatial import cross_pairs
from foldscale.shared import joined, stored
from foldscale.sources.canonical import residues

_ID = ["structure_id", "res_ord", "chain_index", "chain_id", "residue_index", "residue_name", "seq_number"]


def backbone(atoms: DataFrame) -> DataFrame:
    """One row per residue with its first N, CA, C and O as structs (null where missing)."""
    point = F.struct("x", "y", "z")
    pick = [F.min_by(F.when(F.col("atom_name") == n, point), F.when(F.col("atom_name") == n, F.col("atom_index"))).alias(n) for n in ("N", "CA", "C", "O")]
    return atoms.groupBy(*_ID).agg(*pick)


def dihedrals(atoms: DataFrame) -> DataFrame:
    """phi, psi and omega from the neighbours in the chain's residue list; gaps are not looked at."""
    by = Window.partitionBy("structure_id", "chain_index").orderBy("residue_index")
    b = (
        backbone(atoms)
        .withColumn("pC", F.lag("C").over(by))
        .withColumn("pCA", F.lag("CA").over(by))
        .withColumn("nN", F.lead("N").over(by))
    )
    n, ca, c = xyz("N"), xyz("CA"), xyz("C")
    return b.select(
        *_ID,
        torsion(xyz("pC"), n, ca, c).alias("phi"),
        torsion(n, ca, c, xyz("nN")).alias("psi"),
        torsion(xyz("pCA"), xyz("pC"), n, ca).alias("omega"),
    )


def hydrogen_bonds(atoms: DataFrame, grid: bool | None = None) -> DataFrame:
    """Backbone bonds (Kabsch and Sander 1983): CO of residue ``i`` with NH of residue ``j``, energy below -0.5."""
    by = Window.partitionBy("structure_id", "chain_index").orderBy("residue_index")
    b = backbone(atoms).withColumn("pC", F.lag("C").over(by)).withColumn("pO", F.lag("O").over(by))
    b = stored(b, "backbone")  # read by six scans below
    d = sub(xyz("pC"), xyz("pO"))
    length = F.sqrt(dot(d, d))
    h = [(p + q / F.when(length > 1e-6, length)).alias(c) for c, p, q in zip("xyz", xyz("N"), d, strict=True)]
    donors = (
        b.where((F.trim("residue_name") != "PRO") & F.col("N").isNotNull() & F.col("pC").isNotNull() & F.col("pO").isNotNull())
        .where(length > 1e-6)
        .select("structure_id", F.col("res_ord").alias("j"), F.col("N").alias("n"), F.struct(*h).alias("h"), F.col("CA").alias("ca_j"))
    )
    acceptors = b.where("C is not null and O is not null").select(
        "structure_id", F.col("res_ord").alias("i"), F.col("C").alias("c"), F.col("O").alias("o"), F.col("CA").alias("ca_i")
    )
    place = lambda df, ca: df.where(f"{ca} is not null").select("*", f"{ca}.x", f"{ca}.y", f"{ca}.z")
    names = ["structure_id", "i", "c", "o", "j", "n", "h"]
    near = cross_pairs(place(acceptors, "ca_i"), place(donors, "ca_j"), 9.0, grid)
    near = near.select("structure_id", *(F.col(f"{c}_{s}").alias(c) for c, s in zip("icojnh", "aaabbb", strict=True)))
    # residues without CA meet all others: few, if any
    for x, y in ((acceptors.where("ca_i is null"), donors), (acceptors.where("ca_i is not null"), donors.where("ca_j is null"))):
        near = near.unionByName(joined(x, y, "structure_id").select(*names))
    on, ch = distance(xyz("o"), xyz("n")), distance(xyz("c"), xyz("h"))
    oh, cn = distance(xyz("o"), xyz("h")), distance(xyz("c"), xyz("n"))
    apart = (on >= 1e-3) & (ch >= 1e-3) & (oh >= 1e-3) & (cn >= 1e-3)
    inv = lambda r: F.lit(1.0) / F.when(r >= 1e-3, r)
    energy = 27.888 * (inv(on) + inv(ch) - inv(oh) - inv(cn))
    return near.where((F.col("i") != F.col("j")) & apart & (energy < -0.5)).select("structure_id", "i", "j")


def secondary_structure(atoms: DataFrame) -> DataFrame:
    """A state per residue (H, G, I helix; E strand; C coil): turns are flags of residues and offsets in their order,
    bridges two joins of the bond table with itself."""
    hb = stored(hydrogen_bonds(atoms), "bonds")
    columns = ["structure_id", "res_ord", "chain_index", "residue_name", "residue_id", "chain_id", "residue_index"]
    turns = ((4, 5), (3, 3), (5, 2))  # bonds i -> i + n, and the rank of their helix
    flags = hb.groupBy("structure_id", F.col("i").alias("res_ord")).agg(*(F.max(F.col("j") == F.col("i") + n).alias(f"t{n}") for n, _ in turns))
    by = Window.partitionBy("structure_id").orderBy("res_ord")
    beside = lambda k: (F.lead("res_ord", k).over(by) == F.col("res_ord") + k, F.lead("chain_index", k).over(by))
    (before, first), (after, last) = beside(-1), beside(1)
    place = joined(residues(atoms).select(*columns), flags, ["structure_id", "res_ord"], "left")
    middle = F.coalesce(before & after & (first == F.col("chain_index")) & (last == F.col("chain_index")), F.lit(False))
    helix = []
    for n, _ in turns:  # two turns in a row, i - 1 -> i - 1 + n and i -> i + n, in one chain
        there, end = beside(n)
        helix.append(F.coalesce(F.col(f"t{n}") & F.lag(f"t{n}").over(by) & before & there & (first == end), F.lit(False)).alias(f"h{n}"))
    chain = stored(place.select(*columns, middle.alias("middle"), *helix), "residues")
    # bridges between x and y, and which of them must lie inside a chain
    p, q = hb.select("structure_id", "i", "j"), hb.select("structure_id", F.col("i").alias("k"), F.col("j").alias("l"))
    two = joined(p, q.withColumn("j", F.col("k")), ["structure_id", "j"])  # i -> j -> l
    side = two.where("l = i or l = i + 2").select("structure_id", F.when(F.col("l") == F.col("i"), F.col("i")).otherwise(F.col("i") + 1).alias("x"), F.col("j").alias("y"), (F.col("l") != F.col("i")).alias("in_x"), F.lit(False).alias("in_y"))
    wide = joined(p, q.select("structure_id", (F.col("k") + 2).alias("j"), (F.col("l") - 2).alias("i")), ["structure_id", "i", "j"])
    wide = wide.select("structure_id", (F.col("i") + 1).alias("x"), (F.col("j") - 1).alias("y"), F.lit(True).alias("in_x"), F.lit(True).alias("in_y"))
    found = side.unionByName(wide)
    for c in ("x", "y"):
        found = joined(found, chain.select("structure_id", F.col("res_ord").alias(c), F.col("chain_index").alias(f"chain_{c}"), F.col("middle").alias(f"middle_{c}")), ["structure_id", c])
    found = found.where("(middle_x or not in_x) and (middle_y or not in_y) and x != y and (chain_x != chain_y or abs(x - y) > 2)")
    strands = found.select("structure_id", F.explode(F.array("x", "y")).alias("res_ord")).distinct().withColumn("strand", F.lit(True))
    state = [F.max(f"h{n}").over(by.rangeBetween(1 - n, 0)) for n, _ in turns]
    state = F.when(state[0], "H").when(F.col("strand"), "E").when(state[1], "G").when(state[2], "I").otherwise("C")
    return joined(chain, strands, ["structure_id", "res_ord"], "left").select(*columns, state.alias("secondary_structure"))


def chain_strings(atoms: DataFrame) -> DataFrame:
    """One string of states per chain."""
    ordered = F.array_sort(F.collect_list(F.struct("residue_index", "secondary_structure")))
    return secondary_structure(atoms).groupBy("structure_id", "chain_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["secondary_structure"])).alias("ss"))
