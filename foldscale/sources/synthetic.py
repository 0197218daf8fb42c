"""Structures made from the ``orders`` table, so that operators and SQL can be compared on the driver's data.

300 atoms a structure, five a residue, twenty residues a chain; names, hetero flags and coordinates (thousandths of
an Angstrom as integers) follow from the order key and the customer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
SIDE = "CB NE OD1 OD2 SG OE1 OE2 O1 ND1 CG1 CG NZ SD CG CG OG OG1 CG CG CG1".split()
HETERO = {18: "HOH", 19: "HEM"}

# The same rows as SQL (DuckDB): a common table expression named ``atoms``.
ATOMS_SQL = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, o_orderkey // 300 AS s, o_orderkey % 300 AS w FROM orders),
placed AS (
  SELECT *, w // 5 AS r, w % 5 AS a, (w // 5) // 20 AS ch, (w // 5) % 20 AS ri,
    ((w // 5) * 7 + s) % 20 AS pick FROM base),
atoms AS (
  SELECT 's' || s AS structure_id, CAST(ch AS INTEGER) AS chain_index, chr(CAST(65 + ch AS INTEGER)) AS chain_label,
    CAST(r AS INTEGER) AS res_ord, CAST(ri AS INTEGER) AS residue_index, CAST(w AS BIGINT) AS atom_ord,
    CAST(ri + 1 AS INTEGER) AS seq_number, ri IN (18, 19) AS is_hetero,
    CASE ri WHEN 18 THEN 'HOH' WHEN 19 THEN 'HEM' ELSE {NAMES}[CAST(pick + 1 AS INTEGER)] END AS residue_name,
    CASE a WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O'
      ELSE (CASE WHEN ri IN (18, 19) THEN 'C1' ELSE {SIDE}[CAST(pick + 1 AS INTEGER)] END) END AS atom_name,
    ((r % 4) * 4200 + a * 1100 + (c * 7919) % 997) / 1000.0::DOUBLE AS x,
    (((r // 4) % 4) * 4200 + (a * a * 700) % 2900 + (c * 104729) % 997) / 1000.0::DOUBLE AS y,
    ((r // 16) * 4200 + (a * 1900) % 3100 + (c * 1299709) % 997) / 1000.0::DOUBLE AS z,
    price AS temp_factor FROM placed),
ids AS (
  SELECT *, left(atom_name, 1) AS element, structure_id || ':' || chain_label AS chain_id,
    structure_id || ':' || chain_label || ':' || seq_number || ':_' AS residue_id FROM atoms)
"""


def atoms_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("price")
    )
    k, c = F.col("k"), F.col("c")
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    w = k % 300
    o = o.withColumns({"s": div(k, 300), "w": w, "r": div(w, 5), "a": w % 5})
    o = o.withColumns({"ch": div(F.col("r"), 20), "ri": F.col("r") % 20, "pick": (F.col("r") * 7 + F.col("s")) % 20})
    r, a, ri = F.col("r"), F.col("a"), F.col("ri")
    pick = (F.col("pick") + 1).cast("int")
    name = F.when(ri == 18, "HOH").when(ri == 19, "HEM").otherwise(F.element_at(F.array(*map(F.lit, NAMES)), pick))
    side = F.when(ri >= 18, "C1").otherwise(F.element_at(F.array(*map(F.lit, SIDE)), pick))
    atom = F.when(a == 0, "N").when(a == 1, "CA").when(a == 2, "C").when(a == 3, "O").otherwise(side)
    x = (r % 4) * 4200 + a * 1100 + (c * 7919) % 997
    y = (div(r, 4) % 4) * 4200 + (a * a * 700) % 2900 + (c * 104729) % 997
    z = div(r, 16) * 4200 + (a * 1900) % 3100 + (c * 1299709) % 997
    milli = lambda v: v.cast("double") / F.lit(1000.0)
    sid = F.concat(F.lit("s"), F.col("s").cast("string"))
    label = F.char(F.col("ch") + 65)
    seq = (ri + 1).cast("int")
    rows = o.select(
        sid.alias("structure_id"), F.lit(None).cast("string").alias("source_path"), F.col("ch").cast("int").alias("chain_index"),
        F.concat_ws(":", sid, label).alias("chain_id"), label.alias("chain_label"), ri.cast("int").alias("residue_index"),
        r.cast("int").alias("res_ord"), F.concat_ws(":", sid, label, seq.cast("string"), F.lit("_")).alias("residue_id"),
        name.alias("residue_name"), seq.alias("seq_number"), F.lit(None).cast("string").alias("insertion_code"),
        (ri >= 18).alias("is_hetero"), a.cast("int").alias("atom_index"), F.col("w").alias("atom_ord"), atom.alias("atom_name"),
        F.substring(atom, 1, 1).alias("element"), milli(x).alias("x"), milli(y).alias("y"), milli(z).alias("z"),
        F.lit(1.0).alias("occupancy"), F.col("price").alias("temp_factor"), (F.col("w") + 1).cast("int").alias("serial"),
    )
    return rows.withColumn("atom_id", F.concat_ws(":", "residue_id", F.col("atom_index").cast("string"), "atom_name"))


def thinned(atoms: DataFrame) -> DataFrame:
    """Structures with a thirteenth of their atoms left out."""
    return atoms.where((F.col("atom_ord") * 7 + F.substring("structure_id", 2, 20).cast("long")) % 13 != 0)


def _keyed(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, Column, Column]:
    """Orders with the structure number and the place in structures of ``size``."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.withColumns({"s": F.floor(F.col("k") / F.lit(size)).cast("long"), "w": F.col("k") % size}), F.col("w"), F.col("c")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def lattice_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of structures of 30,000 atoms about a cubic lattice."""
    o, w, c = _keyed(spark, sf_dir, 30_000)
    at = {"x": w % 31 * 3000 + (c * 7919) % 997, "y": _div(w, 31) % 31 * 3000 + (c * 104729) % 997, "z": _div(w, 961) * 3000 + (c * 1299709) % 997}
    sid = F.concat(F.lit("g"), F.col("s").cast("string")).alias("structure_id")
    return o.select(sid, w.alias("atom_ord"), *((v.cast("double") / F.lit(1000.0)).alias(n) for n, v in at.items()))


def altloc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as parsers give them, with alternate locations, insertion codes, a blank chain and hetero residues."""
    o, w, c = _keyed(spark, sf_dir, 240)
    r, a = _div(w, 8), (w % 8).cast("int")
    none = lambda t: F.lit(None).cast(t)
    chain = F.when(r < 10, "B").when(r < 20, "A").otherwise(" ")
    alt = F.when(a.isin(4, 6), "A").when(a.isin(5, 7), "B").otherwise(none("string"))
    name = F.element_at(F.array(*map(F.lit, "N CA C O CB CB CG CG".split())), a + 1)
    return o.where(c % 7 != 3).select(
        F.concat(F.lit("v"), F.col("s").cast("string")).alias("structure_id"), none("string").alias("source_path"), F.lit("pdb").alias("source_format"), none("string").alias("title"),
        chain.alias("chain"), _div(r, 2).cast("int").alias("seq_number"), F.when(r % 2 == 1, "A").otherwise(" ").alias("insertion_code"), (r % 10 == 9).alias("is_hetero"), F.lit("ALA").alias("residue_name"),
        (a + 1).cast("int").alias("serial"), name.alias("atom_name"), alt.alias("alt_loc"), none("string").alias("element"), (c / F.lit(8.0)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
        ((c * 7919) % 3 / F.lit(4.0)).alias("occupancy"), F.lit(0.0).alias("temp_factor"),
    )


def ring_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of aromatic and basic residues of ten atoms each, so that ring interactions occur."""
    o, w, c = _keyed(spark, sf_dir, 600)
    r, a = _div(w, 10), (w % 10).cast("int")
    names = F.array(*map(F.lit, ("PHE", "TYR", "LYS", "TRP")))
    atoms = {0: "N CA C O CG CD1 CD2 CE1 CE2 CZ", 2: "N CA C O CB CG CD CE NZ HZ", 3: "N CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2"}
    listed = {k: F.array(*map(F.lit, v.split())) for k, v in atoms.items()}
    atom = F.element_at(F.when(r % 4 == 2, listed[2]).when(r % 4 == 3, listed[3]).otherwise(listed[0]), a + 1)
    at = {"x": (r % 4) * 3900 + a * 350 + (c * 7919) % 397, "y": (_div(r, 4) % 4) * 3900 + (a * a * 310) % 1700, "z": _div(r, 16) * 3900 + (a * 700) % 1900 + (c * 104729) % 397}
    sid = F.concat(F.lit("t"), F.col("s").cast("string"))
    return o.select(
        sid.alias("structure_id"), F.lit(0).alias("chain_index"), r.cast("int").alias("res_ord"), r.cast("int").alias("residue_index"),
        F.concat_ws(":", sid, F.lit("A"), r.cast("string"), F.lit("_")).alias("residue_id"), F.element_at(names, (r % 4 + 1).cast("int")).alias("residue_name"), atom.alias("atom_name"),
        w.alias("atom_ord"), F.concat_ws(":", sid, F.lit("A"), r.cast("string"), F.lit("_"), a.cast("string"), atom).alias("atom_id"),
        *((v.cast("double") / F.lit(1000.0)).alias(n) for n, v in at.items()),
    )
