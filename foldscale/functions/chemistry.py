"""Chemistry as column expressions: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Van der Waals radii in Angstrom (Bondi); other elements count as 1.70.
VDW_RADII = {
    "H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98,
}
DEFAULT_RADIUS = 1.70
# Theoretical maximum accessible areas in square Angstrom (Tien et al. 2013).
MAX_AREAS = {
    "ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLU": 223.0, "GLN": 225.0, "GLY": 104.0,
    "HIS": 224.0, "ILE": 197.0, "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0,
    "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0,
}
# One-letter codes.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V",
}
# Names that are no ligands (waters and ions).
NOT_LIGANDS = (
    "HOH", "WAT", "DOD", "NA", "CL", "MG", "ZN", "CA", "K", "FE", "MN", "CU", "CO", "CD", "NI", "SR", "BA", "CS",
    "RB", "LI", "IOD",
)
# Residues whose model quality is judged: the twenty and common modifications.
QUALITY_RESIDUES = (*ONE_LETTER, "MSE", "SEP", "TPO", "PTR", "HYP", "CSO", "CME", "KCX", "LLY", "MHO")
# Hydrophobic residues, charged atoms, and the atoms of the backbone.
HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "PRO", "MET", "PHE", "TYR", "TRP")
ACIDIC_OXYGENS = ("ASP OD1", "ASP OD2", "GLU OE1", "GLU OE2")
BASIC_NITROGENS = ("LYS NZ", "ARG NH1", "ARG NH2", "ARG NE", "HIS ND1", "HIS NE2")
BACKBONE = ("N", "CA", "C", "O")


def _lookup(column: Column, table: dict, default=None) -> Column:
    key = F.upper(F.trim(column))
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def vdw_radius(element: Column) -> Column:
    return _lookup(F.coalesce(element, F.lit("")), VDW_RADII, DEFAULT_RADIUS)


def max_area(residue_name: Column) -> Column:
    return _lookup(residue_name, MAX_AREAS)


def one_letter(residue_name: Column) -> Column:
    return _lookup(residue_name, ONE_LETTER, "X")


def is_heavy(element: Column, name: Column) -> Column:
    return F.when(element.isNotNull(), F.upper(F.trim(element)) != "H").otherwise(~F.trim(name).startswith("H"))


def is_ligand_carbon(element: Column, name: Column) -> Column:
    return F.when(element.isNotNull(), F.upper(F.trim(element)) == "C").otherwise(F.trim(name).startswith("C"))


def is_acidic_oxygen(residue: Column, name: Column) -> Column:
    return F.concat_ws(" ", residue, name).isin(*ACIDIC_OXYGENS)


def is_basic_nitrogen(residue: Column, name: Column) -> Column:
    return F.concat_ws(" ", residue, name).isin(*BASIC_NITROGENS)


def is_hydrophobic_carbon(residue: Column, name: Column) -> Column:
    return F.trim(residue).isin(*HYDROPHOBIC) & F.trim(name).startswith("C") & ~F.trim(name).isin("C", "CA")


def is_hydrogen_bond(a: Column, b: Column, distance: Column) -> Column:
    polar = lambda n: F.substring(n, 1, 1).isin("N", "O")
    return polar(a) & polar(b) & distance.between(2.4, 3.5)


def is_salt_bridge(res_a: Column, a: Column, res_b: Column, b: Column, distance: Column) -> Column:
    return (
        (is_acidic_oxygen(res_a, a) & is_basic_nitrogen(res_b, b))
        | (is_acidic_oxygen(res_b, b) & is_basic_nitrogen(res_a, a))
    ) & (distance < 4.0)


class LigandFilter:
    """Which hetero residues are ligands: all but waters, ions and ``exclude``, or only ``include``."""

    def __init__(self, include: list[str] | None = None, exclude: list[str] | None = None):
        self.include = [x.strip().upper() for x in include or [] if x.strip()]
        self.exclude = [] if self.include else [x.strip().upper() for x in exclude or [] if x.strip()]

    def column(self, is_hetero: Column, residue_name: Column) -> Column:
        name = F.upper(F.trim(residue_name))
        if self.include:
            return is_hetero & name.isin(*self.include)
        return is_hetero & ~name.isin(*NOT_LIGANDS, *self.exclude)


def ramachandran(phi: Column, psi: Column, residue_name: Column) -> Column:
    """favored, allowed or outlier; half-open rectangles of the (phi, psi) plane in degrees (fixed values)."""

    def within(*boxes):
        out = F.lit(False)
        for x0, x1, y0, y1 in boxes:
            out = out | ((phi >= x0) & (phi < x1) & (psi >= y0) & (psi < y1))
        return out

    name = F.upper(F.trim(residue_name))
    helix, square = (-150.0, -33.0, -78.0, -12.0), (-180.0, 180.0, -180.0, 180.0)
    favored = (
        F.when(name == "GLY", within(helix, (-180.0, -60.0, 30.0, 180.0)))
        .when(name == "PRO", within((-100.0, -30.0, -30.0, 180.0)))
        .otherwise(within(helix, (-180.0, -90.0, 110.0, 180.0), (90.0, 180.0, 110.0, 180.0)))
    )
    allowed = F.when(
        name == "GLY", within((-180.0, 180.0, -180.0, 80.0), (-180.0, -60.0, 80.0, 180.0))
    ).otherwise(within(square))
    known = phi.isNotNull() & psi.isNotNull()
    return F.when(known & favored, "favored").when(known & allowed, "allowed").when(known, "outlier")
