"""Structure files as DataFrames: one task reads and parses many files, a bad file costs its own row only."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscale.shared import importable
from foldscale.sources.canonical import RAW_DDL, SEPARATOR, canonicalise
from foldscale.sources.formats import SUFFIXES, WALKED, ParseError, parse_bytes, structure_id

_COLUMNS = [c.split()[0] for c in RAW_DDL.split(", ")]


def parsed(batches, errors: bool):
    """A frame for every file, so that a task holds one file's atoms and one batch of contents (Spark bounds batches in
    bytes). A structure's key is its name and its path."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            error = None
            try:
                kind, title, found = parse_bytes(bytes(content), path)
            except ParseError as e:
                error = str(e)
            if errors:
                yield pd.DataFrame([(path, error is None, error)], columns=["path", "ok", "error"])
            elif error is None:
                atoms = pd.DataFrame(found)
                key = f"{structure_id(path)}{SEPARATOR}{path}"
                yield atoms.assign(structure_id=key, source_path=path, source_format=kind, title=title)[_COLUMNS]


#: Any case of the suffixes that a folder is searched for, as a file pattern.
_PATTERN = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in WALKED) + "}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of a file, or of all structure files below a folder (``.ent`` only when named itself); other
    files are not opened."""
    importable(spark)
    reader = spark.read.format("binaryFile")
    if not any(path.lower().endswith(s) for s in SUFFIXES):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", _PATTERN)
    return reader.load(path).select("path", "content")


def require_files(spark: SparkSession, path: str) -> None:
    """An error if there is nothing to read."""
    if files(spark, path).select("path").isEmpty():
        raise ValueError(f"no supported structures found under {path}")


def read_atoms(spark: SparkSession, path: str, keep_hetero: bool = True) -> DataFrame:
    """Canonical atoms of every readable file."""
    raw = files(spark, path).mapInPandas(functools.partial(parsed, errors=False), RAW_DDL)
    return canonicalise(raw, keep_hetero)


def parse_status(spark: SparkSession, path: str) -> DataFrame:
    """path, ok, error for every file."""
    return files(spark, path).mapInPandas(functools.partial(parsed, errors=True), "path string, ok boolean, error string")


def parse_text(spark: SparkSession, text: str, kind: str, path: str | None = None, keep_hetero: bool = True) -> DataFrame:
    """Canonical atoms of a text in memory; ``kind`` is pdb or mmcif."""
    name = path or f"structure.{'pdb' if kind == 'pdb' else 'cif'}"
    _, title, rows = parse_bytes(text.encode(), name)
    sid = structure_id(path) if path else "structure"
    data = [tuple({"structure_id": sid, "source_path": path, "source_format": kind, "title": title, **r}[c] for c in _COLUMNS) for r in rows]
    return canonicalise(spark.createDataFrame(data, RAW_DDL), keep_hetero)


def pdb_lines(lines: DataFrame) -> DataFrame:
    """Raw rows from ``lines(structure_id, line)`` of fixed-width records, in generated code without Python."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    number = lambda a, n, t: F.expr(f"try_cast(trim(substring(line, {a}, {n})) as {t})")
    record = cut(1, 6)
    name = cut(13, 4)
    return lines.where(record.isin("ATOM", "HETATM")).select(
        "structure_id", F.lit(None).cast("string").alias("source_path"), F.lit("pdb").alias("source_format"),
        F.lit(None).cast("string").alias("title"), F.substring("line", 22, 1).alias("chain"),
        F.coalesce(number(23, 4, "int"), F.lit(0)).alias("seq_number"), F.nullif(cut(27, 1), F.lit("")).alias("insertion_code"),
        (record == "HETATM").alias("is_hetero"), cut(18, 3).alias("residue_name"), number(7, 5, "int").alias("serial"),
        name.alias("atom_name"), F.nullif(cut(17, 1), F.lit("")).alias("alt_loc"),
        F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.substring(F.regexp_replace(name, "[^A-Za-z]", ""), 1, 1)).alias("element"),
        number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"),
        F.coalesce(number(55, 6, "double"), F.lit(1.0)).alias("occupancy"), F.coalesce(number(61, 6, "double"), F.lit(0.0)).alias("temp_factor"),
    )
