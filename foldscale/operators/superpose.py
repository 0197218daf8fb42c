"""Sequence alignment, superposition and comparison of structures."""

from __future__ import annotations

import contextlib
import functools
import math
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foldscale.functions.chemistry import BACKBONE, one_letter
from foldscale.shared import importable, stored
from foldscale.sources.canonical import SEPARATOR


class RmsdError(ValueError):
    """No identical aligned residues, unequal selections, or nothing selected."""


@dataclass(frozen=True)
class RmsdParams:
    atoms: str = "ca"
    align: bool = False
    local: bool = False


def global_pairs(a: str, b: str) -> list[tuple[int, int]]:
    """Needleman and Wunsch with +1, -1 and gap -1: aligned positions; diagonal before up before left.

    A row of the score table is a running maximum: left moves cost 1 a step, so the scan over ``score + column``
    replaces the inner loop.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    score = np.zeros((n + 1, m + 1), np.int64)
    column = np.arange(m + 1)
    score[0] = -column
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = -i
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], 1, -1), score[i - 1, 1:] - 1)
        score[i] = np.maximum.accumulate(best + column) - column
    out, i, j = [], n, m
    while i > 0 and j > 0:
        if score[i, j] == score[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def local_pairs(a: str, b: str) -> list[tuple[int, int]]:
    """Smith and Waterman with +2, -1 and gap -1, from the first greatest cell in row order."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    score = np.zeros((n + 1, m + 1), np.int64)
    column = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.zeros(m + 1, np.int64)
        best[1:] = np.maximum(np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], 2, -1), score[i - 1, 1:] - 1), 0)
        score[i] = np.maximum.accumulate(best + column) - column
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    out = []
    while i > 0 and j > 0 and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((int(i), int(j)))
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@dataclass(frozen=True)
class Superposition:
    rmsd: float
    rotation: np.ndarray
    translation: np.ndarray


def superpose(reference: np.ndarray, mobile: np.ndarray) -> Superposition:
    """Best rigid fit of ``mobile`` onto ``reference``: the largest eigenvalue of Horn's quaternion matrix."""
    if len(reference) != len(mobile):
        raise RmsdError(f"selections differ: {len(reference)} and {len(mobile)} atoms")
    if not len(reference):
        raise RmsdError("nothing to superpose")
    ca, cb = reference.mean(axis=0), mobile.mean(axis=0)
    p, q = mobile - cb, reference - ca
    s = p.T @ q
    xx, xy, xz, yx, yy, yz, zx, zy, zz = s.ravel()
    horn = np.array([
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ])
    values, vectors = np.linalg.eigh(horn)
    energy = (p * p).sum() + (q * q).sum()
    w, x, y, z = vectors[:, -1]
    rotation = np.array([
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ])
    return Superposition(float(np.sqrt(max(energy - 2 * values[-1], 0.0) / len(reference))), rotation, ca - rotation @ cb)


def profiles(atoms: DataFrame, params: RmsdParams) -> DataFrame:
    """Per structure what a comparison needs, in order: letters and coordinates of the first CA of each residue, or
    the coordinates of the selected atoms."""
    name, aligned = F.trim("atom_name"), params.align or params.local
    if aligned:
        rows = atoms.where(name == "CA").groupBy("structure_id", "res_ord").agg(F.min_by(F.struct("residue_name", "x", "y", "z"), "atom_index").alias("p"))
        rows = rows.select("structure_id", F.col("res_ord").cast("long").alias("o"), one_letter(F.col("p.residue_name")).alias("c"), "p.x", "p.y", "p.z")
    else:
        chosen = {"ca": name == "CA", "backbone": name.isin(*BACKBONE)}.get(params.atoms.lower(), F.lit(True))
        rows = atoms.where(chosen).select("structure_id", F.col("atom_ord").alias("o"), F.lit("X").alias("c"), "x", "y", "z")
    listed = F.array_sort(F.collect_list(F.struct("o", "c", "x", "y", "z")))
    every = atoms.select("structure_id").distinct()
    return every.join(rows.groupBy("structure_id").agg(listed.alias("p")), "structure_id", "left").select(
        "structure_id", F.concat_ws("", F.transform("p", lambda v: v["c"])).alias("letters"),
        *(F.coalesce(F.col(f"p.{c}"), F.array().cast("array<double>")).alias(c) for c in "xyz"),
    )


def compare_pair(letters_a: str, xyz_a: np.ndarray, letters_b: str, xyz_b: np.ndarray, params: RmsdParams) -> tuple[float, int, str]:
    """rmsd, atoms, selection; raises ``RmsdError``."""
    selection = params.atoms
    if params.align or params.local:
        found = (local_pairs if params.local else global_pairs)(letters_a, letters_b)
        same = [(i, j) for i, j in found if letters_a[i] == letters_b[j]]
        if not same:
            raise RmsdError("no matching residues")
        xyz_a, xyz_b = xyz_a[[i for i, _ in same]], xyz_b[[j for _, j in same]]
        selection = "local-ca" if params.local else "aligned-ca"
    return superpose(xyz_a, xyz_b).rmsd, len(xyz_a), selection


def _largest(horn_sums: np.ndarray) -> np.ndarray:
    """The largest eigenvalue of Horn's matrix for each of the 3 x 3 sums."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = horn_sums.reshape(-1, 9).T
    rows = [
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ]
    return np.linalg.eigvalsh(np.stack([np.stack(r, axis=-1) for r in rows], axis=-2))[:, -1]


def _fits(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The rmsd of all ``left`` with all ``right`` structures; NaN where selections differ, are empty or not finite."""
    out = np.full((len(left), len(right)), np.nan)
    sizes = [np.array([len(x) if np.isfinite(x).all() else -1 for x in xs], np.int64) for xs in (left, right)]
    for n in np.intersect1d(*sizes):
        if n <= 0:
            continue
        at = [np.flatnonzero(size == n) for size in sizes]
        a, b = (np.stack([xs[i] for i in k]) for xs, k in zip((left, right), at, strict=True))
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        sums = a.transpose(0, 2, 1).reshape(-1, n) @ b.transpose(1, 0, 2).reshape(n, -1)  # (a, axis) x (b, axis)
        sums = sums.reshape(len(a), 3, len(b), 3).transpose(0, 2, 3, 1)
        energy = (a * a).sum(axis=(1, 2))[:, None] + (b * b).sum(axis=(1, 2))
        best = _largest(sums).reshape(energy.shape)
        out[np.ix_(*at)] = np.sqrt(np.maximum(energy - 2 * best, 0.0) / n)
    return out


def _each(left, right, letters_left, letters_right, params):
    """As ``_fits``, with every pair aligned."""
    out = np.full((len(left), len(right)), np.nan)
    for i, (x, s) in enumerate(zip(left, letters_left, strict=True)):
        for j, (y, t) in enumerate(zip(right, letters_right, strict=True)):
            with contextlib.suppress(RmsdError):
                out[i, j] = compare_pair(s, x, t, y, params)[0]
    return out


def _profiles_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The coordinates of each row."""
    axes = [batch.column(batch.schema.get_field_index(c)) for c in "xyz"]
    ends = np.cumsum(axes[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = np.column_stack([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in axes])
    return np.split(flat, ends[:-1]) if len(ends) else []


def _cell(key: tuple[int, int], held: list[pa.RecordBatch], params: RmsdParams, pairs: int = 65_536):
    """All pairs of a cell: of one block's structures, or of two blocks'."""
    xyz = [x for b in held for x in _profiles_of(b)]
    rows = pa.Table.from_batches(held)
    own = rows["o"].to_numpy()
    ids, letters = rows["structure_id"].combine_chunks(), rows["letters"].to_pylist()
    rank = np.empty(len(own), np.int64)
    rank[np.array(sorted(range(len(own)), key=ids.to_pylist().__getitem__), np.int64)] = np.arange(len(own))
    left, right = (np.flatnonzero(own == k) for k in key)
    step = max(1, pairs // max(len(right), 1))
    for a in range(0, len(left), step):
        some = left[a : a + step]
        mine, others = [xyz[i] for i in some], [xyz[j] for j in right]
        if params.align or params.local:
            rmsd = _each(mine, others, [letters[i] for i in some], [letters[j] for j in right], params)
        else:
            rmsd = _fits(mine, others)
        i, j = (k.ravel() for k in np.meshgrid(some, right, indexing="ij"))
        keep = rank[i] < rank[j] if key[0] == key[1] else np.ones(len(i), bool)
        i, j, rmsd = i[keep], j[keep], rmsd.ravel()[keep]
        first = rank[i] < rank[j]
        names = [ids.take(pa.array(np.where(first, x, y))) for x, y in ((i, j), (j, i))]
        yield pa.RecordBatch.from_arrays([*names, pa.array(rmsd, mask=np.isnan(rmsd))], ["id_a", "id_b", "rmsd"])


def _compared(batches, params):
    """Cells of rows sorted by ``i`` and ``j``, one at a time."""
    key, held = None, []
    for batch in batches:
        i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "ij")
        begins = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(i) else []
        for a, b in zip(begins, [*begins[1:], len(i)], strict=True):
            if (now := (int(i[a]), int(j[a]))) != key:
                if held:
                    yield from _cell(key, held, params)
                key, held = now, []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _cell(key, held, params)


#: Structures, and bytes of coordinates, in a block of ``rmsd_pairs``.
BLOCK, BLOCK_BYTES = 1024, 1 << 24


def rmsd_pairs(atoms: DataFrame, params: RmsdParams | None = None, partitions: int | None = None) -> DataFrame:
    """All unordered pairs of structures with their rmsd (null where it is undefined).

    Every pair is the operator's result, so the pair count is its output; pairs are dealt over all tasks.
    """
    params = params or RmsdParams(align=True)
    spark = atoms.sparkSession
    importable(spark)
    p = stored(profiles(atoms, params), "profiles")
    # blocks of structures meet in cells (i <= j): each structure is copied once per block, each pair meets in one cell, and
    # a cell is compared as a whole, so that no pair ever carries its structures
    count, points = p.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = partitions or max(1, math.isqrt(tasks), -(-count // BLOCK), -(-24 * points // BLOCK_BYTES))
    dealt = p.withColumn("o", F.pmod(F.xxhash64("structure_id"), F.lit(blocks)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("o", "t").alias("i"), F.greatest("o", "t").alias("j"), "o", "structure_id", "letters", *"xyz")
    sorted_cells = dealt.repartition(tasks, "i", "j").sortWithinPartitions("i", "j")
    return sorted_cells.mapInArrow(functools.partial(_compared, params=params), "id_a string, id_b string, rmsd double")


def rmsd_matrix(atoms: DataFrame, params: RmsdParams | None = None, most: int = 5000) -> tuple[list[str], list[list[float | None]]]:
    """Names in the order of paths, and the symmetric matrix with zero diagonal: the report's own format, one document, so
    it is made on the driver and refused beyond ``most`` structures; ``rmsd_pairs`` has no such bound."""
    keys = atoms.groupBy("structure_id").agg(F.min("source_path").alias("path")).orderBy("path", "structure_id").limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"more than {most} structures: take rmsd_pairs")
    labels = [r["structure_id"].split(SEPARATOR)[0] for r in keys]
    place = {r["structure_id"]: i for i, r in enumerate(keys)}
    out: list[list[float | None]] = [[0.0 if i == j else None for j in range(len(labels))] for i in range(len(labels))]
    for r in rmsd_pairs(atoms, params).collect():
        i, j = place[r["id_a"]], place[r["id_b"]]
        out[i][j] = out[j][i] = r["rmsd"]
    return labels, out


def deltas(features: DataFrame, reference, fields: list[str] | None = None) -> DataFrame:
    """For every other structure: ``f``, ``reference_f`` and ``delta_f`` of the numeric fields. ``reference``: a row with
    structure_id and source_path."""
    numeric = [f.name for f in features.schema if f.dataType.typeName() in ("long", "integer", "double")]
    fields = sorted(set(fields)) if fields else sorted(numeric)
    for f in fields:
        if f not in numeric:
            raise ValueError(f"feature '{f}' is missing or not numeric")
    is_it = (F.col("structure_id") == reference["structure_id"]) & F.col("source_path").eqNullSafe(F.lit(reference["source_path"]))
    one = features.where(is_it).select(*(F.col(f).alias(f"reference_{f}") for f in fields)).limit(1)
    rest = features.where(~is_it)
    each = [x for f in fields for x in (F.col(f), F.col(f"reference_{f}"), (F.col(f) - F.col(f"reference_{f}")).alias(f"delta_{f}"))]
    return rest.crossJoin(F.broadcast(one)).select("structure_id", "source_path", *each)  # one row on the right


def pick_reference(features: DataFrame, path: str | None = None, by: tuple[str, str] | None = None, auto: bool = False) -> Row:
    """The reference's structure_id and source_path: by path, name, id or ``#index``; by the least or greatest field; by
    quality; the first."""
    shown = ["structure_id", "source_path"]
    order = features.orderBy("source_path", "structure_id")
    if path is not None:
        if re.fullmatch(r"#\d+", path):
            rows = order.select(*shown).limit(int(path[1:]) + 1).collect()
            if len(rows) <= int(path[1:]):
                raise ValueError(f"reference index {path} is out of range")
            return rows[-1]
        name = F.regexp_extract("source_path", r"([^/]+)$", 1)
        full = os.path.realpath(path) if os.path.exists(path) else path
        plain = F.regexp_replace("source_path", "^file:/+", "/")
        same = (F.col("source_path") == path) | (plain == full) | (name == path.rsplit("/", 1)[-1]) | (F.col("structure_id") == path)
        # a whole path before a name, which several files may share
        row = order.where(same).select(*shown, (plain == full).alias("exact")).orderBy(F.desc("exact"), *shown).first()
        if row is None:
            raise ValueError(f"unknown reference: {path}")
        return row
    if by is not None:
        field, way = by
        if way not in ("min", "max"):
            raise ValueError("reference direction must be min or max")
        if field not in features.columns:
            raise ValueError(f"feature '{field}' is missing or not numeric")
        key = F.col(field) if way == "min" else -F.col(field)
        return features.agg(F.min_by(F.struct(*shown), F.struct(key, "source_path", "structure_id"))).first()[0]
    if auto:
        key = F.struct("ramachandran_outlier_count", "clash_pair_count", "missing_backbone_residue_count", "source_path", "structure_id")
        return features.agg(F.min_by(F.struct(*shown), key)).first()[0]
    return order.select(*shown).first()
