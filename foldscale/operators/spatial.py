"""Distance joins and kernels over groups of points.

Catalyst has no equi-key for a distance but the structure, under which a distance predicate is quadratic; a grid gives
it one. Points fall into cells of twice the cutoff, the right side is dealt out to the cells that a ball of the cutoff
around it meets (8 at most, 3.4 on average), and the join is on (structure, cell) with the distance as residual
predicate. Work is proportional to points times neighbours for structures of any size, large ones spread over all
tasks, and no structure has to be counted first. ``grid=False`` joins on the structure alone, for comparison.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscale.shared import importable, joined

AXES = ("x", "y", "z")
#: Edge of the cubes that kernels work on, in Angstrom: some 90,000 atoms of protein at most.
CUBE = 96.0


def _named(df: DataFrame, suffix: str, keep: str = "structure_id") -> DataFrame:
    return df.select(keep, *(F.col(c).alias(c + suffix) for c in df.columns if c != keep))


def _cells(value: Column, reach: float, width: float) -> Column:
    """The cells that ``value`` lies within ``reach`` of (a little more, so that rounding loses none)."""
    reach = reach * (1 + 1e-9) + 1e-9
    return F.explode(F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width)))


def cross_pairs(left: DataFrame, right: DataFrame, cutoff: float, grid: bool | None = None) -> DataFrame:
    """Pairs within ``cutoff`` (inclusive) of one structure; columns end in ``_a`` and ``_b``, and ``distance``."""
    a, b, keys = _named(left, "_a"), _named(right, "_b"), ["structure_id"]
    if grid is not False:
        width = 2.0 * cutoff
        a = a.withColumns({f"_c{c}": F.floor(F.col(f"{c}_a") / width) for c in AXES})
        for c in AXES:
            b = b.withColumn(f"_c{c}", _cells(F.col(f"{c}_b"), cutoff, width))
        keys += [f"_c{c}" for c in AXES]
    dx, dy, dz = (F.col(f"{c}_a") - F.col(f"{c}_b") for c in AXES)
    out = joined(a, b, keys).withColumn("distance", F.sqrt(dx * dx + dy * dy + dz * dz)).where(F.col("distance") <= cutoff)
    return out.drop(*keys[1:])


def self_pairs(points: DataFrame, cutoff: float, order: str = "atom_ord", grid: bool | None = None) -> DataFrame:
    """Unordered pairs of different points, the one with the smaller ``order`` as ``_a``."""
    return cross_pairs(points, points, cutoff, grid).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def cubes(points: DataFrame, reach: float) -> DataFrame:
    """Points dealt out to cubes of space with all that is within ``reach`` of them: ``cube_x``, ``cube_y``, ``cube_z``, and
    ``own`` where the point lies in the cube itself. A group (structure, cube) is bounded however large the structure."""
    own = F.lit(True)
    for c in AXES:
        shifted = F.col(c) + CUBE / 2  # structures about the origin are one cube
        points = points.withColumn(f"cube_{c}", _cells(shifted, reach, CUBE))
        own &= F.col(f"cube_{c}") == F.floor(shifted / CUBE)
    return points.withColumn("own", own)


def map_blocks(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], ddl: str, rows: int = 16_384) -> DataFrame:
    """``kernel(rows, group numbers)`` over runs of whole groups of about ``rows`` rows, so that small groups cost no call each.

    Groups are dealt out by their keys and streamed in order; a partition may hold any number of them.
    """
    spark = df.sparkSession
    importable(spark)
    # a stated number: adaptive execution would join small partitions, whose kernels may still have much to do
    spread = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return spread.mapInPandas(functools.partial(_blocks, keys=keys, kernel=kernel, rows=rows), ddl)


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str], kernel, rows: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        block, begins = _begins(held, keys)
        last = int(np.flatnonzero(begins)[-1])
        if last:
            yield kernel(block.iloc[:last], np.cumsum(begins[:last]) - 1)
        held = [block.iloc[last:]]
        size = len(held[0])
    if size:
        block, begins = _begins(held, keys)
        yield kernel(block, np.cumsum(begins) - 1)


def _begins(held: list[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows as one frame, and where groups begin in it."""
    block = pd.concat(held, ignore_index=True)
    begins = np.zeros(len(block), bool)
    begins[:1] = True
    for k in keys:
        v = block[k].to_numpy()
        begins[1:] |= v[1:] != v[:-1]
    return block, begins


def neighbours(xyz: np.ndarray, cutoff: float, group: np.ndarray, only: np.ndarray, block: int = 2048):
    """For runs of the points ``only``: (points, i, j, difference, squared distance), where ``i`` numbers the run's points in
    order and ``j`` is another point of the same group within ``cutoff``.

    A cell list over sorted cell numbers: three cells in a row are one range, so a point takes nine searches.
    """
    cell = np.floor(xyz / cutoff).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    cell -= np.repeat(np.minimum.reduceat(cell, start, axis=0), np.diff([*start, len(xyz)]), axis=0) - 1
    wide = cell.max(axis=0) + 2
    key = ((group * wide[0] + cell[:, 0]) * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys, at = key[order], order[only[order]]
    for a in range(0, len(at), block):
        here = at[a : a + block]
        left, right = [], []
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                want = key[here] + (dx * wide[1] + dy) * wide[2]
                lo = np.searchsorted(keys, want - 1, "left")
                n = np.searchsorted(keys, want + 1, "right") - lo
                left.append(np.repeat(np.arange(len(here)), n))
                right.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        i, j = np.concatenate(left), np.concatenate(right)
        d = xyz[here[i]] - xyz[j]
        square = (d * d).sum(axis=1)
        near = np.flatnonzero((square <= cutoff * cutoff) & (here[i] != j))
        near = near[np.argsort(i[near], kind="stable")]
        yield here, i[near], j[near], d[near], square[near]
