"""Embedding near-duplicates by sorted projection passes.

Each pass has 60 random hyperplanes; a vector's signs, most significant first, are its key, and sorting by
(pass, key) orders the vectors lexicographically by their concatenated hashes. All passes are one range sort.
In the sorted rows each vector is compared, exactly and in double precision, with the ``window`` rows after it;
rows at the borders of sorted partitions meet those of the next one in a small second step. Verified pairs are
united across passes into components, each reported as a star, in proportion to its members.

Windows are bounded, so they miss pairs, the more the larger and denser the table is. An exact step finds the rest, by
one rule for tables of all sizes: rows are dealt out to blocks of ``BUCKET_BYTES`` at most, each written to a file, and
every two blocks are compared in full, for links that join two of the sweep's components. So the result depends on
neither windows nor size; the step's work grows as the square of the number of different vectors (some 130
operations in single precision a pair at 64 dimensions), its disk as the table.

Equal vectors are one class from the start, with its size as weight, so a third of all rows that are copies cost no
pairs. Every component is dealt out as cells of two blocks and all its pairs are compared, so a vector's ``n_links``
counts all links inside its component, and no pair is sent anywhere.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing and are classes
of their own; vectors of different lengths never link; a null vec_id counts as one more id, the smallest; every row is a
vector, also where rows share a vec_id; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.graph import components
from foldscale.llm.runtime import (
    cells,
    column,
    groups,
    id_of,
    key_of,
    map_groups,
    map_rows,
    materialize,
    new_path,
    number,
    salted_join,
    schema_of,
    smallest_reachable,
    to_batch,
)
from foldscale.llm.token_store import qualified

BITS, BLOCK = 60, 512
#: Bytes of vectors in a block of the exact step.
BUCKET_BYTES = 1 << 22
_planes: dict = {}


def planes(dim: int, passes: int) -> np.ndarray:
    if (dim, passes) not in _planes:
        _planes[dim, passes] = np.random.default_rng(20_240_601 + dim).standard_normal((passes, BITS, dim))
    return _planes[dim, passes]


def usable(vector) -> np.ndarray | None:
    """The unit vector in double precision, or None."""
    if vector is None or not len(vector):
        return None
    if any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    scale = np.abs(v).max()
    if scale == 0:
        return None
    v = v / scale  # squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def _keyed(batch, passes):
    ids, vectors, dims, keys, parts = [], [], [], [], []
    by_dim: dict[int, list] = {}
    for k, v in zip(column(batch, "k").to_pylist(), column(batch, "embedding").to_pylist(), strict=True):
        u = usable(v)
        if u is not None:
            by_dim.setdefault(len(u), []).append((k, u))
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for dim, rows in by_dim.items():
        x = np.stack([u for _, u in rows])
        for p in range(passes):
            code = ((x @ planes(dim, passes)[p].T) > 0) @ weights
            ids += [k for k, _ in rows]
            vectors += [u.tobytes() for u in x]
            dims += [dim] * len(rows)
            parts += [p] * len(rows)
            keys.append(code)
    return [ids, dims, parts, np.concatenate(keys) if keys else np.zeros(0, np.int64), vectors]


def _stars(x: np.ndarray, ids: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each row and the ``window`` rows after it, as stars of their components."""
    n = len(ids)
    labels = ids.copy()
    left, right = [], []
    for a in range(0, n, window):
        near = x[a : a + 2 * window]
        hit = x[a : a + window] @ near.T >= threshold
        i, j = np.nonzero(hit)
        ok = (j > i) & (j - i <= window)
        left.append(i[ok] + a)
        right.append(j[ok] + a)
    i, j = np.concatenate(left), np.concatenate(right)
    while len(i):
        least = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, least)
        np.minimum.at(labels, j, least)
        if np.array_equal(before, labels):
            break
    linked = np.zeros(n, bool)
    linked[i] = linked[j] = True
    return ids[linked], labels[linked]


_FOUND = "a long, b long, part int, side int, dim int, pass int, at int, vector binary"


def _swept(batches, threshold, window, schema):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first, tail = True, None

    def border(side, dim, p, rows):
        n = len(rows["k"])
        return [rows["k"], rows["k"], np.full(n, part), np.full(n, side), np.full(n, dim), np.full(n, p), np.arange(n), rows["vector"]]

    for (dim, p), rows in _runs(batches, dim_window=window):
        x = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(-1, dim)
        a, b = _stars(x, rows["k"], threshold, window)
        if len(a):
            n = len(a)
            yield to_batch([a, b, *(np.full(n, -1) for _ in range(5)), pa.nulls(n, pa.binary())], schema)
        if first and rows["head"]:
            cut = {"k": rows["k"][:window], "vector": rows["vector"][:window]}
            yield to_batch(border(1, dim, p, cut), schema)
        first = False
        tail = (dim, p, {"k": rows["k"][-window:], "vector": rows["vector"][-window:]})
    if tail:
        yield to_batch(border(0, *tail), schema)


def _runs(batches, dim_window, most=16_384):
    """Sorted rows of a pass in bounded runs that overlap by a window."""
    held: dict | None = None
    for (dim, p), table in _split(batches):
        k, v = number(column(table, "k")), column(table, "vector").to_pylist()
        if held and held["key"] == (dim, p):
            k, v = np.concatenate((held["k"], k)), held["v"] + v
            head = held["head"]
        else:
            if held:
                yield held["key"], {"k": held["k"], "vector": held["v"], "head": held["head"]}
            head = True
        while len(k) > most:
            yield (dim, p), {"k": k[:most], "vector": v[:most], "head": head}
            k, v, head = k[most - dim_window :], v[most - dim_window :], False
        held = {"key": (dim, p), "k": k, "v": v, "head": head}
    if held:
        yield held["key"], {"k": held["k"], "vector": held["v"], "head": held["head"]}


def _split(batches):
    for batch in batches:
        yield from groups([batch], ["dim", "pass"])


def _met(key, rows, threshold, window):
    """The end of one sorted partition and the beginning of the next."""
    dims, passes, sides = number(column(rows, "dim")), number(column(rows, "pass")), number(column(rows, "side"))
    if len(np.unique(dims)) > 1 or len(np.unique(passes)) > 1 or len(np.unique(sides)) < 2:
        return None
    order = np.lexsort((number(column(rows, "at")), sides))
    raw = column(rows, "vector").to_pylist()
    x = np.frombuffer(b"".join(raw[i] for i in order), np.float64).reshape(-1, int(dims[0]))
    a, b = _stars(x, number(column(rows, "a"))[order], threshold, window)
    return [a, b] if len(a) else None


def _counted(key, rows, threshold):
    dim = number(column(rows, "dim"))
    ids, block, size = (number(column(rows, c)) for c in ("k", "block", "size"))
    x = np.frombuffer(b"".join(column(rows, "vector").to_pylist()), np.float64).reshape(-1, int(dim[0]))
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    if key[1] != key[2]:
        hit &= block[:, None] != block[None, :]
    n = np.rint(hit.astype(np.float64) @ size).astype(np.int64)
    return [ids[n > 0], n[n > 0]]


def _store_block(key, rows, uri):
    """A file with a block's labels and vectors; its name goes to the manifest."""
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    dim, block = int(key[0]), int(key[1])
    label, name = number(column(rows, "label")).astype("<i8"), f"{dim}-{block}"
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(label.tobytes())
        f.write(b"".join(column(rows, "vector").to_pylist()))
    fs.move(temporary, f"{root}/{name}")
    return [[dim], [block]]


def _read_block(dim, block, uri):
    """Labels, vectors, and the vectors in single precision."""
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{root}/{dim}-{block}") as f:
        raw = f.read()
    n = len(raw) // (8 * (dim + 1))
    x = np.frombuffer(raw, "<f8", n * dim, 8 * n).reshape(n, dim)
    return np.frombuffer(raw, "<i8", n), x, x.astype(np.float32)


def _joined_cells(batch, uri, threshold):
    """Which components the links of two blocks join."""
    out: list[list] = [[], []]
    for dim, i, j in zip(*(column(batch, c).to_pylist() for c in ("dim", "cell_i", "cell_j")), strict=True):
        left = _read_block(dim, i, uri)
        found = _joined_labels(left, left if i == j else _read_block(dim, j, uri), threshold)
        if found is not None:
            out[0].append(found[0])
            out[1].append(found[1])
    return [np.concatenate(c) for c in out] if out[0] else None


def _joined_labels(left, right, threshold, strip=512):
    """Which components the links between two blocks join, each with the smallest. Single precision sorts out most pairs,
    with room for its error; double precision decides."""
    names, own = np.unique(np.concatenate((left[0], right[0])), return_inverse=True)
    if len(names) < 2:
        return None
    own_left, own_right = own[: len(left[0])], own[len(left[0]) :]
    x, y, rough, slack = left[1], right[1], left[2], np.float32((left[1].shape[1] + 8) * 1.2e-7)
    root, other = np.arange(len(names)), right[2].T.copy()
    for a in range(0, len(x), strip):
        i, j = np.nonzero(rough[a : a + strip] @ other >= np.float32(threshold) - slack)
        i = a + i
        for c in range(0, len(i), 65_536):
            p, q = i[c : c + 65_536], j[c : c + 65_536]
            new = root[own_left[p]] != root[own_right[q]]
            p, q = p[new], q[new]
            sure = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            p, q = root[own_left[p[sure]]], root[own_right[q[sure]]]
            while (root[p] != root[q]).any():
                least = np.minimum(root[p], root[q])
                np.minimum.at(root, p, least)
                np.minimum.at(root, q, least)
            while (root != root[root]).any():
                root = root[root]
    moved = root != np.arange(len(names))
    return [names[moved], names[root[moved]]] if moved.any() else None


def unjoined(unit: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: components that a link joins, from all pairs of vectors of one length, whatever their number.

    A block is a file that the tasks of all its cells read, so that no vector is copied to them."""
    spark = unit.sparkSession
    uri = qualified(spark, new_path(spark, "vector-files"))
    rows = unit.select("k", "dim", "vector").join(labels, "k")
    fit = F.greatest(F.lit(64), F.floor(F.lit(BUCKET_BYTES) / (8 * F.col("dim"))))
    blocks = (
        rows.groupBy("dim")
        .agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
        .where("x != y")
        .select("dim", F.greatest(F.ceil(F.col("n") / fit), F.least(F.lit(8), F.ceil(F.col("n") / BLOCK))).cast("int").alias("blocks"))
    )
    dealt = rows.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    files = map_groups(dealt.select("dim", "block", "label", "vector"), ["dim", "block"], functools.partial(_store_block, uri=uri), "dim int, block int")
    files = materialize(files, "vector-blocks")
    other = F.broadcast(files.withColumnRenamed("block", "cell_j"))  # a row for 4 MB of vectors
    met = files.withColumnRenamed("block", "cell_i").join(other, "dim").where("cell_i <= cell_j")
    met = met.repartition(min(max(1, met.count()), 20_000))  # a task for each cell; each is much work
    return materialize(map_rows(met, functools.partial(_joined_cells, uri=uri, threshold=threshold), "a long, b long", 1), "vector-rest")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, passes: int = 8, window: int = 96
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at ``threshold`` or more), component_id (the smallest
    vec_id reachable), kept (``vec_id = component_id``)."""
    # rows are numbered in the order of their ids, so that the least number is the smallest vec_id; the digest and the
    # place in the input split an id that many rows share
    order = ["id", "h1", "h2", "r"]
    h1, h2 = F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(91), "embedding").alias("h2")
    none = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull())  # hashes pass over null components
    names = vectors.select(key_of("vec_id").alias("id"), h1, h2, F.monotonically_increasing_id().alias("r"), none.alias("none"))
    names = names.repartitionByRange(*order).sortWithinPartitions(*order).drop("r")
    names = materialize(names.withColumn("k", F.monotonically_increasing_id()), "vector-names")
    same = ["h1", "h2"]
    classes = materialize(names.where("not none").groupBy(*same).agg(F.min("k").alias("k"), F.count("*").alias("size")), "vector-classes")
    held = vectors.where(~none).select(h1, h2, "embedding").groupBy(*same).agg(F.first("embedding").alias("embedding"))
    one = materialize(held.join(classes, same).drop(*same), "vectors")
    keyed = map_rows(
        one,
        functools.partial(_keyed, passes=passes),
        "k long, dim int, pass int, code long, vector binary",
        2048,
    )
    fields, arrow = schema_of(_FOUND)
    found = materialize(
        keyed.repartitionByRange("dim", "pass", "code", "k")
        .sortWithinPartitions("dim", "pass", "code", "k")
        .mapInArrow(functools.partial(_swept, threshold=threshold, window=window, schema=arrow), fields),
        "sweeps",
    )
    ends = found.where("part >= 0").withColumn("seam", F.col("part") + 1 - F.col("side"))
    seams = map_groups(
        ends.select("seam", "side", "dim", "pass", "at", "a", "vector"),
        ["seam"],
        functools.partial(_met, threshold=threshold, window=window),
        "a long, b long",
    )
    edges = found.where("part < 0").select("a", "b").unionByName(seams)
    swept = components(edges, "vectors").select(F.col("node").alias("k"), "component")
    labels = materialize(
        one.select("k").join(swept, "k", "left").select("k", F.coalesce("component", "k").alias("label")), "vector-labels"
    )
    unit = materialize(map_rows(one, _unit, "k long, size long, dim int, vector binary", 2048), "vector-units")
    joins = components(unjoined(unit, labels, threshold), "vector-joins")
    whole = labels.join(joins, labels["label"] == joins["node"], "left").select(
        F.col("k").alias("node"), F.coalesce("component", "label").alias("component")
    )
    groups_found = materialize(whole, "vector-components")
    totals = groups_found.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    totals = totals.select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        groups_found.join(totals, "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(unit, F.col("node") == unit["k"])
    )
    counts = map_groups(
        cells(dealt, "block", "blocks").select("component", "cell_i", "cell_j", "k", "block", "size", "dim", "vector"),
        ["component", "cell_i", "cell_j"],
        functools.partial(_counted, threshold=threshold),
        "k long, n long",
    )
    links = counts.groupBy("k").agg(F.sum("n").alias("n_links"))
    # per class: its links, the smallest id it hangs together with; then the rows of the class
    ids = names.select(F.col("k").alias("component"), F.col("id").alias("smallest"))
    sizes = groups_found.groupBy("component").agg(F.count("*").alias("m"))
    labelled = salted_join(groups_found, materialize(ids.join(sizes, "component"), "vector-smallest"), ["component"], "m", "node")
    found = (
        labelled.select(F.col("node").alias("k"), "smallest")
        .join(unit.select("k", F.lit(True).alias("fine")), "k", "left")
        .join(links, "k", "left")
        .join(classes, "k")
        .select(*same, "size", "smallest", "fine", F.when(F.col("fine"), F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    rows = salted_join(names.where("not none"), materialize(found, "vector-links"), same, "size", "k")
    rows = rows.unionByName(names.where("none"), allowMissingColumns=True)
    smallest = F.when(F.col("fine"), F.col("smallest")).otherwise(F.col("id"))
    return rows.select(
        id_of("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        id_of(smallest).alias("component_id"),
        (smallest == F.col("id")).alias("kept"),
    )


def _unit(batch):
    out: list[list] = [[], [], [], []]
    for k, size, v in zip(*(column(batch, c).to_pylist() for c in ("k", "size", "embedding")), strict=True):
        u = usable(v)
        if u is not None:
            for c, x in zip(out, (k, size, len(u), u.tobytes()), strict=True):
                c.append(x)
    return out
