"""Run-time helpers shared by the operators: lineage cuts, bounded groups, table access."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Stands for a null id inside the operators, which join and sort on ids.
NULL_ID = -(2**63)
#: Rows that a Python kernel turns into Python objects at a time.
SLICE_ROWS = 512
#: Characters that a kernel holds in work arrays at a time; longer texts are worked on in segments.
SLICE_CHARS = 400_000

_written: list[str] = []
#: Called in a worker when a task of ``map_rows`` ends: workers live on, so caches are cut back here.
at_task_end: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the folder may be in any store)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session does not set it, a local session (tests) gets a temporary folder; a cluster gets an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="foldscale-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs a re-read, never the steps before.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what this session's operators wrote; frames that still read it must be done by then."""
    context = spark.sparkContext
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (null matches null)."""
    key = fresh(docs, "_k")
    gone = ids.select(key_of("doc_id").alias(key)).distinct()
    return docs.withColumn(key, key_of("doc_id")).join(gone, key, "left_anti").drop(key)


def key_of(column: str | Column) -> Column:
    """A non-null key for an id column."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")


def id_of(column: str | Column) -> Column:
    """The id for a key."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != F.lit(NULL_ID), column)


def schema_of(ddl: str) -> tuple[T.StructType, pa.Schema]:
    fields = T.StructType.fromDDL(ddl)
    return fields, to_arrow_schema(fields)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, kernel: Callable, ddl: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``kernel(record_batch) -> list of columns`` over small slices of each Arrow batch."""
    fields, arrow = schema_of(ddl)
    return df.mapInArrow(functools.partial(_run_rows, kernel=kernel, schema=arrow, rows=rows), fields)


def _run_rows(batches, kernel, schema, rows):
    try:
        for batch in sliced(batches, rows):
            columns = kernel(batch)
            if columns is not None:
                yield to_batch(columns, schema)
    finally:
        task_ended()


def task_ended() -> None:
    for f in at_task_end:
        f()


def to_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def map_groups(df: DataFrame, keys: list[str], kernel: Callable, ddl: str, partitions: int | None = None) -> DataFrame:
    """``kernel(key, table) -> list of columns or None`` for every group of equal keys.

    Groups are sorted together inside partitions and streamed, so a partition may hold any number of
    groups; callers see to it that each group is bounded.
    """
    fields, arrow = schema_of(ddl)
    # a stated number: adaptive execution would join small partitions, whose kernels may still have much to do
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(partitions, *keys)
    run = functools.partial(_run_groups, keys=keys, kernel=kernel, schema=arrow)
    return spread.sortWithinPartitions(*keys).mapInArrow(run, fields)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    held_key: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield held_key, pa.Table.from_batches(held)


def _run_groups(batches, keys, kernel, schema, flush=8192):
    ready: list[list] = []
    count = 0
    for key, rows in groups(batches, keys):
        columns = kernel(key, rows)
        if columns is None or not len(columns[0]):
            continue
        ready.append(columns)
        count += len(columns[0])
        if count >= flush:
            yield to_batch(_joined(ready), schema)
            ready, count = [], 0
    if ready:
        yield to_batch(_joined(ready), schema)


def _joined(parts: list[list]) -> list:
    if len(parts) == 1:
        return parts[0]
    return [
        np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for piece in c for x in piece]
        for c in zip(*parts, strict=True)
    ]


def number(array: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.to_numpy(zero_copy_only=False)


def column(batch: pa.RecordBatch | pa.Table, name: str):
    return batch.column(batch.schema.get_field_index(name))


def matrix(array: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """Binary values of equal width as rows of a matrix."""
    return np.frombuffer(b"".join(array.to_pylist()), dtype).reshape(-1, width)


def cells(df: DataFrame, block: str, blocks: str) -> DataFrame:
    """Deal the rows of a group out to all unordered pairs of its blocks, as columns ``cell_i <= cell_j``.

    Every pair of rows meets in exactly one cell: rows of different blocks in that of both blocks, rows of
    one block in the diagonal cell. A group of one block is one cell.
    """
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return (
        df.withColumn("_other", other)
        .withColumn("cell_i", F.least(F.col(block), F.col("_other")))
        .withColumn("cell_j", F.greatest(F.col(block), F.col("_other")))
        .drop("_other")
    )


def bit_words(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of ``2 ** bits`` bits, packed, in which the leading bits of a long column's values are set: at most
    ``2 ** (bits - 6)`` rows come to the driver, however large ``df``."""
    at = F.shiftrightunsigned(column, 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    words = df.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("w")).toArrow()
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return table.view(np.uint8)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a packed table."""
    at = h.view(np.uint64) >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _sifted(batch, table, name):
    return list(batch.filter(pa.array(passes(table.value, number(column(batch, name))))).columns)


def sifted(df: DataFrame, name: str, wanted: DataFrame, bits: int = 25) -> DataFrame:
    """``df`` without most of the rows whose long ``name`` is not in ``wanted``, by a table of fixed size (4 MB): spares a
    join behind it a shuffle as long as ``wanted`` has some 100 million values at most, and changes no result."""
    table = df.sparkSession.sparkContext.broadcast(bit_words(wanted, name, bits))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_rows(df, functools.partial(_sifted, table=table, name=name), ddl, 4096)


#: A key that holds more than one row in so many is dealt out to as many tasks.
HOT = 2000


def salted_join(rows: DataFrame, found: DataFrame, keys: list[str], count: str, spread: str) -> DataFrame:
    """``rows`` joined with ``found``, which says in ``count`` how many ``rows`` hold each of its ``keys``, so that hot keys
    can be split.

    At most ``HOT`` keys can hold more than a ``HOT``-th of all those rows each: only their names are broadcast.
    Their rows are dealt out by ``spread`` to ``HOT / 8`` salts, for each of which ``found`` has a copy. (The limit
    below states that bound; a hot key left out of the broadcast would be joined all the same, in one task.)
    """
    sizes = found.select(*keys, count).distinct()
    limit, salts = max(1000, (sizes.agg(F.sum(count)).first()[0] or 0) // HOT), HOT // 8
    hot = sizes.where(F.col(count) > limit).select(*keys, F.lit(True).alias("_hot")).limit(HOT)
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", dealt).drop("_hot")
    copies = F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    return left.join(found.select("*", copies), [*keys, "_salt"]).drop("_salt")


def smallest_reachable(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix of links, the smallest name in each row's component."""
    labels = names.copy()
    top = np.iinfo(np.int64).max
    while True:
        reach = np.minimum(labels, np.where(linked, labels[None, :], top).min(axis=1))
        if np.array_equal(reach, labels):
            return labels
        labels = reach
