"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, the lowest first. Level 0 holds the lowest chunk of every id; a bitmap says
which ids go on, and level 1 holds the next chunk of those, and so on. A rank directory holds the number of set
bits before every 512 bits, so the place of an id's next chunk is one look-up and a popcount: any token can be
read without decoding what stands before it.

A file (little-endian): the magic ``FSDAC001``; five 64-bit numbers: documents, tokens, levels, the offset of the
first token among all files (filled by readers from the manifest; 0 in files), reserved; document keys (int64 each);
first tokens of the documents (n + 1 times uint64); then for each level its number of chunks (uint64), the chunks,
and, for all but the last, the bitmap (padded to 8 bytes) and the rank directory (uint64 each). Documents are in
ascending doc_id order inside files, files by partition and number.

Files are written by the executors through ``pyarrow.fs`` into a shared folder, under a temporary name and then
moved, so that a task that runs twice leaves one file.

Edge cases: a null or empty text is the end id alone; a null doc_id is stored under a reserved key and comes first;
rows that share a doc_id are stored each, in the order of a hash of their text; an empty table is no file and an empty
result; other columns are ignored, whatever their names; long texts are encoded whole.
"""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscale.llm.encoding import encoder
from foldscale.llm.runtime import column, id_of, key_of, map_rows, materialize, schema_of, sliced, task_ended, to_batch

MAGIC = b"FSDAC001"
BLOCK_BITS = 512
FILE_TOKENS = 2_000_000


def qualified(spark: SparkSession, uri: str) -> str:
    """The address in full, as Spark understands it: a path without a scheme is one of its default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = store.makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _popcount(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap)


def encode_dac(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Levels of (chunks, bitmap, ranks); the last level has no bitmap."""
    out = []
    rest = ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32(255)).astype(np.uint8)
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            out.append((chunks, None, None))
            return out
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)))
        counts = _popcount(bits.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)))
        out.append((chunks, bits, ranks))
        rest = rest[more]


class DacFile:
    """Random access to one file's bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.tokens, levels, _, _ = np.frombuffer(raw, "<u8", 5, 8).tolist()
        at = 48
        self.keys = np.frombuffer(raw, "<i8", self.documents, at)
        at += 8 * self.documents
        self.first = np.frombuffer(raw, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.levels = []
        for level in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level < levels - 1:
                size = -(-n // BLOCK_BITS) * (BLOCK_BITS // 8)
                bits = np.frombuffer(raw, np.uint8, size, at)
                at += size
                ranks = np.frombuffer(raw, "<u8", size // (BLOCK_BITS // 8) + 1, at)
                at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position ``i``: the directory's entry and a popcount of less than a block."""
        block = i // BLOCK_BITS
        a, b = block * (BLOCK_BITS // 8), i // 8
        n = int(ranks[block]) + int(_popcount(bits[a:b]).sum())
        return n + (int(bits[b] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        """The token at position ``i`` of the file."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """Tokens ``a`` to ``b``, exclusive."""
        out = self.levels[0][0][a:b].astype(np.uint32)
        who = None  # the places in ``out`` that the level goes on with; None: all
        for level in range(1, len(self.levels)):
            bits, ranks = self.levels[level - 1][1:]
            if a == b:
                break
            low = a // 8
            more = np.unpackbits(bits[low : -(-b // 8)], bitorder="little")[a - 8 * low : b - 8 * low].view(bool)
            who = np.flatnonzero(more) if who is None else who[more]
            a = self._rank(bits, ranks, a)
            b = a + len(who)
            out[who] |= self.levels[level][0][a:b].astype(np.uint32) << np.uint32(8 * level)
        return out


def to_bytes(keys: list[int], ids: list[bytes]) -> bytes:
    first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype("<u8")
    levels = encode_dac(np.frombuffer(b"".join(ids), "<u4"))
    head = np.array([len(keys), int(first[-1]), len(levels), 0, 0], "<u8")
    parts = [MAGIC, head.tobytes(), np.array(keys, "<i8").tobytes(), first.tobytes()]
    for chunks, bits, ranks in levels:
        parts += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes()]
        if bits is not None:
            parts += [bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(parts)


_MANIFEST = "part int, number int, file string, documents long, tokens long"


def _write(batches, uri, tokenizer, end_id, schema):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    fs, root = _filesystem(uri)
    fs.create_dir(root, recursive=True)
    end = np.array([end_id], "<u4").tobytes()
    rows: list[list] = [[] for _ in range(5)]
    keys: list[int] = []
    ids: list[bytes] = []
    held = 0

    def flush():
        nonlocal keys, ids, held
        n = len(rows[0])
        name = f"{part:06d}-{n:05d}.dac"
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(to_bytes(keys, ids))
        fs.move(temporary, f"{root}/{name}")
        for c, v in zip(rows, (part, n, name, len(keys), held), strict=True):
            c.append(v)
        keys, ids, held = [], [], 0

    for batch in sliced(batches, 128):
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        for k, raw in zip(column(batch, "k").to_pylist(), encoder(tokenizer).encode(texts), strict=True):
            keys.append(k)
            ids.append(raw + end)
            held += len(raw) // 4 + 1
            if held >= FILE_TOKENS:
                flush()
    if keys:
        flush()
    task_ended()
    if rows[0]:
        yield to_batch(rows, schema)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files under ``uri``; returns the manifest: file, documents, tokens, start (tokens of the files before)."""
    fields, arrow = schema_of(_MANIFEST)
    run = functools.partial(_write, uri=qualified(docs.sparkSession, uri), tokenizer=tokenizer, end_id=end_id, schema=arrow)
    # the hash of the text and the row's number split an id that a third of all rows share
    order = ["k", "t", "r"]
    rows = docs.select(key_of("doc_id").alias("k"), "text", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("r"))
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = materialize(spread.mapInArrow(run, fields), "token-manifest")
    # one row per sorted partition on the driver
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in totals:
        starts.append((r["part"], total))
        total += r["n"]
    base = docs.sparkSession.createDataFrame(starts, "part int, base long")
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(base, "part")
        .select("file", "documents", "tokens", (F.col("base") + F.col("inner")).alias("start"))
    )


def _read(batch, uri):
    fs, root = _filesystem(uri)
    out: list[list] = [[] for _ in range(4)]
    for name, base in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist(), strict=True):
        with fs.open_input_file(f"{root}/{name}") as f:
            dac = DacFile(f.read())
        out[0] += dac.keys.tolist()
        first = dac.first.tolist()
        raw = memoryview(dac.span(0, dac.tokens).astype("<u4", copy=False)).cast("B")
        for a, b in zip(first, first[1:], strict=False):
            out[1].append(base + a)
            out[2].append(b - a)
            out[3].append(zlib.crc32(raw[4 * a : 4 * b]))
    return out


def read_tokens(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("file", "start")
    files = files.repartition(min(max(1, files.count()), 20_000))  # a task for each file; each is much work
    found = map_rows(files, functools.partial(_read, uri=qualified(spark, uri)), "k long, start long, n_tokens long, ids_crc32 long", 1)
    return found.select(id_of("k").alias("doc_id"), "start", "n_tokens", "ids_crc32")
