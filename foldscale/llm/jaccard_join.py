"""N-gram Jaccard self-join of documents with Bayesian candidate pruning.

Five-word shingles (lower-cased, split at white space), Jaccard similarity of 0.8 or more.

1. Documents with the same shingle set are one class (a 128-bit digest of the set); what follows is over classes.
2. Each class has 128 min-hash values. Classes that agree on four values of a band (32 bands) are candidates: a
   pair at 0.8 is missed with probability 5e-8. Buckets with the same members are worked on once.
3. A bucket is dealt out as cells of at most two blocks (``runtime.cells``), so that a bucket with a third of all
   rows is many bounded tasks. In a cell, pairs are compared 32 values at a time; a pair is dropped as soon as
   the posterior probability of reaching the threshold (uniform prior, binomial likelihood) is below 1e-6.
   A cell reports, for each class with a surviving pair, the smallest class it hangs together with: rows in
   proportion to its members, never its pairs.
4. Connected components of these reports bound the exact step: every surviving pair lies inside one. Components
   are dealt out as cells again, with texts; all pairs of a cell are verified exactly on their shingle sets by
   blocked incidence products, links are counted per class and weighted by class sizes.
5. Components of the verified links are the result's classes.

Edge cases: a null text counts as empty; texts without words link with nothing; texts of one to four words have
one shingle; a null doc_id counts as one more id; rows that share a doc_id are one document, whose text is the
one with the greatest digest (``corpus_pipeline`` gives every row an id of its own); pairs at the very threshold are
linked; an empty table gives an empty table; all other columns are ignored, whatever their names; very long texts are
shingled whole, in parts that end at words.
"""

from __future__ import annotations

import functools
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.graph import components
from foldscale.llm.runtime import (
    cells,
    column,
    id_of,
    key_of,
    map_groups,
    map_rows,
    materialize,
    matrix,
    number,
    smallest_reachable,
)
from foldscale.llm.textkit import mixed, shingle_sets

HASHES, BAND_ROWS, ROUND = 128, 4, 32
#: Members of a block: of candidates (signatures), of a verified component (texts).
BLOCK, TEXT_BLOCK, TEXT_SHINGLES = 1024, 1024, 400_000

_XOR = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MUL = (mixed(np.arange(501, HASHES + 501, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Min-hash values of a set of 64-bit shingle hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 16_384):
        part = h[a : a + 16_384]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return least


def digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())


def band_keys(sig: np.ndarray) -> np.ndarray:
    """For each row its key in each band."""
    n = len(sig)
    values = sig.reshape(n, HASHES // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, HASHES // BAND_ROWS + 1, dtype=np.uint64), values.shape[:2])
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float = 1e-6) -> list[tuple[int, int]]:
    """(hashes compared, matches below which the pair is dropped) for each round.

    With a uniform prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


def _signed(batch):
    keys = column(batch, "k")
    sets = shingle_sets([t or "" for t in column(batch, "text").to_pylist()])
    d = [digest(s) if len(s) else (0, 0) for s in sets]
    return [
        keys,
        [x[0] for x in d],
        [x[1] for x in d],
        [len(s) for s in sets],
        [signature(s).tobytes() if len(s) else None for s in sets],
    ]


def _banded(batch):
    keys = band_keys(matrix(column(batch, "sig"), np.uint32, HASHES))
    return [column(batch, "rep"), list(keys)]


def survivors(sig: np.ndarray, size: np.ndarray, threshold: float, rounds: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of a cell stay after the incremental comparison, as a symmetric matrix."""
    low, high = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    alive = low >= threshold * high - 1e-9
    np.fill_diagonal(alive, False)
    same = np.zeros(alive.shape, np.uint8)
    done = 0
    for n, least in rounds:
        if len(sig) <= 64:
            same += (sig[:, None, done:n] == sig[None, :, done:n]).sum(axis=2, dtype=np.uint8)
        else:
            for k in range(done, n):
                c = sig[:, k]
                same += c[:, None] == c[None, :]
        done = n
        alive &= same >= least
        if not alive.any():
            break
    return alive


def _pruned(key, rows, threshold, rounds):
    reps = number(column(rows, "rep"))
    if len(reps) < 2:
        return None
    sig = matrix(column(rows, "sig"), np.uint32, HASHES)
    alive = survivors(sig, number(column(rows, "n")), threshold, rounds)
    has = alive.any(axis=1)
    if not has.any():
        return None
    return [reps[has], smallest_reachable(alive, reps)[has]]


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 incidence blocks over the shared values."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    group = np.cumsum(np.concatenate(([False], values[1:] != values[:-1])))
    shared = np.bincount(group)[group] > 1
    group, owner = group[shared], owner[shared]
    out = np.zeros((m, m), np.float64)
    if len(group):
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        for a in range(0, int(group[-1]) + 1, width):
            lo, hi = np.searchsorted(group, (a, a + width))
            block = np.zeros((m, min(width, int(group[-1]) + 1 - a)), np.float32)
            block[owner[lo:hi], group[lo:hi] - a] = 1
            out += block @ block.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets)
    linked = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
    linked &= (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def _verified(key, rows, threshold):
    sets = shingle_sets([t or "" for t in column(rows, "text").to_pylist()])
    d = [digest(s) for s in sets]
    right = [x == y for x, y in zip(d, zip(column(rows, "d1").to_pylist(), column(rows, "d2").to_pylist(), strict=True), strict=True)]
    reps = number(column(rows, "rep"))
    keep, seen = [], set()
    for i, (ok, r) in enumerate(zip(right, reps.tolist(), strict=True)):
        if ok and r not in seen:  # rows that share a doc_id: the one text that stands for it, once
            seen.add(r)
            keep.append(i)
    if len(keep) < 2:
        return None
    reps = reps[keep]
    linked = linked_pairs([sets[i] for i in keep], threshold)
    if key[1] != key[2]:
        block = number(column(rows, "block"))[keep]
        linked &= block[:, None] != block[None, :]
    has = linked.any(axis=1)
    if not has.any():
        return None
    weight = number(column(rows, "size"))[keep]
    counts = linked.astype(np.float64) @ weight
    return [reps[has], np.rint(counts[has]).astype(np.int64), smallest_reachable(linked, reps)[has]]


def jaccard_join(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id it hangs together with), n_links (other
    documents at ``threshold`` or more), text_id (the smallest doc_id with the same shingle set), kept
    (``doc_id = class_id``)."""
    rounds = least_matches(threshold)
    all_docs = materialize(
        map_rows(
            docs.select(key_of("doc_id").alias("k"), "text"), _signed, "k long, d1 long, d2 long, n int, sig binary"
        ),
        "signatures",
    )
    one = all_docs.groupBy("k").agg(F.max(F.struct("d1", "d2", "n")).alias("x")).select("k", "x.*")
    own = materialize(one, "documents-sets")
    classes = materialize(
        own.where("n > 0").groupBy("d1", "d2").agg(F.min("k").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n")),
        "classes",
    )
    reps = materialize(
        all_docs.where("n > 0")
        .select(F.col("k").alias("rep"), "d1", "d2", "sig")
        .join(classes, ["rep", "d1", "d2"])
        .dropDuplicates(["rep"]),
        "representatives",
    )
    bands = map_rows(reps.select("rep", "sig"), _banded, "rep long, keys array<long>", 4096).select(
        "rep", F.explode("keys").alias("key")
    )
    buckets = (
        bands.groupBy("key")
        .agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("f"))
        .where("m > 1")
        .groupBy("m", "x", "f")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    members = (
        bands.join(buckets, "key")
        .join(reps.select("rep", "n", "sig"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    edges = map_groups(
        cells(members, "block", "blocks").select("key", "cell_i", "cell_j", "rep", "n", "sig"),
        ["key", "cell_i", "cell_j"],
        functools.partial(_pruned, threshold=threshold, rounds=rounds),
        "a long, b long",
    )
    near = materialize(components(edges, "candidates"), "candidate-components").withColumnRenamed("component", "comp")
    sized = near.join(classes, near["node"] == classes["rep"]).drop("node")
    totals = sized.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / TEXT_BLOCK), F.ceil(F.col("s") / TEXT_SHINGLES)).cast("int")
    dealt = (
        sized.join(totals.select("comp", blocks.alias("blocks")), "comp")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .join(docs.select(key_of("doc_id").alias("rep"), "text"), "rep")
    )
    verified = materialize(
        map_groups(
            cells(dealt, "block", "blocks").select(
                "comp", "cell_i", "cell_j", "rep", "block", "size", "d1", "d2", "text"
            ),
            ["comp", "cell_i", "cell_j"],
            functools.partial(_verified, threshold=threshold),
            "rep long, links long, b long",
        ),
        "verified",
    )
    groups = components(verified.select(F.col("rep").alias("a"), "b"), "links")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(groups, classes["rep"] == groups["node"], "left")
    known = known.select("d1", "d2", "rep", "size", "links", "component")
    return own.join(known, ["d1", "d2"], "left").select(
        id_of("k").alias("doc_id"),
        id_of(F.coalesce("component", "rep", "k")).alias("class_id"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        id_of(F.coalesce("rep", "k")).alias("text_id"),
        (F.coalesce("component", "rep", "k") == F.col("k")).alias("kept"),
    )
