"""A quality classifier with supervised subword embeddings.

Features of a text: its words (lower case), its character 3- and 4-grams (as they stand) and, for each word, whether
it repeats one of the four words before it; all hashed to buckets. Each bucket has a learned vector; a document
is the average of its features' vectors within each family, averaged over the families, and a softmax over two
classes gives the score. Vectors and output
weights are trained together by stochastic gradient descent in numpy with per-row adaptive steps, on a bounded
sample of labelled rows, in the order of a hash of the id: at most ``sample`` rows with at most ``sample_chars``
characters together (parameters of ``train``; a text that does not fit is left out of the training, never cut), so
what the driver holds is bounded by about 18 bytes a character.

As the average is linear up to the softmax, scoring folds each bucket's vector into one number, so that scoring
a whole text is a table look-up and a mean.

Very long texts are worked on in parts that overlap by what n-grams and repetitions reach, with the same result.

Edge cases: null and empty texts have no features and get the score of the bias; rows with several labels take
the majority (a tie counts as 0); of the texts that share a labelled doc_id the one with the greatest hash is trained
on; a null doc_id is scored and counts as held out of nothing; labels without a document and
documents without a label are fine; without any label the score is 0.5; repeated rows are scored each, as are rows that
share a doc_id but not the text; an empty table gives an empty table; other columns of either table are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscale.llm.runtime import SLICE_CHARS, column, map_rows, materialize
from foldscale.llm.textkit import classes_of, joined, lowered, points, segments, spans_of, substring_hashes

BITS = 17
BUCKETS = 1 << BITS
LAGS = 4


def features(run: list[str], cores: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """For joined texts: pairs (buckets, first of each text) of the four feature families.

    ``cores``: for each text the characters whose features count; what stands around them is there to be looked at.
    """
    cp = points("\0".join([*run, ""]))
    kind = classes_of(cp)
    limits = np.cumsum([len(t) + 1 for t in run])
    inside = np.ones(len(cp) + 1, bool)
    if cores is not None:
        inside[:] = False
        for low, (a, b) in zip([0, *limits.tolist()], cores, strict=False):
            inside[low + a : low + b] = True
    out = []
    x = cp.astype(np.uint32)
    x = np.where(kind & 1, np.uint32(32), x)
    mix = (x * np.uint32(0x9E3779B1)) ^ (x >> np.uint32(7))
    for width, salt in ((3, 0x85EBCA77), (4, 0xC2B2AE3D)):
        n = max(0, len(mix) - width + 1)
        h = np.full(n, salt, np.uint32)
        for k in range(width):
            h = (h ^ mix[k : k + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        h *= np.uint32(0x2C1B3C6D)
        good = inside[:n].copy()
        for back in range(1, width):  # n-grams end with the blank after their text, not in the next one
            good[(limits - back)[(limits >= back) & (limits - back < n)]] = False
        at = np.flatnonzero(good)
        first = np.concatenate(([0], np.searchsorted(at, limits)))
        out.append(((h[at] >> np.uint32(32 - BITS)).astype(np.int64), first))
    _, _, value = lowered(cp)
    a, b = spans_of((kind & 1) == 0)
    w = substring_hashes(value, a, b)
    first = np.concatenate(([0], np.searchsorted(a, limits)))
    again = np.zeros(len(w), np.int64)
    place = np.arange(len(w)) - np.repeat(first[:-1], np.diff(first))
    for lag in range(LAGS, 0, -1):
        if len(w) > lag:
            same = np.concatenate((np.zeros(lag, bool), w[lag:] == w[:-lag])) & (place >= lag)
            again[same] = lag
    at = np.flatnonzero(inside[a])
    first = np.concatenate(([0], np.searchsorted(a[at], limits)))
    return [*out, ((w[at] >> np.uint64(64 - BITS)).astype(np.int64), first), (again[at], first)]


def _spread(texts: list[str], size: int):
    """(text, part, core) of texts; parts of long ones have the words before them and the characters after them."""
    for i, t in enumerate(texts):
        if len(t) <= size:
            yield i, t, (0, len(t) + 1)
            continue
        at, lead = 0, ""
        for part in segments(t, size):
            end = at + len(part)
            last = end == len(t)
            yield i, lead + t[at : end + 3], (len(lead), len(lead) + len(part) + last)
            lead, at = " ".join((lead + part).rsplit(None, LAGS)[-LAGS:]), end


def _families(texts: list[str], size: int):
    """For runs of parts: the texts that own them, and their features."""
    parts = list(_spread(texts, size))
    for a, b, run in joined([p for _, p, _ in parts]):
        whole = all(core == (0, len(p) + 1) for _, p, core in parts[a:b])
        yield np.array([i for i, _, _ in parts[a:b]]), features(run, None if whole else [c for _, _, c in parts[a:b]])


def _collected(batch):
    out: list[list] = [[] for _ in range(4)]
    ids, y = column(batch, "doc_id").to_pylist(), column(batch, "y").to_pylist()
    for i, text in enumerate(column(batch, "text").to_pylist()):
        total = np.zeros((4, BUCKETS))
        for _, found in _families([text or ""], SLICE_CHARS):
            for k, (h, _) in enumerate(found):
                total[k] += np.bincount(_lag_buckets()[h] if k == 3 else h, minlength=BUCKETS)
        each = total.sum(axis=1, keepdims=True)
        share = (total / np.maximum(each, 1)).sum(axis=0) / max(1, (each > 0).sum())
        at = np.flatnonzero(share)
        for c, v in zip(out, (ids[i], y[i], at.astype(np.int32), share[at].astype(np.float32)), strict=True):
            c.append(v)
    return out


def _lag_buckets() -> np.ndarray:
    return np.arange(BUCKETS - LAGS - 1, BUCKETS)


@dataclass
class QualityModel:
    folded: np.ndarray  # a number for each bucket
    bias: float

    def scores(self, texts: list[str], size: int = SLICE_CHARS) -> np.ndarray:
        total, count = np.zeros((4, len(texts))), np.zeros((4, len(texts)))
        lags = self.folded[_lag_buckets()]
        for owner, found in _families(texts, size):
            for k, (h, first) in enumerate(found):
                n = np.diff(first)
                some = np.flatnonzero(n > 0)
                if len(some):
                    value = lags[h] if k == 3 else self.folded[h]
                    np.add.at(total[k], owner[some], np.add.reduceat(value, first[:-1][some]))
                    np.add.at(count[k], owner[some], n[some])
        families = np.maximum((count > 0).sum(axis=0), 1)
        z = (total / np.maximum(count, 1)).sum(axis=0) / families + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 12, rate: float = 0.15, seed: int = 7):
    """Train vectors (buckets x dim) and output weights on (buckets, shares, class) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-10, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-2, np.float32)
    shares = [r for r in rows if len(r[0])]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for r in rng.permutation(len(shares)):
            ids, share, y = shares[r]
            held = vectors[ids]
            mean = share @ held
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g_mean = out @ p
            g_out = np.outer(mean, p)
            seen_v[ids] += share**2 * np.mean(g_mean**2)
            vectors[ids] = held - step * (share / np.sqrt(seen_v[ids]))[:, None] * g_mean[None, :]
            seen_o += g_out**2
            out -= step * g_out / np.sqrt(seen_o)
            seen_b += p**2
            bias -= step * p / np.sqrt(seen_b)
    return vectors, out, bias


def held_out_column(doc_id) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; never true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, epochs: int = 10, sample_chars: int = 10_000_000
) -> QualityModel:
    """Fit on labelled rows in the order of their id hashes, ``sample`` rows and ``sample_chars`` characters at most;
    held-out ids are never among them."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    usable = usable.where(~held_out_column(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so small enough to send around
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.max(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    texts = materialize(texts.select("doc_id", "y", F.length("text").alias("size"), F.xxhash64("doc_id").alias("h"), "text"), "labelled")
    left, taken = sample_chars, []
    for r in texts.select("doc_id", "size", "h").orderBy("h", "doc_id").collect():  # ``sample`` rows at most
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"],))
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")
    found = map_rows(rows, _collected, "doc_id long, y int, ids array<int>, share array<float>", 64).toArrow()
    data = []
    for batch in found.to_batches():
        ids, share = column(batch, "ids"), column(batch, "share")
        edge, flat, weight = ids.offsets.to_numpy(), ids.values.to_numpy(), share.values.to_numpy()
        start = share.offsets.to_numpy()
        for i, (doc, y) in enumerate(zip(column(batch, "doc_id").to_pylist(), column(batch, "y").to_pylist(), strict=True)):
            n = edge[i + 1] - edge[i]
            data.append((doc, flat[edge[i] : edge[i + 1]], weight[start[i] : start[i] + n], y))
    data = [r[1:] for r in sorted(data, key=lambda r: r[0])]
    if not data:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0)
    vectors, out, bias = sgd(data, epochs=epochs)
    return QualityModel(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def _scored(batch, model):
    score = model.value.scores([t or "" for t in column(batch, "text").to_pylist()])
    return [column(batch, "doc_id"), column(batch, "held_out"), score, (score >= 0.5).astype(np.int32)]


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), held_out_column(F.col("doc_id")).alias("held_out"), "text"),
        functools.partial(_scored, model=shared),
        "doc_id long, held_out boolean, score double, predicted int",
    )
