"""Best-fit packing with certified bounds.

A document is its token ids and an end id. Documents of more than ``capacity`` ids are cut into pieces of
``capacity``, the first of which may be shorter; full pieces are sequences of their own. The other pieces are
dealt out to groups of about ``group_items``; each group packs its pieces best-fit decreasing (the open sequence
with the least room that suffices) and certifies its number of sequences by the best of a family of
dual-feasible-function bounds. Groups above their bound, and the emptiest sequences of all, give up the pieces of
their loose sequences; those are dealt out anew, across groups, and packed again, and the round's result is taken
if it needs fewer sequences. Rounds end when nothing is gained.

No group grows with the input: their number does. ``certificate`` gives the number of sequences next to a bound
for the whole input, from the histogram of piece lengths (at most ``capacity`` rows).

Edge cases: a null or empty text is one piece of the end id alone; a null doc_id counts as one more id; repeated
rows are packed each, as are rows that share a doc_id but not the text; pieces of equal length are packed in the order
in which they come, which fixes no more than which of them stands where; an empty table gives an empty table; other columns are
ignored, whatever their names; a text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.encoding import column_encoder
from foldscale.llm.runtime import column, id_of, key_of, map_groups, map_rows, materialize, number

_PIECES = "k long, piece int, start long, length int, ids_crc32 long"


def _cut(batch, tokenizer, end_id, capacity):
    ids = column(batch, "k").to_pylist()
    end = np.array([end_id], "<u4").tobytes()
    out: list[list] = [[] for _ in range(5)]
    for k, raw in zip(ids, column_encoder(tokenizer).encode(column(batch, "text")), strict=True):
        raw += end
        n = len(raw) // 4
        at, piece = 0, 0
        while at < n:
            size = (n % capacity or capacity) if at == 0 else capacity
            row = (k, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]))
            for c, v in zip(out, row, strict=True):
                c.append(v)
            at, piece = at + size, piece + 1
    return out


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins."""
    order = np.argsort(-length, kind="stable")
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i, size in zip(order.tolist(), length[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offset, n


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``histogram[length]`` items needs: the best dual-feasible-function bound.

    Families: Martello and Toth's threshold functions for every threshold up to half the capacity, and Fekete and
    Schepers' rounding functions for k up to 20.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    h = histogram.astype(np.int64)
    mass, count = np.cumsum(h * size), np.cumsum(h)
    best = -(-int(mass[-1]) // capacity)
    for low in range(1, capacity // 2 + 1):
        big = int(count[-1] - count[capacity - low])
        middle = int(mass[capacity - low] - mass[low - 1])
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    return best


def _packed(key, rows, capacity):
    length = number(column(rows, "length"))
    bins, offset, n = best_fit_decreasing(length, capacity)
    fill = np.bincount(bins, weights=length, minlength=n).astype(np.int64)
    gap = n - lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
    same = [number(column(rows, c)) for c in ("k", "piece", "start", "length", "ids_crc32", "grp")]
    return [*same, bins, offset, fill[bins], np.full(len(bins), gap)]


_STATE = f"{_PIECES}, grp long, bin long, off long, fill long, gap long"


def _deal(pieces: DataFrame, salt: int, groups: int, capacity: int) -> DataFrame:
    grp = F.pmod(F.xxhash64(F.lit(salt), "k", "piece"), F.lit(groups))
    columns = [x.split()[0] for x in _PIECES.split(", ")]
    return map_groups(
        pieces.select(*columns, grp.alias("grp")), ["grp"], functools.partial(_packed, capacity=capacity), _STATE
    )


def _sequences(state: DataFrame) -> int:
    return state.where("off = 0").count()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    group_items: int = 4096,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(
        map_rows(
            docs.select(key_of("doc_id").alias("k"), "text"),
            functools.partial(_cut, tokenizer=tokenizer, end_id=end_id, capacity=capacity),
            _PIECES,
            4096,
        ),
        "pieces",
    )
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    now = materialize(_deal(rest, 0, groups, capacity).withColumn("turn", F.lit(0)), "packed")
    for turn in itertools.count(1):  # every round but the last saves a sequence, so they end
        # a group above its bound gives up what is not nearly full, any group its emptiest sequences
        room = capacity - F.col("fill")
        loose_if = ((F.col("gap") > 0) & (room >= capacity // 64)) | (room >= capacity // 8)
        loose = now.where(loose_if)
        before, items = _sequences(loose), loose.count()
        if before < 2:
            break
        again = materialize(
            _deal(loose, turn, max(1, -(-items // group_items)), capacity).withColumn("turn", F.lit(turn)), "repacked"
        )
        if _sequences(again) >= before:
            break
        now = materialize(now.where(~loose_if).unionByName(again), "packed")
    # 2 ** 20 sequences a group, 2 ** 32 groups
    number_of = F.shiftleft(F.shiftleft(F.col("turn").cast("long"), 32).bitwiseOR(F.col("grp")), 20).bitwiseOR(F.col("bin"))
    own = full.select(
        "*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    shared = now.select(
        "k", "piece", "start", "length", "ids_crc32",
        (number_of * 2 + 1).alias("sequence_id"),
        F.col("off").alias("offset"),
    )
    return own.unionByName(shared).select(
        id_of("k").alias("doc_id"),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        "offset",
    )


def certificate(packed: DataFrame, capacity: int = 1024) -> dict[str, int]:
    """Sequences used and a lower bound for any packing of the same pieces."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    return {"sequences": packed.where("offset = 0").count(), "bound": lower_bound(histogram, capacity)}
