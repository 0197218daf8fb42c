"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens (runs of letters and digits; a point or comma between digits belongs to the
number). In its template, numbers are NUM, a unit word after a number is UNIT and a title-case word is NAME; other tokens are their
lower case. Windows of five tokens are hashed twice, as they stand (lower case) and as templates; a template
window counts only if at least two of its tokens are words.

Windows of documents and benchmark are hash-joined. A benchmark of at most ``slice_chars`` characters is an index that
is broadcast (bit table, sorted hashes), so documents are read once and nothing is shuffled. A larger one stays a
table: documents send the hashes that pass a bit table of fixed size (``FILTER_BITS``), these are joined with the
benchmark's by Spark, and pairs of document and item are verified with both texts. As a contained item is hit by
most of its windows, it is enough to join each item by its rarest ones (prefix filtering). Both ways find the same;
the documents are read once for windows, and in the second way once more for the texts of candidates.

For an item with enough hits, every band of hits with about the same shift between item and document is a stretch.
It aligns the item with the document token by token, through edits and windows without a hit. A window of the item
counts if its five tokens agree with the document's as templates; those that agree literally always count, the
others only if the slots of the whole stretch are consistent: one value in the item always stands for one value of
the same type in the document (two values may have become one). A document contains an item if at least ``coverage``
of the item's windows count (0.8) in some stretch; the best stretch is reported, the first of equal ones. Items of
fewer than five tokens are found literally, as a whole. An item none of whose windows has two words is found
literally only.

Edge cases: null and empty texts and items contain nothing; a null doc_id or item_id stays null; repeated rows
are reported each, as are rows that share a doc_id but not the text; equal items are reported each; an empty table on
either side gives an empty table; other columns are ignored, whatever their names; very long texts are worked on in
segments that overlap by twice the longest item.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldscale.llm.runtime import SLICE_CHARS, bit_words, column, id_of, key_of, map_rows, materialize, passes, salted_join, sifted
from foldscale.llm.textkit import ALNUM, DIGIT, LOWER, UPPER, joined, lowered, mixed, points, spans_of, substring_hashes

WINDOW = 5
NUM, UNIT, NAME = 1, 2, 3
#: Bits of the table that sorts out windows before the join with a large benchmark (8 MB), items verified at a time.
FILTER_BITS, ITEMS = 26, 64
#: Unit words that a number may stand before (fixed values).
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces pound pounds "
    "ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj pa kpa bar c f k "
    "percent dollar dollars euro euros cent cents usd eur kb mb gb tb"
).split()
_state: dict = {}


def _hash_words(tokens: list[str]) -> np.ndarray:
    _, _, value = lowered(points("\0".join(tokens)))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return substring_hashes(value, starts, ends)


def unit_hashes() -> np.ndarray:
    if "units" not in _state:
        _state["units"] = np.sort(_hash_words(UNITS))
    return _state["units"]


class Tokens:
    """Tokens of joined texts: ``word`` hashes, ``kind`` (0 or a placeholder), ``start``, ``end``, ``first`` per text."""

    def __init__(self, texts: list[str]):
        cp = points("\0".join(texts))
        _, kind, value = lowered(cp)
        inside = (kind & ALNUM) != 0
        point = (cp == 46) | (cp == 44)
        if point.any():
            digit = (kind & DIGIT) != 0
            point[1:-1] &= digit[:-2] & digit[2:]
            if len(point):
                point[0] = point[-1] = False
            inside |= point
        self.start, self.end = spans_of(inside)
        self.word = substring_hashes(value, self.start, self.end)
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.offset = np.concatenate(([0], limits[:-1]))
        self.first = np.concatenate(([0], np.searchsorted(self.start, limits)))
        self.kind = np.zeros(len(self.start), np.uint8)
        if len(self.start):
            at = kind[self.start]
            then = kind[np.minimum(self.start + 1, len(kind) - 1)]
            self.kind[((at & UPPER) != 0) & ((then & LOWER) != 0) & (self.end - self.start > 1)] = NAME
            self.kind[(at & DIGIT) != 0] = NUM
            units = unit_hashes()
            place = np.minimum(np.searchsorted(units, self.word), len(units) - 1)
            after = np.concatenate(([False], self.kind[:-1] == NUM))
            after[self.first[:-1][self.first[:-1] < len(after)]] = False
            self.kind[after & (units[place] == self.word)] = UNIT
        self.template = np.where(self.kind == 0, self.word, mixed(self.kind.astype(np.uint64) + np.uint64(9000)))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Literal and template hashes of the windows at each token, and which templates have words enough."""
        n = len(self.word) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        slots = np.zeros(n, np.int64)
        for k in range(WINDOW):
            slots += self.kind[k : k + n] != 0
        return _grams(self.word, WINDOW), _grams(self.template, WINDOW) ^ np.uint64(0x5851F42D4C957F2D), slots <= WINDOW - 2

    def whole(self, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
        """Which runs of ``width`` tokens lie in one text."""
        owner = np.searchsorted(self.first, at, "right") - 1
        return at + width <= self.first[owner + 1]


def _grams(word: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(word) - width + 1)
    out = np.full(n, width, np.uint64)
    for k, f in enumerate(mixed(np.arange(31, 31 + width, dtype=np.uint64)) | np.uint64(1)):
        out += word[k : k + n] * f
    return mixed(out)


def _entries(t: Tokens) -> tuple[np.ndarray, ...]:
    """The windows of all texts: hash, text, place in it, whether literal. Short texts are one literal window each, under
    the hash of all their tokens and place -1."""
    lit, tem, good = t.windows()
    size = np.diff(t.first)
    at = np.flatnonzero(t.whole(np.arange(len(lit))))
    loose = at[good[at]]
    parts = [(lit[at], at, np.ones(len(at), bool)), (tem[loose], loose, np.zeros(len(loose), bool))]
    hashes, place, literal = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.searchsorted(t.first, place, "right") - 1
    place -= t.first[text]
    for width in range(1, WINDOW):
        short = np.flatnonzero(size == width)
        if len(short):
            hashes = np.concatenate((hashes, _grams(t.word, width)[t.first[short]]))
            text, place = np.concatenate((text, short)), np.concatenate((place, np.full(len(short), -1)))
            literal = np.concatenate((literal, np.ones(len(short), bool)))
    return hashes, text, place, literal


class Benchmark:
    """The window index of some items; plain arrays, ready to be broadcast."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        t = Tokens([x for _, x in items])
        self.first, self.word, self.kind, self.template = t.first, t.word, t.kind, t.template
        self.size = np.diff(t.first)
        self.windows = np.maximum(self.size - WINDOW + 1, 1)
        self.hash, item, place, self.literal = _entries(t)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.literal = self.hash[order], self.literal[order]
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.widths = [int(n) for n in np.unique(self.size) if 0 < n < WINDOW]
        loose = np.bincount(self.item[~self.literal], minlength=len(items))
        self.dense = self.windows - loose  # windows that have no template
        bits = max(16, int(np.ceil(np.log2(len(self.hash) + 1))) + 5)
        self.table = bit_table(self.hash, bits)
        self.longest = max((len(x) for _, x in items), default=0)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window positions and index rows with equal hashes."""
        at = np.flatnonzero(passes(self.table, h))
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        total = int(n.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), np.repeat(lo, n) + inner


def bit_table(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A packed table of ``2 ** bits`` bits in which the hashes' leading bits are set."""
    table = np.zeros(1 << (bits - 3), np.uint8)
    at = hashes >> np.uint64(64 - bits)
    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return table


def _least_hits(windows, dense, coverage: float):
    """Hits that an item needs before it is looked at: its windows without a template may have none."""
    return np.maximum(1, np.ceil(coverage * windows - 1e-9).astype(np.int64) - dense)


def _stretches(p: np.ndarray, q: np.ndarray, width: int, least: int):
    """Maximal bands of hits whose shifts differ by ``width`` at most and that hit ``least`` different windows."""
    shift = q - p
    order = np.lexsort((q, shift))
    p, q, shift = p[order], q[order], shift[order]
    starts = np.flatnonzero(np.concatenate(([True], shift[1:] != shift[:-1])))
    ends = np.searchsorted(shift, shift[starts] + width, "right")
    before = 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b > before and b - a >= least and len(np.unique(p[a:b])) >= least:
            before = b
            yield p[a:b], q[a:b]


def _aligned(size: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The shift of each of the item's tokens: that of the hits around it; between two hits of different shift that of
    the one before."""
    shift = q - p
    values, n = np.unique(shift, return_counts=True)
    order = np.lexsort((q, np.abs(shift - values[n.argmax()]), p))  # for each window the hit nearest to the main shift
    p, shift = p[order], shift[order]
    one = np.concatenate(([True], p[1:] != p[:-1]))
    p, shift = p[one], shift[one]
    owner = np.searchsorted(p, np.arange(size), "right") - 1  # the last hit at or before the token
    after = np.minimum(owner + 1, len(p) - 1)
    own = np.maximum(owner, 0)
    return np.where(owner < 0, shift[0], np.where(np.arange(size) - p[own] < WINDOW, shift[own], np.where(shift[after] == shift[own], shift[after], shift[own])))


def _judged(t: Tokens, text: int, bench: Benchmark, item: int, p: np.ndarray, q: np.ndarray):
    """(counted windows, first token, last token, whether all are literal) of a stretch."""
    size, base = int(bench.size[item]), int(bench.first[item])
    shift = _aligned(size, p, q)
    there = np.arange(size) + shift
    valid = (there >= t.first[text]) & (there < t.first[text + 1])
    there = np.where(valid, there, t.first[text])
    own = slice(base, base + size)
    same, exact = valid & (bench.template[own] == t.template[there]), valid & (bench.word[own] == t.word[there])
    together = np.concatenate((shift[1:] == shift[:-1], [True]))
    n = size - WINDOW + 1
    loose, literal = np.ones(n, bool), np.ones(n, bool)
    for k in range(WINDOW):
        loose &= same[k : k + n]
        literal &= exact[k : k + n]
        if k < WINDOW - 1:
            loose &= together[k : k + n]
            literal &= together[k : k + n]
    counted = loose | literal
    if not counted.any():
        return 0, 0, 0, True
    if not literal[counted].all():
        used = np.convolve(counted, np.ones(WINDOW, np.int64)) > 0
        slot = np.flatnonzero(used & (bench.kind[own] != 0) & same)
        values = np.stack([bench.kind[own][slot].astype(np.uint64), bench.word[own][slot], t.word[there[slot]]], axis=1)
        if len(np.unique(values, axis=0)) > len(np.unique(values[:, :2], axis=0)):
            counted = literal
            if not counted.any():
                return 0, 0, 0, True
    at = np.flatnonzero(counted)
    return len(at), int(there[at[0]]), int(there[at[-1] + WINDOW - 1]), bool(literal[at].all())


def matches(texts: list[str], bench: Benchmark, coverage: float) -> list[tuple[int, int, float, int, int, bool]]:
    """(text, item, share of the item's windows, start, end, literal) for each contained item."""
    t = Tokens(texts)
    out = []
    lit, tem, good = t.windows()
    found = []
    for h, want_literal in ((lit, True), (np.where(good, tem, np.uint64(0)), False)):
        at, row = bench.hits(h)
        keep = (bench.literal[row] == want_literal) & (bench.place[row] >= 0) & t.whole(at)
        found.append((at[keep], row[keep]))
    at, row = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = np.searchsorted(t.first, at, "right") - 1
    pair = owner.astype(np.int64) * len(bench.ids) + bench.item[row]
    order = np.lexsort((at, pair))
    pair, at, place = pair[order], at[order], bench.place[row[order]].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))).tolist() if len(pair) else []
    for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=False):
        text, item = divmod(int(pair[a]), len(bench.ids))
        need = int(bench.windows[item])
        least = int(_least_hits(need, int(bench.dense[item]), coverage))
        if b - a < least:
            continue
        best = (0, 0, 0, True)
        hit = np.unique(np.stack([place[a:b], at[a:b]]), axis=1)
        for p, q in _stretches(hit[0], hit[1], max(2, need // 4), least):
            one = _judged(t, text, bench, item, p, q)
            if (one[0], -one[1]) > (best[0], -best[1]):
                best = one
        share = best[0] / need
        if share >= coverage - 1e-9:
            out.append((text, item, share, int(t.start[best[1]] - t.offset[text]), int(t.end[best[2]] - t.offset[text]), best[3]))
    for width in bench.widths:
        at, row = bench.hits(_grams(t.word, width))
        keep = (bench.place[row] < 0) & (bench.size[bench.item[row]] == width) & t.whole(at, width)
        done = set()
        for x, item in zip(at[keep].tolist(), bench.item[row[keep]].tolist(), strict=True):
            text = int(np.searchsorted(t.first, x, "right") - 1)
            if (text, item) not in done and np.array_equal(t.word[x : x + width], bench.word[bench.first[item] : bench.first[item] + width]):
                done.add((text, item))
                out.append((text, item, 1.0, int(t.start[x] - t.offset[text]), int(t.end[x + width - 1] - t.offset[text]), True))
    return out


def _pieces(text: str, overlap: int) -> list[tuple[int, str]]:
    step = max(SLICE_CHARS, 4 * overlap)
    if len(text) <= step + overlap:
        return [(0, text)]
    return [(a, text[a : a + step + overlap]) for a in range(0, len(text), step)]


def _best(texts: list[str | None], bench: Benchmark, coverage: float) -> list[tuple]:
    """(text, item, share, start, end, match, windows) for whole texts of any length."""
    parts = [(i, a, s) for i, t in enumerate(texts) if t for a, s in _pieces(t, 2 * bench.longest)]
    best: dict[tuple[int, int], tuple] = {}
    for a, b, run in joined([s for _, _, s in parts]):
        for k, item, share, start, end, literal in matches(run, bench, coverage):
            i, base, _ = parts[a + k]
            if (i, item) not in best or share > best[i, item][0]:
                best[i, item] = (share, start + base, end + base, literal)
    return [
        (i, bench.ids[item], share, start, end, "literal" if literal else "template", int(bench.windows[item]))
        for (i, item), (share, start, end, literal) in sorted(best.items())
    ]


def _matched(batch, bench, coverage):
    ids = column(batch, "doc_id").to_pylist()
    rows = _best(column(batch, "text").to_pylist(), bench.value, coverage)
    return [[ids[r[0]] for r in rows], *([r[c] for r in rows] for c in range(1, 7))]


_FOUND = "item_id long, coverage double, start long, end long, match string, n_windows long"


def contained_items(
    docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, slice_chars: int = 4_000_000
) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, coverage, start, end (code points), match
    (``literal`` or ``template``), n_windows."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long"), "text")
    if total > slice_chars:
        return _joined_items(docs, items, coverage)
    index = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in items.toLocalIterator()]))
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"),
        functools.partial(_matched, bench=index, coverage=coverage),
        f"doc_id long, {_FOUND}",
    )


def _indexed(batch, coverage):
    """The windows by which items are met: hash, item, place, and how many of its rarest windows an item needs.

    An item of which ``least`` windows with a template must be hit is met by all but ``least - 1`` of them, whichever
    these are; if it may be contained without such a hit, by all its windows.
    """
    n = column(batch, "n").to_numpy(zero_copy_only=False)
    texts = column(batch, "text").to_pylist()
    out: list[list] = [[] for _ in range(4)]
    for a, b, run in joined(texts):
        t = Tokens(run)
        hashes, text, place, literal = _entries(t)
        windows = np.maximum(np.diff(t.first) - WINDOW + 1, 1)
        good = np.bincount(text[~literal], minlength=b - a)
        least = np.ceil(coverage * windows - 1e-9).astype(np.int64) - (windows - good)
        loose = np.zeros(len(t.word) + 1, bool)
        loose[t.first[text[~literal]] + place[~literal]] = True
        keep = ~literal | ((least[text] < 1) & ~loose[t.first[text] + np.maximum(place, 0)])
        rare = np.where(least < 1, 1 << 30, good - least + 1)[text]
        for c, v in zip(out, (hashes.view(np.int64), n[a:b][text], place.astype(np.int32), rare.astype(np.int32)), strict=True):
            c.append(v[keep])
    return [np.concatenate(c) for c in out] if out[0] else None


def _passing(batch, table, overlap):
    """Each text's distinct window hashes that the bit table lets pass."""
    table = table.value
    t1, t2 = column(batch, "t1").to_pylist(), column(batch, "t2").to_pylist()
    out: list[list] = [[], [], []]
    for i, text in enumerate(column(batch, "text").to_pylist()):
        held = []
        for _, part in _pieces(text, overlap):
            t = Tokens([part])
            lit, tem, good = t.windows()
            held += [h[passes(table, h)] for h in (lit, tem[good], *(_grams(t.word, w) for w in range(1, WINDOW)))]
        held = np.unique(np.concatenate(held))
        if len(held):
            for c, v in zip(out, (t1[i], t2[i], held.view(np.int64)), strict=True):
                c.append(v)
    return out


def _verified(batch, coverage):
    """Exact search of the candidate items in their texts."""
    out: list[list] = [[] for _ in range(8)]
    names = ("t1", "t2", "text", "items")
    for t1, t2, text, items in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
        bench = Benchmark([(x["item_id"], x["text"]) for x in sorted(items, key=lambda x: x["n"])])
        for row in _best([text], bench, coverage):
            for c, v in zip(out, (t1, t2, *row[1:]), strict=True):
                c.append(v)
    return out


def _joined_items(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """The same for a benchmark of any size: window hashes are joined by Spark, pairs with hits enough verified."""
    spark = docs.sparkSession
    items = materialize(items.withColumn("n", F.monotonically_increasing_id()), "benchmark-items")
    index = materialize(map_rows(items, functools.partial(_indexed, coverage=coverage), "hash long, n long, place int, rare int"), "benchmark-windows")
    common = materialize(index.groupBy("hash").agg(F.count("*").alias("c")), "benchmark-counts")
    rank = F.row_number().over(Window.partitionBy("n").orderBy("c", "place", "hash"))
    ranked = salted_join(index, common, ["hash"], "c", "n").withColumn("rank", rank).where("rank <= rare")
    index = materialize(ranked.select("hash", "n", "c").distinct(), "benchmark-index")
    table = bit_words(index, "hash", FILTER_BITS)
    longest = items.agg(F.max(F.length("text"))).first()[0] or 0
    rows = docs.where("text is not null and text != ''").select(
        key_of("doc_id").alias("k"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(91), "text").alias("t2")
    )
    text = ["t1", "t2"]
    kernel = functools.partial(_passing, table=spark.sparkContext.broadcast(table), overlap=2 * longest)
    sent = materialize(map_rows(rows, kernel, "t1 long, t2 long, hashes array<long>").dropDuplicates(text), "passing-windows")
    sent = sent.select(*text, F.explode("hashes").alias("hash"))
    counts = sent.groupBy("hash").agg(F.count("*").alias("m")).join(index.select("hash", "c").distinct(), "hash")
    held = salted_join(index.select("hash", "n"), materialize(counts, "held-windows"), ["hash"], "c", "n")
    pairs = salted_join(sent, materialize(held, "held-items"), ["hash"], "m", "t1").select(*text, "n").distinct()
    pairs = materialize(pairs, "candidate-items")
    wanted = salted_join(pairs, items.join(pairs.groupBy("n").agg(F.count("*").alias("m")), "n"), ["n"], "m", "t1")
    groups = pairs.groupBy(*text).agg(F.ceil(F.count("*") / ITEMS).alias("g"))
    listed = (
        wanted.withColumnRenamed("text", "item")
        .join(groups, text)
        .groupBy(*text, F.pmod(F.xxhash64("n"), F.col("g")).alias("g"))
        .agg(F.collect_list(F.struct("n", "item_id", F.col("item").alias("text"))).alias("items"))
    )
    whole = sifted(rows.select(*text, "text"), "t1", pairs).groupBy(*text).agg(F.first("text").alias("text"))
    found = materialize(
        map_rows(listed.join(whole, text).select(*text, "text", "items"), functools.partial(_verified, coverage=coverage), f"t1 long, t2 long, {_FOUND}", 16),
        "contained-items",
    )
    names = [x.split()[0] for x in _FOUND.split(", ")]
    # the rows that hold a text, with its items as one row, so that a text of a third of all rows can be split
    per = found.groupBy(*text).agg(F.collect_list(F.struct(*names)).alias("found"))
    copies = rows.select(*text, "k")
    sizes = copies.join(per.select(*text), text, "left_semi").groupBy(*text).agg(F.count("*").alias("m"))
    return salted_join(copies, materialize(per.join(sizes, text), "contained-texts"), text, "m", "k").select(id_of("k").alias("doc_id"), F.explode("found").alias("x")).select("doc_id", "x.*")
