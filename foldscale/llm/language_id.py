"""Language identification by Bayesian evidence fusion.

Evidence, fused as log odds over the languages and an ``und`` class for texts that look like none of them:

* text: character trigrams (letters and blanks, lower case) of the whole text under each language's smoothed
  trigram model, tempered because neighbouring trigrams are not independent;
* declared language (a markup attribute or a metadata field), with the reliability with which declarations agree
  with texts, by grouped aggregation over all rows;
* address suffix and host: a prior smoothed hierarchically, host towards address suffix towards all rows, from
  sums of the rows' text votes per host and per suffix; a row's own vote is left out of its host's sum.

Trigram models are fitted on a bounded sample of rows with a declared language: about ``per_language`` rows for
each, chosen by a hash of the id. The ``ALWAYS`` most frequent declared languages and every further one with
``least_rows`` rows have a model. A text declared in a language without one keeps its declaration and is accepted,
unless a model claims it: there is no evidence against it. All counts, reliabilities and priors cover
all rows. Hosts are aggregated with partial sums and joined by a splittable join, so a host with a third of all
rows is no hot task.

A row is rejected if no letter stands in it, if its language is ``und`` or if the posterior is below ``least``.

Edge cases: null and empty texts are rejected with posterior 0; null declarations, hosts and suffixes are missing
evidence; a declared language without a model counts as ``other``; repeated rows are scored each, as are rows that share
an id but not the text; a null id stays null; equal posteriors go to the first language in the order of codes (``und``
last); a host with several suffixes takes the greatest; an empty table gives an empty table; other columns are ignored,
whatever their names; very long texts are scored whole, in parts that overlap, with the same result.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.runtime import SLICE_CHARS, column, map_rows, materialize, salted_join
from foldscale.llm.textkit import LETTER, joined, lowered, points

BUCKETS = 1 << 15
TEMPER = 0.25
#: Trigrams after which the text's evidence does not grow any more.
ENOUGH = 400
#: So many of the most frequent declared languages have a model however few their rows.
ALWAYS = 24


def trigram_buckets(run: list[str], around: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and where each text's begin (n + 1).

    ``around``: for each text how many characters at its start and end are there to be looked at only.
    """
    cp = points("\0".join(run))
    low, kind, _ = lowered(cp)
    letter = (kind & LETTER) != 0
    low = np.where(letter, low, 0).astype(np.uint32)
    pad = np.concatenate(([0], low, [0])).astype(np.uint32)
    h = (pad[:-2] * np.uint32(0x9E3779B1)) ^ (pad[1:-1] * np.uint32(0x85EBCA77)) ^ (pad[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    limits = np.cumsum([len(t) + 1 for t in run])
    if around:
        letter = letter.copy()
        for low, high, (before, after) in zip([0, *limits.tolist()], limits.tolist(), around, strict=False):
            letter[low : low + before] = False
            letter[high - 1 - after : high - 1] = False
    at = np.flatnonzero(letter)
    return (h[at] >> np.uint32(17)).astype(np.int64), np.concatenate(([0], np.searchsorted(at, limits)))


def _parts(texts: list[str], size: int):
    """(index, part, characters around it) of texts; parts of long ones overlap by the characters beside them."""
    for i, t in enumerate(texts):
        for a in range(0, len(t), size):
            before, after = int(a > 0), int(a + size < len(t))
            yield i, t[a - before : a + size + after], (before, after)


def _counted(batch):
    found: dict[str, np.ndarray] = {}
    langs = column(batch, "declared").to_pylist()
    for i, part, around in _parts([t or "" for t in column(batch, "text").to_pylist()], SLICE_CHARS):
        h, _ = trigram_buckets([part], [around])
        found.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
        found[langs[i]] += np.bincount(h, minlength=BUCKETS)
    out: list[list] = [[], [], []]
    for lang, n in found.items():
        at = np.flatnonzero(n)
        out[0] += [lang] * len(at)
        out[1] += at.tolist()
        out[2] += n[at].tolist()
    return out


@dataclass
class TrigramModels:
    languages: list[str]
    weights: np.ndarray  # a row per language, and the last for ``und``

    def evidence(self, texts: list[str], size: int = SLICE_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods of each text, and its number of trigrams."""
        total = np.zeros((len(texts), len(self.weights)))
        count = np.zeros(len(texts), np.int64)
        parts = list(_parts(texts, size))
        for a, b, run in joined([p for _, p, _ in parts]):
            h, first = trigram_buckets(run, [x for _, _, x in parts[a:b]] if any(x != (0, 0) for _, _, x in parts[a:b]) else None)
            n = np.diff(first)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            owner = np.array([parts[a + k][0] for k in some])
            np.add.at(count, owner, n[some])
            for r, w in enumerate(self.weights):
                np.add.at(total[:, r], owner, np.add.reduceat(w[h], first[:-1][some]))
        scale = TEMPER * np.minimum(1, ENOUGH / np.maximum(count, 1))
        return total * scale[:, None], count


def fit(rows: DataFrame, per_language: int = 1500, max_languages: int | None = None, least_rows: int = 20) -> TrigramModels:
    """Trigram models from a bounded sample of the rows with a declared language."""
    known = rows.where("declared is not null and text is not null and text != ''")
    sizes = known.groupBy("declared").count().orderBy(F.desc("count"), "declared").collect()  # codes of two or three letters
    sizes = [r for i, r in enumerate(sizes) if i < ALWAYS or r["count"] >= least_rows][:max_languages]
    if not sizes:
        return TrigramModels([], np.full((1, BUCKETS), -np.log(BUCKETS)))
    chance = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) / (1 << 30)
    shares = rows.sparkSession.createDataFrame([(r["declared"], per_language / max(r["count"], 1)) for r in sizes], "declared string, share double")
    wanted = known.join(F.broadcast(shares), "declared").where(chance < F.col("share"))
    counts = map_rows(wanted.select("declared", "text"), _counted, "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(table["lang"].unique())
    weights = np.full((len(languages) + 1, BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        part = table[table["lang"] == lang]
        weights[i, part["bucket"].to_numpy()] += part["n"].to_numpy()
    weights[-1] = 1
    return TrigramModels(languages, np.log(weights / weights.sum(axis=1, keepdims=True)))


def _scored(batch, models):
    models = models.value
    evidence, n = models.evidence([t or "" for t in column(batch, "text").to_pylist()])
    vote = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    vote /= vote.sum(axis=1, keepdims=True)
    vote[n == 0] = 0
    return [*(column(batch, c) for c in ("id", "declared", "host", "suffix")), n, list(evidence), list(vote)]


def identify(
    rows: DataFrame, least: float = 0.5, smoothing: float = 20.0, per_language: int = 1500, max_languages: int | None = None,
    least_rows: int = 20,
) -> DataFrame:
    """``rows(id, text, declared, host, suffix)`` -> id, lang, posterior, text_lang, declared, host, accepted."""
    spark = rows.sparkSession
    code = F.lower(F.regexp_extract(F.trim("declared"), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    rows = rows.select(
        "id", "text", F.when(code != "", code).alias("declared"), F.nullif("host", F.lit("")).alias("host"),
        F.nullif("suffix", F.lit("")).alias("suffix"),
    )
    models = fit(rows, per_language, max_languages, least_rows)
    names = [*models.languages, "und"]
    scored = materialize(
        map_rows(
            rows,
            functools.partial(_scored, models=spark.sparkContext.broadcast(models)),
            "id long, declared string, host string, suffix string, n long, evidence array<double>, vote array<double>",
        ),
        "language-evidence",
    )
    index = range(len(names))
    sums = [F.sum(F.col("vote")[i]).alias(f"v{i}") for i in index]
    known = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    said = {r["d"]: [r[f"v{i}"] or 0 for i in index] for r in scored.groupBy(known.alias("d")).agg(*sums).collect()}
    everyone = np.sum([np.array(v, float) for v in said.values()], axis=0) if said else np.zeros(len(names))
    base = (everyone + 1) / (everyone + 1).sum()
    kinds = [*models.languages, "other"]
    table = np.array([said.get(d, [0] * len(names)) for d in kinds], float) + 1.0
    table[:, -1] = 1.0  # of no language in particular
    agree = np.log(table / table.sum(axis=0, keepdims=True))

    def smoothed(level: str, up: list) -> list:
        return [
            ((F.col(f"{level}{i}") + smoothing * up[i]) / (F.col(f"{level}_all") + smoothing)).alias(f"p{i}")
            for i in index
        ]

    suffixes = scored.where("suffix is not null").groupBy("suffix").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums)))
    suffixes = suffixes.withColumn("s_all", F.aggregate(F.array(*(f"s{i}" for i in index)), F.lit(0.0), lambda a, b: a + b))
    suffixes = suffixes.select("suffix", *(p.alias(f"up{i}") for i, p in enumerate(smoothed("s", [F.lit(float(b)) for b in base]))))
    hosts = scored.where("host is not null").groupBy("host").agg(
        F.max("suffix").alias("suffix"), F.count("*").alias("m"), *(s.alias(f"h{i}") for i, s in enumerate(sums))
    )
    hosts = hosts.join(suffixes, "suffix", "left").select(
        "host",
        "m",
        F.array(*(f"h{i}" for i in index)).alias("held"),
        F.array(*(F.coalesce(f"up{i}", F.lit(float(base[i]))) for i in index)).alias("up"),
    )
    both = salted_join(scored.where("host is not null"), materialize(hosts, "language-hosts"), ["host"], "m", "id")
    both = both.unionByName(scored.where("host is null"), allowMissingColumns=True).withColumn("said", known)
    shared = spark.sparkContext.broadcast(Fusion(names, kinds, agree, base, smoothing, least))
    return map_rows(
        both.select("id", "declared", "host", "said", "n", "evidence", "vote", "held", "up"),
        functools.partial(_fused, fusion=shared),
        "id long, lang string, posterior double, text_lang string, declared string, host string, accepted boolean",
        4096,
    )


@dataclass
class Fusion:
    names: list[str]
    kinds: list[str]
    agree: np.ndarray  # log P(declaration | language)
    base: np.ndarray
    smoothing: float
    least: float


def _fused(batch, fusion):
    x, width = fusion.value, len(fusion.value.names)

    def rows_of(name: str, missing: np.ndarray) -> np.ndarray:
        return np.array([v if v is not None else missing for v in column(batch, name).to_pylist()], float).reshape(-1, width)

    vote, n = rows_of("vote", np.zeros(width)), np.asarray(column(batch, "n").to_numpy(zero_copy_only=False))
    held = np.maximum(rows_of("held", np.zeros(width)) - vote, 0)  # without the row's own vote
    prior = held + x.smoothing * rows_of("up", x.base)
    prior /= prior.sum(axis=1, keepdims=True)
    place = {d: i for i, d in enumerate(x.kinds)}
    said = np.array([place.get(d, -1) for d in column(batch, "said").to_pylist()], np.int64)
    reliable = np.where((said >= 0)[:, None], x.agree[np.maximum(said, 0)], 0.0)
    fused = rows_of("evidence", np.zeros(width)) + reliable + np.log(prior)
    fused = np.exp(fused - fused.max(axis=1, keepdims=True))
    fused /= fused.sum(axis=1, keepdims=True)
    best, some = fused.argmax(axis=1), n > 0
    lang = [x.names[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
    posterior = np.where(some, fused.max(axis=1), 0.0)
    text = [x.names[i] if ok else "und" for i, ok in zip(vote.argmax(axis=1), some, strict=True)]
    accepted = (best != width - 1) & some & (posterior >= x.least)
    unknown = some & ~accepted & (said == len(x.kinds) - 1)  # declared in a language without a model
    lang = [d if u else v for u, d, v in zip(unknown, column(batch, "declared").to_pylist(), lang, strict=True)]
    accepted |= unknown
    return [column(batch, "id"), lang, posterior, text, column(batch, "declared"), column(batch, "host"), accepted]


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows to identify: their ``lang`` is the declaration, their ``source`` the host."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        "text",
        F.col("lang").alias("declared"),
        F.col("source").alias("host"),
        F.regexp_extract("source", r"\.([A-Za-z]{2,})$", 1).alias("suffix"),
    )


_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]+;", re.S | re.I)


def _stripped(batch):
    texts = [_TAGS.sub(" ", h) if h else h for h in column(batch, "html").to_pylist()]
    return [column(batch, "page_id"), column(batch, "url"), texts, column(batch, "declared")]


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: the ``lang`` attribute of ``<html>``, the host and the suffix of the address."""
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    plain = map_rows(
        pages.select(F.col("page_id").cast("long"), "url", "html", declared.alias("declared")),
        _stripped,
        "page_id long, url string, text string, declared string",
    )
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return plain.select(
        F.col("page_id").alias("id"),
        "text",
        "declared",
        host.alias("host"),
        F.regexp_extract(host, r"\.([a-z]{2,})$", 1).alias("suffix"),
    )
