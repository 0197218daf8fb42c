"""Secret scans: a keyword automaton finds where a secret may start, anchored patterns run only there.

Each text is scanned as one byte per code point (others than ASCII become ``?``), so byte positions are code
point positions and letters compare in ASCII. An Aho-Corasick automaton over the lower-cased bytes yields
keyword hits; each kind's pattern is tried at its own hits in ascending order, from the end of the kind's last
match on, which gives the leftmost non-overlapping matches that a plain search would give. Hex runs have no
keyword: their prefilter is a search for 24 hex digits in a row over a byte-class translation. Kinds with an
embedded checksum are kept only if it holds.

Base kinds: ``assign``, ``access``, ``hex``. Kinds that the method adds, each with its checksum:

* ``forge``  -- ``gh[pousr]_`` and 36 base-62 characters, the last six the CRC-32 of the thirty before them;
* ``npm``    -- ``npm_`` likewise;
* ``card``   -- a payment card number of 13 to 19 digits (single blanks or hyphens between them) within 24
  characters before or after the word ``card``, with a valid Luhn digit. Where blanks join other digits to a number,
  the earliest start and the longest reading with a valid digit count.

Edge cases: a null text counts as empty; empty texts have no spans and the digest of the empty string; repeated
rows are scanned each; other columns are ignored by ``scan`` and kept by ``redact``; an empty table gives an
empty table; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.runtime import column, map_rows

KINDS = ("assign", "access", "hex", "forge", "npm", "card")
BASE_KINDS = KINDS[:3]
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_FORGE = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")

#: keyword -> the kind tried where it starts
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge",
    "ghr_": "forge", "npm_": "npm", "card": "card",
}
_HEX = bytes(1 if x in b"0123456789abcdef" else 0 for x in range(256))
_HEX_LEAST = 24
_automaton: list = []


def automaton() -> ahocorasick.Automaton:
    if not _automaton:
        a = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def crc_base62(body: bytes) -> bytes:
    """CRC-32 as six base-62 digits, zero-padded."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed([x - 48 for x in digits])):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _cards(raw: bytes, at: int, last: int, stop: int, least: int):
    """Card numbers that start at ``at`` to ``last`` and end at ``least`` to ``stop``."""
    while at <= last and (m := _CARD.search(raw, at, stop)) and m.start() <= last:
        at = m.start() + 1
        places = [i for i in range(m.start(), m.end()) if 48 <= raw[i] <= 57]
        for n in range(len(places), 12, -1):
            end = places[n - 1] + 1
            if end < least:
                break
            if not raw[end : end + 1].isdigit() and luhn(bytes(raw[i] for i in places[:n])):
                yield m.start(), end
                at = end
                break


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All ``(kind, start, end)`` of a text, by start and then by kind as listed; code points, end exclusive."""
    if not text:
        return []
    raw = text.encode("ascii", "replace")
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for end, (length, kind) in automaton().iter(raw.decode("ascii").lower()):
        at = end - length + 1
        if kind == "card":
            for first, last, stop, least in ((at - 60, at, at, at - 23), (end + 1, end + 24, end + 62, 0)):
                for x, y in _cards(raw, max(done["card"], first), last, stop, least):
                    found.append(("card", x, y))
                    done["card"] = y
            continue
        if at < done[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(raw, at)
            good = bool(m) and m.end(2) - m.start(2) >= 6
        elif kind == "access":
            m = _ACCESS.match(raw, at)
            good = bool(m) and m.end() - at >= 20
        else:
            m = (_FORGE if kind == "forge" else _NPM).match(raw, at)
            good = bool(m) and crc_base62(m[1]) == m[2]
        if m:
            done[kind] = m.end()
            if good:
                found.append((kind, m.start(), m.end()))
    flags = raw.translate(_HEX)
    run, at = b"\1" * _HEX_LEAST, 0
    while (at := flags.find(run, at)) >= 0:
        end = flags.find(b"\0", at)
        end = len(flags) if end < 0 else end
        found.append(("hex", at, end))
        at = end
    if len(found) > 1:
        found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def _scan(batch):
    out: list[list] = [[] for _ in range(6)]
    empty = hashlib.sha256(b"").hexdigest()
    for text in column(batch, "text").to_pylist():
        spans = find_secrets(text)
        if not spans:
            for c, v in zip(out, (0, 0, 0, empty, "", 0), strict=True):
                c.append(v)
            continue
        base = [s for s in spans if s[0] in BASE_KINDS]
        n = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        row = (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base))
        for c, v in zip(out, row, strict=True):
            c.append(v)
    return [column(batch, "doc_id"), *out]


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts by base kind, the digest of the base spans, all spans."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), _scan, f"doc_id long, {_COLUMNS}")


def _redact(batch):
    out = []
    for text in column(batch, "text").to_pylist():
        spans = find_secrets(text)
        if spans:
            parts, at = [], 0
            for kind, a, b in spans:
                if b <= at:
                    continue
                parts += [text[at : max(a, at)], f"<{kind} removed>"]
                at = b
            text = "".join([*parts, text[at:]])
        out.append(text)
    return [out if name == "text" else column(batch, name) for name in batch.schema.names]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each span of ``text`` replaced by ``<kind removed>``."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, _redact, ddl)
