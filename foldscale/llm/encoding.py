"""Token ids of whole texts through the tokenizers library, with a bounded memo of repeated units.

Both tokenizers used here split a text before their merges so that a blank or a line feed between two other
characters always starts a new piece. A text is therefore cut at those, each distinct unit is encoded by the
library once, and the ids are strung together. A new unit of Latin letters with punctuation behind them is handed
to the library's merge model in those two parts, which are the pieces the library would make of it (a probe at
the start makes sure of that); other new units are encoded many at a time, as one text in which a separator with
an id of its own stands between them. A text with white space of any other form (runs, tabs,
leading or trailing blanks, special-token strings) is encoded whole by the library.

For byte-level tokenizers with the standard pattern ``ColumnEncoder`` does the same on an Arrow column: units are found
in its bytes, told apart by Arrow's dictionaries, and only new ones are seen by Python, which hands them to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from foldscale.llm.runtime import at_task_end

_PUNCTUATION = '.,!?;:*$%&#|"()-=+@/'
_PROBES = ("a", " The", " word,", " été.", "ABC!!", " x***", " Über#", " don", " ß|", " ÀÉÎÕÜ.", ",", " thing-")
_LATIN = re.compile(r"[\0-\xff]*").fullmatch
_PLAIN = re.compile(r"[\t-\r\x20-\x84\x86-\x9f\xa1-\xff]*").fullmatch
_UNSAFE = re.compile(r"[\s\0-\x1f]").search
_encoders: dict = {}
_column_encoders: dict = {}
#: Bytes of text whose units are told apart at a time; a longer text is one run.
_RUN = 4_000_000
#: Bytes of the longest unit that outlives its run in the memo.
_REMEMBERED = 64
_LETTER, _SIGN, _BLANK, _FEED = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[48:58] = 0
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[32], _KINDS[10] = _BLANK, _FEED


def load_tokenizer(path: str):
    """A fast tokenizer whose special tokens' strings are ordinary text when they stand in a document."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _shown() -> dict[int, str]:
    """Byte-level models write each byte as a printable character."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printed}
    return shown | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}


class UnitEncoder:
    """``encode(texts) -> list of little-endian uint32 bytes``, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, most: int = 200_000):
        self.tokenizer = load_tokenizer(path)
        self.most = most
        self.direct = False
        self.memo: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}  # the generation before; what is met again moves up
        # a line feed where the tokenizer keeps white space, else a control character between blanks
        keeps = len(self._ids("a\nb")) == 3
        self.between, self.mark = ("\n", self._ids("a\nb")[1]) if keeps else (" \x01 ", self._ids("a \x01 b")[1])
        self.model, self.keeps = self.tokenizer.model, keeps
        self.shown = _shown()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(True))]
        self.direct = all(self._parts(u) in (None, self.whole(u)) for u in _PROBES)
        self.memo.clear()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, by the library's merge model."""
        known = self.memo.get(piece) or self.old.get(piece)
        if known is None:
            packed = self.packed
            if piece.isascii():
                shown = piece.replace(" ", "\u0120")
            else:
                shown = piece.encode().decode("latin-1").translate(self.shown)
            known = b"".join([packed[t.id] for t in self.model.tokenize(shown)])
            self.memo[piece] = known
        return known

    def _parts(self, unit: str) -> bytes | None:
        """Ids of letters with punctuation behind them; None for a unit of another form."""
        core = unit.rstrip(_PUNCTUATION)
        body = core[1:] if core[:1] == " " else core
        if not body.isalpha() or not (body.isascii() or _LATIN(body)):
            return None
        ids = self._piece(core if self.keeps else body.lower())
        return ids + self._piece(unit[len(core) :]) if len(core) < len(unit) else ids

    def _learn(self, units: list[str], run: int = 2000) -> None:
        for a in range(0, len(units), run):
            part = units[a : a + run]
            joined = self.between.join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(ends) != len(part):  # a unit that holds the separator's id
                for u in part:
                    self.memo[u] = self.whole(u)
                continue
            raw, at = ids.tobytes(), 0
            for u, b in zip(part, ends, strict=True):
                self.memo[u] = raw[4 * at : 4 * b]
                at = b + 1

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    @staticmethod
    def safe(unit: str) -> bool:
        """Whether the unit's ids do not depend on its neighbours."""
        body = unit[1:] if unit[:1] == " " else unit
        return bool(body) and not _UNSAFE(body)

    def _units(self, text: str) -> list[str]:
        """Units of a text; none if it holds a NUL, which is the mark between them."""
        if not self.keeps and self.direct and _PLAIN(text):
            # this tokenizer lowers Latin letters one by one and drops white space
            return text.lower().split()
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._units(t) if t else [] for t in texts]
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        fresh = set().union(*cut) - memo.keys()
        for u in fresh & old.keys():
            memo[u] = old[u]
        fresh -= memo.keys()
        memo.update(dict.fromkeys(fresh))
        rest = []
        for u in fresh:
            ids = self._parts(u) if self.direct else None
            if ids is not None:
                memo[u] = ids
            elif self.safe(u):
                rest.append(u)
        self._learn(rest)
        if memo.get("\n", b"") is None:
            memo["\n"] = self.whole("\n")
        out = []
        for text, units in zip(texts, cut, strict=True):
            if not units:
                out.append(self.whole(text) if text else b"")
            elif any(s in text for s in self.special):
                out.append(self.whole(text))
            else:
                parts = list(map(memo.__getitem__, units))
                if units[-1] == "" and len(units) > 1 and units[-2] == "\n":
                    parts.pop()  # a final line feed
                out.append(self.whole(text) if None in parts else b"".join(parts))
        return out


class ColumnEncoder:
    """``encode(column) -> little-endian uint32 bytes of each text``, equal to ``encode(text, add_special_tokens=False)``.

    A byte-level tokenizer's pattern ends a piece before a blank that another character follows, before and after a line
    feed beside other characters, and between an ASCII letter and an ASCII sign. Units end there; the library encodes
    each distinct one once, and texts with other white space or strings of added tokens whole. Other tokenizers'
    texts go to ``UnitEncoder``.
    """

    def __init__(self, path: str, most: int = 200_000):
        self.path, self.most = path, most
        self.tokenizer = load_tokenizer(path)
        made = json.loads(self.tokenizer.to_str())
        by = made["pre_tokenizer"] or {}
        self.cuts = (
            made["normalizer"] is None
            and by.get("type") == "ByteLevel"
            and by.get("use_regex", True)
            and not by["add_prefix_space"]
            and (made["model"]["type"], made["model"].get("dropout")) == ("BPE", None)
            and all(self.tokenizer.token_to_id(c) is not None for c in _shown().values())
        )
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = _shown()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(True))]
        self.feed = self.tokenizer.token_to_id(self.shown[10])
        self.memo: dict[bytes, bytes] = {}  # no ids: a unit that depends on its neighbours
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """In the order of the column; a null is an empty text."""
        if not self.cuts:
            yield from encoder(self.path).encode([t or "" for t in texts.to_pylist()])
            return
        texts = texts.fill_null("").cast(pa.large_binary())
        ends, data = _binary(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _RUN, "right")) - 1)
            yield from self._run(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            a = b

    def _run(self, data: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        firsts = ends[:-1][ends[:-1] < len(data)]
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KINDS.tobytes()), np.uint8)
        feed = kind == _FEED
        start = kind >= _BLANK
        start[1:] |= feed[:-1]
        start[1:] |= (kind[1:] == _SIGN) & (kind[:-1] == _LETTER)
        start[firsts] = True
        feeds = feed[1:] & feed[:-1]
        at = np.flatnonzero(start)
        bounds = np.append(at, len(data))
        units = _array(bounds, data).dictionary_encode()
        known = pa.array(self._ids(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        which = units.indices.to_numpy()
        place, ids = _binary(known.take(units.indices))

        odd = [1 + np.flatnonzero(feeds)] if feeds.any() else []
        none = np.diff(_binary(known)[0]) == 0
        if none.any():
            odd.append(at[none[which]])
        odd += [[m.start()] for s in self.added for m in re.finditer(re.escape(s), raw)]
        whole = set(np.searchsorted(ends, np.concatenate(odd), "right").tolist()) if odd else ()
        cut = place[np.searchsorted(at, ends)].tolist()
        spans = ends.tolist()
        for n in range(1, len(spans)):
            if n in whole:
                yield self._whole(raw[spans[n - 1] : spans[n]].decode())
            else:
                yield ids[cut[n - 1] : cut[n]].tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, units: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        found = list(map(memo.get, units))
        if None in found:
            fresh = [u for u, ids in zip(units, found, strict=True) if ids is None]
            again = {u: old[u] for u in fresh if u in old}
            memo.update(again)
            self._learn([u for u in fresh if u not in again])
            found = list(map(memo.__getitem__, units))
            for u in fresh:
                if len(u) > _REMEMBERED:
                    del memo[u]
        return found

    def _learn(self, units: list[bytes], run: int = 2000) -> None:
        memo, packed, merge = self.memo, self.packed, self.tokenizer.model.tokenize
        rest = []
        for u in units:
            text = u.decode()
            body = text[1:] if text[:1] == " " else text
            if body.isalpha() and (body.isascii() or _LATIN(body)):  # one piece: the library's merges alone
                shown = text.replace(" ", "\u0120") if body.isascii() else u.decode("latin-1").translate(self.shown)
                memo[u] = b"".join([packed[t.id] for t in merge(shown)])
            elif u == b"\n" or not UnitEncoder.safe(text):
                memo[u] = self._whole(text) if u == b"\n" else b""
            else:
                rest.append(u)
        for a in range(0, len(rest), run):
            part = rest[a : a + run]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, low = ids.tobytes(), 0
            for u, at in zip(part, [*np.flatnonzero(ids == self.feed).tolist(), len(ids)], strict=True):
                memo[u] = raw[4 * low : 4 * at]
                low = at + 1


def _binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_binary column."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _array(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def _cut_back(most: int = 40_000) -> None:
    for e in [*_encoders.values(), *_column_encoders.values()]:
        if len(e.memo) + len(e.old) > most:
            e.memo, e.old = {}, {}


at_task_end.append(_cut_back)


def encoder(path: str) -> UnitEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def column_encoder(path: str) -> ColumnEncoder:
    """This process's encoder of Arrow columns for a tokenizer file."""
    if path not in _column_encoders:
        _column_encoders[path] = ColumnEncoder(path)
    return _column_encoders[path]
