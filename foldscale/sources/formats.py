"""Parsers of structure files: bytes in, raw atom rows out. Pure functions; Spark calls them per file."""

from __future__ import annotations

import gzip
import re
import struct

import numpy as np

# Suffixes that are read, and those that a file name loses to become the structure id.
SUFFIXES = {
    ".pdb": "pdb", ".ent": "pdb", ".pdb.gz": "pdb", ".ent.gz": "pdb", ".cif": "mmcif", ".mmcif": "mmcif",
    ".cif.gz": "mmcif", ".mmcif.gz": "mmcif", ".bcif": "bcif", ".bcif.gz": "bcif",
}
ID_SUFFIXES = (".pdb.gz", ".cif.gz", ".mmcif.gz", ".bcif.gz", ".pdb", ".ent", ".cif", ".mmcif", ".bcif")
WALKED = tuple(s for s in SUFFIXES if not s.startswith(".ent"))


class ParseError(ValueError):
    """An unsupported format or undecodable content."""


def detect_format(path: str) -> str:
    low = path.lower()
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if low.endswith(suffix):
            return SUFFIXES[suffix]
    raise ParseError(f"unsupported format: {path}")


def structure_id(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    low = name.lower()
    for suffix in ID_SUFFIXES:
        if low.endswith(suffix):
            name = name[: -len(suffix)]
            break
    return name or "structure"


def _number(text: str, kind, default=None):
    try:
        return kind(text)
    except ValueError:
        return default


def parse_pdb(text: str) -> tuple[str | None, list[dict]]:
    """Fixed columns, each slice trimmed; short lines are fine. The first model counts."""
    title, header, rows = [], None, []
    for line in text.splitlines():
        record = line[:6].strip()
        if record == "TITLE":
            title.append(line[10:80].strip())
        elif record == "HEADER":
            header = line[10:50].strip() or None
        elif record == "ENDMDL":
            break
        elif record in ("ATOM", "HETATM"):
            name = line[12:16].strip()
            xyz = [_number(line[a : a + 8], float) for a in (30, 38, 46)]
            if None in xyz:
                raise ParseError(f"coordinates of line {line!r}")
            element = line[76:78].strip() or re.sub(r"[^A-Za-z]", "", name)[:1]
            rows.append({
                "chain": line[21:22], "seq_number": _number(line[22:26], int, 0), "insertion_code": line[26:27],
                "is_hetero": record == "HETATM", "residue_name": line[17:20].strip(), "serial": _number(line[6:11], int),
                "atom_name": name, "alt_loc": line[16:17], "element": element, "x": xyz[0], "y": xyz[1], "z": xyz[2],
                "occupancy": _number(line[54:60], float, 1.0), "temp_factor": _number(line[60:66], float, 0.0),
            })
    return " ".join(title) or header, rows


_CIF = re.compile(r"^;(.*?)^;|'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(#[^\n]*)|(\S+)", re.S | re.M)


def cif_tokens(text: str):
    """(value, quoted) tokens: text blocks between lines that begin with a semicolon, quoted and bare words."""
    for m in _CIF.finditer(text):
        if m.group(4) is None:
            block, single, double, _, bare = m.groups()
            if bare is not None:
                yield bare, False
            else:
                value = block if block is not None else single if single is not None else double
                yield value.strip("\n") if block is not None else value, True


def parse_mmcif(text: str) -> tuple[str | None, list[dict]]:
    title, columns, values = None, [], []
    tokens = list(cif_tokens(text))
    i, n = 0, len(tokens)

    def tag(k):
        return k < n and not tokens[k][1] and tokens[k][0].startswith("_")

    def plain(k):
        word, quoted = tokens[k]
        return quoted or not (word.startswith("_") or word.lower() == "loop_" or word.lower().startswith("data_"))

    while i < n:
        word, quoted = tokens[i]
        if not quoted and word.lower() == "loop_":
            i += 1
            names = []
            while tag(i):
                names.append(tokens[i][0].lower())
                i += 1
            first = i
            while i < n and plain(i):
                i += 1
            if names and names[0].startswith("_atom_site."):
                columns, values = [x.split(".", 1)[1] for x in names], tokens[first:i]
            elif "_struct.title" in names:
                title = tokens[first + names.index("_struct.title")][0]
        elif tag(i):
            if word.lower() == "_struct.title" and i + 1 < n:
                title = tokens[i + 1][0]
            i += 2
        else:
            i += 1
    if not columns:
        raise ParseError("no atom_site category")
    k = len(columns)
    table = {c: [None if not q and v in (".", "?") else v for v, q in values[j::k]] for j, c in enumerate(columns)}
    return title, rows_from_columns(table, len(values) // k, "auth")


def rows_from_columns(table: dict, count: int, prefer: str) -> list[dict]:
    """Rows of an atom_site table; ``prefer`` says whether author or label chain names come first."""

    def pick(*names):
        columns = [table[x] for x in names if x in table]
        return [next((c[i] for c in columns if c[i] is not None), None) for i in range(count)]

    chain = pick("auth_asym_id", "label_asym_id") if prefer == "auth" else pick("label_asym_id", "auth_asym_id")
    seq, name = pick("auth_seq_id", "label_seq_id"), pick("label_atom_id", "auth_atom_id")
    residue, serial = pick("label_comp_id", "auth_comp_id"), pick("id")
    group, ins, alt, element = pick("group_pdb", "group_PDB"), pick("pdbx_pdb_ins_code", "pdbx_PDB_ins_code"), pick("label_alt_id"), pick("type_symbol")
    axes = [pick(c.lower(), c) for c in ("Cartn_x", "Cartn_y", "Cartn_z")]
    occ, b, model = pick("occupancy"), pick("b_iso_or_equiv", "B_iso_or_equiv"), pick("pdbx_pdb_model_num", "pdbx_PDB_model_num")
    first = next((m for m in model if m is not None), None)
    out = []
    for i in range(count):
        if model[i] is not None and str(model[i]) != str(first):
            continue
        f = lambda v, d: d if v is None else float(v)
        out.append({
            "chain": "" if chain[i] is None else str(chain[i]), "seq_number": int(float(seq[i])) if seq[i] is not None else 0,
            "insertion_code": ins[i], "is_hetero": group[i] == "HETATM", "residue_name": residue[i] or "",
            "serial": int(float(serial[i])) if serial[i] is not None else i + 1, "atom_name": name[i] or "", "alt_loc": alt[i],
            "element": element[i], "x": f(axes[0][i], 0.0), "y": f(axes[1][i], 0.0), "z": f(axes[2][i], 0.0),
            "occupancy": f(occ[i], 1.0), "temp_factor": f(b[i], 0.0),
        })
    return out


def unpack(raw: bytes, at: int = 0):
    """A MessagePack value and where it ends."""
    c = raw[at]
    at += 1

    def uint(size):
        nonlocal at
        value = int.from_bytes(raw[at : at + size], "big")
        at += size
        return value

    def text(n):
        nonlocal at
        value = raw[at : at + n]
        at += n
        return value

    def many(n):
        nonlocal at
        out = []
        for _ in range(n):
            v, at = unpack(raw, at)
            out.append(v)
        return out

    def pairs(n):
        flat = many(2 * n)
        return dict(zip(flat[::2], flat[1::2], strict=True))

    if c < 0x80:
        return c, at
    if c < 0x90:
        return pairs(c & 15), at
    if c < 0xA0:
        return many(c & 15), at
    if c < 0xC0:
        return text(c & 31).decode(), at
    if c >= 0xE0:
        return c - 256, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if 0xC4 <= c <= 0xC6:
        return text(uint(1 << c - 0xC4)), at
    if c in (0xCA, 0xCB):
        return struct.unpack(">f" if c == 0xCA else ">d", text(4 if c == 0xCA else 8))[0], at
    if 0xCC <= c <= 0xCF:
        return uint(1 << c - 0xCC), at
    if 0xD0 <= c <= 0xD3:
        size = 1 << c - 0xD0
        return int.from_bytes(text(size), "big", signed=True), at
    if 0xD9 <= c <= 0xDB:
        return text(uint(1 << c - 0xD9)).decode(), at
    if c in (0xDC, 0xDD):
        return many(uint(2 if c == 0xDC else 4)), at
    if c in (0xDE, 0xDF):
        return pairs(uint(2 if c == 0xDE else 4)), at
    raise ParseError(f"MessagePack byte {c:#x}")


# Number types of byte arrays.
_TYPES = {1: "<i1", 2: "<i2", 3: "<i4", 4: "<u1", 5: "<u2", 6: "<u4", 32: "<f4", 33: "<f8"}


def _decoded(data, encodings: list[dict]) -> np.ndarray:
    """Encodings undone from the last to the first."""
    value = data
    for e in reversed(encodings):
        kind = e["kind"]
        if kind == "ByteArray":
            if e["type"] not in _TYPES:
                raise ParseError(f"byte array type {e['type']}")
            value = np.frombuffer(value, _TYPES[e["type"]])
        elif kind == "IntegerPacking":
            raw = np.frombuffer(value, _TYPES[{(1, True): 4, (2, True): 5, (1, False): 1, (2, False): 2}[e["byteCount"], bool(e.get("isUnsigned"))]]) if isinstance(value, bytes) else np.asarray(value)
            raw = raw.astype(np.int64)
            bits = 8 * e["byteCount"]
            high, low = ((1 << bits) - 1, None) if e.get("isUnsigned") else ((1 << bits - 1) - 1, -(1 << bits - 1))
            going = (raw == high) | (raw == low if low is not None else False)
            ends = np.flatnonzero(~going)
            total = np.cumsum(raw)[ends]
            value = np.diff(total, prepend=0)
        elif kind == "RunLength":
            pairs = np.asarray(value).reshape(-1, 2)
            value = np.repeat(pairs[:, 0], pairs[:, 1])
        elif kind == "Delta":
            value = np.cumsum(np.asarray(value, np.int64)) + e.get("origin", 0)
        elif kind == "FixedPoint":
            value = np.asarray(value, float) / e["factor"]
        elif kind == "IntervalQuantization":
            value = e["min"] + np.asarray(value, float) * (e["max"] - e["min"]) / (e["numSteps"] - 1)
        else:
            raise ParseError(f"encoding {kind}")
    return value


def decode_column(column: dict) -> list:
    data, encodings = column["data"]["data"], column["data"]["encoding"]
    if encodings and encodings[0]["kind"] == "StringArray":
        e = encodings[0]
        offsets = _decoded(e["offsets"], e["offsetEncoding"]).tolist()
        index = _decoded(data, e["dataEncoding"]).tolist()
        out = [None if i < 0 else e["stringData"][offsets[i] : offsets[i + 1]] for i in index]
    else:
        out = _decoded(data, encodings).tolist()
    if column.get("mask"):
        mask = _decoded(column["mask"]["data"], column["mask"]["encoding"]).tolist()
        out = [None if m else v for m, v in zip(mask, out, strict=True)]
    return out


def parse_bcif(raw: bytes) -> tuple[str | None, list[dict]]:
    blocks = unpack(raw)[0]["dataBlocks"]
    tables = {c["name"].lstrip("_"): c for c in blocks[0]["categories"]}
    if "atom_site" not in tables:
        raise ParseError("no atom_site category")
    site = tables["atom_site"]
    table = {c["name"]: decode_column(c) for c in site["columns"]}
    title = None
    for c in tables.get("struct", {}).get("columns", []):
        if c["name"] == "title":
            title = (decode_column(c) or [None])[0]
    return title, rows_from_columns(table, site["rowCount"], "label")


def parse_bytes(raw: bytes, path: str) -> tuple[str, str | None, list[dict]]:
    """Format, title and raw rows of a file's content; gzip by suffix. No atoms is an error."""
    kind = detect_format(path)
    if path.lower().endswith(".gz"):
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError) as e:
            raise ParseError(f"gzip: {e}") from e
    try:
        if kind == "bcif":
            title, rows = parse_bcif(raw)
        else:
            title, rows = (parse_pdb if kind == "pdb" else parse_mmcif)(raw.decode("utf-8", "replace"))
    except (KeyError, IndexError, TypeError, struct.error, ValueError) as e:
        raise e if isinstance(e, ParseError) else ParseError(f"{kind}: {e}") from e
    if not rows:
        raise ParseError("no atoms")
    return kind, title, rows
