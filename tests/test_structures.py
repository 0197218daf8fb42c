import gzip
import json
import math

import numpy as np
import pytest

from foldscale import cli, provenance, sinks, sql
from foldscale.functions import chemistry as chem
from foldscale.operators import backbone, contacts, interactions, interface, ligands, quality, spatial, summary, superpose, surface
from foldscale.plans.features import features
from foldscale.queries import queries
from foldscale.shared import stored
from foldscale.sources import formats
from foldscale.sources.canonical import canonicalise, readable
from foldscale.sources.scan import parse_status, parse_text, pdb_lines, read_atoms


def line(serial, name, res, chain, seq, x, y, z, element, record="ATOM", alt=" ", occ=1.0, ins=" "):
    return f"{record:<6}{serial:5d} {name:<4}{alt}{res:>3} {chain}{seq:4d}{ins}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{0:6.2f}          {element:>2}"


def atoms_of(spark, *lines, sid=None):
    return parse_text(spark, "\n".join(lines), "pdb", f"/x/{sid}.pdb" if sid else None)


TRIPEPTIDE = [
    line(1, "N", "ALA", "A", 1, 0, 0, 0, "N"), line(2, "CA", "ALA", "A", 1, 1.45, 0, 0, "C"), line(3, "C", "ALA", "A", 1, 2.0, 1.4, 0, "C"), line(4, "O", "ALA", "A", 1, 1.3, 2.4, 0, "O"),
    line(5, "N", "GLY", "A", 2, 3.3, 1.5, 0, "N"), line(6, "CA", "GLY", "A", 2, 4.0, 2.8, 0, "C"), line(7, "C", "GLY", "A", 2, 5.5, 2.6, 0, "C"), line(8, "O", "GLY", "A", 2, 6.0, 1.5, 0, "O"),
    line(9, "N", "SER", "A", 3, 6.2, 3.7, 0, "N"), line(10, "CA", "SER", "A", 3, 7.6, 3.7, 0, "C"), line(11, "C", "SER", "A", 3, 8.2, 5.1, 0, "C"), line(12, "O", "SER", "A", 3, 7.5, 6.1, 0, "O"),
]


def test_altlocs_and_order(spark):
    a = atoms_of(
        spark, line(3, "N", "ALA", "B", 1, 1, 1, 1, "N"), line(1, "CA", "ALA", "A", 2, 20, 0, 0, "C", alt="A", occ=0.4),
        line(2, "CA", "ALA", "A", 2, 21, 0, 0, "C", alt="B", occ=0.6), line(4, "O", "HOH", "A", 1, 0, 0, 0, "O", record="HETATM"), line(5, "C", "ALA", " ", 1, 3, 3, 3, ""),
    ).orderBy("atom_ord").collect()
    assert [(r["chain_label"], r["seq_number"], r["x"]) for r in a] == [("A", 1, 0.0), ("A", 2, 21.0), ("B", 1, 1.0), ("_", 1, 3.0)]
    assert a[1]["atom_id"] == "structure:A:2:_:0:CA" and a[3]["element"] == "C"
    assert [r["res_ord"] for r in a] == [0, 1, 2, 3] and [r["chain_index"] for r in a] == [0, 0, 1, 2]


def test_native_pdb_lines_agree(spark):
    rows = spark.createDataFrame([("structure", x) for x in TRIPEPTIDE], "structure_id string, line string")
    cols = ["atom_id", "x", "y", "z", "element", "res_ord", "atom_ord"]
    native = canonicalise(pdb_lines(rows)).select(*cols).orderBy("atom_ord").collect()
    assert native == atoms_of(spark, *TRIPEPTIDE).select(*cols).orderBy("atom_ord").collect()


def test_mmcif(spark):
    text = "data_x\n_struct.title 'A \"small\" one'\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in "group_PDB id type_symbol label_atom_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z".split())
    text += "ATOM 1 N N ALA A 1 0.0 0.0 0.0\nATOM 2 C CA ALA A 1 1.4 0.0 0.0\nHETATM 3 O \"O5'\" HOH A 2 5.0 . 0.0\n#\n"
    a = parse_text(spark, text, "mmcif")
    s = summary.summary(a).first()
    assert (s["chain_count"], s["residue_count"], s["atom_count"], s["ligand_count"]) == (1, 2, 3, 1)
    assert a.first()["title"] == 'A "small" one' and {r["atom_name"] for r in a.collect()} == {"N", "CA", "O5'"}


def pack(v):
    if isinstance(v, bool) or v is None:
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return bytes([v]) if 0 <= v < 128 else b"\xd3" + v.to_bytes(8, "big", signed=True)
    if isinstance(v, float):
        import struct

        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        return b"\xda" + len(v.encode()).to_bytes(2, "big") + v.encode()
    if isinstance(v, bytes):
        return b"\xc5" + len(v).to_bytes(2, "big") + v
    if isinstance(v, list):
        return b"\xdc" + len(v).to_bytes(2, "big") + b"".join(map(pack, v))
    return b"\xde" + len(v).to_bytes(2, "big") + b"".join(pack(k) + pack(x) for k, x in v.items())


def test_binary_cif_encodings():
    raw = lambda x, t: np.asarray(x, formats._TYPES[t]).tobytes()
    byte = lambda t: {"kind": "ByteArray", "type": t}
    column = lambda data, *enc: formats.decode_column({"data": {"data": data, "encoding": list(enc)}})
    for t in (1, 2, 3, 4, 5, 6, 32, 33):
        assert column(raw([1, 2, 100], t), byte(t)) == [1, 2, 100]
    assert column(raw([1, 3, 7, 2], 3), {"kind": "RunLength"}, byte(3)) == [1, 1, 1, 7, 7]
    assert column(raw([0, 1, 1], 3), {"kind": "Delta", "origin": 10}, byte(3)) == [10, 11, 12]
    assert column(raw([1500], 3), {"kind": "FixedPoint", "factor": 1000}, byte(3)) == [1.5]
    assert column(raw([0, 5, 10], 3), {"kind": "IntervalQuantization", "min": 0.0, "max": 1.0, "numSteps": 11}, byte(3)) == [0, 0.5, 1.0]
    assert column(raw([127, 3, -128, -2, 5], 1), {"kind": "IntegerPacking", "byteCount": 1, "isUnsigned": False, "srcSize": 3}) == [130, -130, 5]
    assert column(raw([255, 255, 1, 0], 4), {"kind": "IntegerPacking", "byteCount": 1, "isUnsigned": True, "srcSize": 2}, byte(4)) == [511, 0]
    strings = {"kind": "StringArray", "dataEncoding": [byte(3)], "stringData": "aAB", "offsetEncoding": [byte(3)], "offsets": raw([0, 1, 3], 3)}
    assert column(raw([0, 1, -1], 3), strings) == ["a", "AB", None]
    masked = {"data": {"data": raw([1, 2], 3), "encoding": [byte(3)]}, "mask": {"data": raw([0, 2], 4), "encoding": [byte(4)]}}
    assert formats.decode_column(masked) == [1, None]


def bcif():
    byte = {"kind": "ByteArray", "type": 33}
    num = lambda n, v: {"name": n, "data": {"data": np.asarray(v, "<f8").tobytes(), "encoding": [byte]}, "mask": None}

    def text(name, values):
        seen = sorted(set(values))
        offsets = np.cumsum([0, *map(len, seen)])
        enc = {"kind": "StringArray", "dataEncoding": [{"kind": "ByteArray", "type": 3}], "stringData": "".join(seen), "offsetEncoding": [{"kind": "ByteArray", "type": 3}], "offsets": offsets.astype("<i4").tobytes()}
        return {"name": name, "data": {"data": np.array([seen.index(v) for v in values], "<i4").tobytes(), "encoding": [enc]}, "mask": None}

    columns = [text("group_PDB", ["ATOM", "HETATM"]), text("label_atom_id", ["CA", "O"]), text("label_comp_id", ["ALA", "HOH"]), text("label_asym_id", ["A", "B"]), text("type_symbol", ["C", "O"]), num("auth_seq_id", [1, 2]), *(num(f"Cartn_{c}", [1.0, 2.0]) for c in "xyz")]
    site = {"name": "_atom_site", "rowCount": 2, "columns": columns}
    return pack({"dataBlocks": [{"header": "X", "categories": [site]}]})


def test_files_formats_and_failures(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdb").write_text("\n".join(TRIPEPTIDE))
    (tmp_path / "in/deep/b.pdb.gz").write_bytes(gzip.compress("\n".join(TRIPEPTIDE).encode()))
    (tmp_path / "in/c.bcif").write_bytes(bcif())
    (tmp_path / "in/bad.cif").write_text("nothing")
    (tmp_path / "in/broken.pdb.gz").write_bytes(b"no gzip")
    (tmp_path / "in/skipped.ent").write_text("\n".join(TRIPEPTIDE))
    (tmp_path / "in/notes.txt").write_text("x")
    (tmp_path / "in/UPPER.PDB").write_text("\n".join(TRIPEPTIDE))
    atoms = read_atoms(spark, str(tmp_path / "in"))
    assert {(r["structure_id"], r["n"]) for r in readable(atoms).groupBy("structure_id").agg({"*": "count"}).toDF("structure_id", "n").collect()} == {("a", 12), ("b", 12), ("c", 2), ("UPPER", 12)}
    status = {r["path"].rsplit("/", 1)[-1]: r["ok"] for r in parse_status(spark, str(tmp_path / "in")).collect()}
    assert status == {"UPPER.PDB": True, "a.pdb": True, "b.pdb.gz": True, "c.bcif": True, "bad.cif": False, "broken.pdb.gz": False}
    assert read_atoms(spark, str(tmp_path / "in/skipped.ent")).count() == 12
    with pytest.raises(formats.ParseError):
        formats.detect_format("x.xyz")


def test_grid_and_plain_joins_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 3}", i, *(float(v) for v in rng.uniform(-6, 6, 3).round(1))) for i in range(400)]
    p = spark.createDataFrame(rows, "structure_id string, atom_ord int, x double, y double, z double")
    for cutoff in (0.7, 2.0, 30.0):
        sets = [{(r["structure_id"], r["atom_ord_a"], r["atom_ord_b"]) for r in spatial.self_pairs(p, cutoff, grid=g).collect()} for g in (False, True)]
        want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= cutoff}
        assert sets[0] == sets[1] == want


def test_interactions(spark):
    kinds = lambda *x: {r["kind"]: r["n"] for r in interactions.interactions(atoms_of(spark, *x)).groupBy("kind").agg({"*": "count"}).toDF("kind", "n").collect()}
    assert kinds(line(1, "SG", "CYS", "A", 1, 0, 0, 0, "S"), line(2, "SG", "CYS", "A", 9, 2.05, 0, 0, "S")) == {"disulfide": 1}
    assert kinds(line(1, "OD1", "ASP", "A", 1, 0, 0, 0, "O"), line(2, "NZ", "LYS", "A", 9, 3, 0, 0, "N")) == {"salt_bridge": 1}
    assert kinds(line(1, "O", "ALA", "A", 1, 0, 0, 0, "O"), line(2, "N", "ALA", "A", 9, 2.9, 0, 0, "N")) == {"hydrogen_bond": 1}
    ring = [line(i + 1, n, "PHE", "A", 1, 1.39 * math.cos(a), 1.39 * math.sin(a), 0, "C") for i, (n, a) in enumerate(zip(("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), np.arange(6) * math.pi / 3, strict=True))]
    assert kinds(*ring, line(9, "NZ", "LYS", "A", 5, 0, 0, 4.0, "N")) == {"cation_pi": 1}
    other = [line(i + 20, n, "PHE", "A", 5, 1.39 * math.cos(a), 1.39 * math.sin(a), 3.8, "C") for i, (n, a) in enumerate(zip(("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), np.arange(6) * math.pi / 3, strict=True))]
    assert kinds(*ring, *other)["pi_pi_parallel"] == 1


def test_surface_and_interface_goldens(spark):
    one = surface.atom_sasa(atoms_of(spark, line(1, "C", "ALA", "A", 1, 0, 0, 0, "C"))).first()
    assert one["sasa"] == pytest.approx(4 * math.pi * 3.1**2, abs=1e-9)
    dimer = atoms_of(spark, line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C"), line(2, "CA", "ALA", "B", 1, 3.5, 0, 0, "C"))
    r = interface.interfaces(dimer).first()
    assert r["bsa"] == pytest.approx(52.50557461043114, abs=1e-6)
    assert r["interface_area"] == pytest.approx(52.50557461043114, abs=1e-6)
    assert r["shape_complementarity"] == pytest.approx(0.002637167596216791, abs=1e-6)
    assert r["contact_count"] == 1
    far = atoms_of(spark, *(line(i + 1, "CA", "ALA", c, 1, x, 0, 0, "C") for i, (c, x) in enumerate((("A", 0), ("B", 4), ("C", 40)))))
    assert [(p["chain_a"], p["chain_b"]) for p in interface.chain_contacts(far).collect()] == [("A", "B")]


def test_torsions_classes_and_states(spark):
    d = backbone.dihedrals(atoms_of(spark, *TRIPEPTIDE)).orderBy("res_ord").collect()
    assert d[0]["phi"] is None and abs(abs(d[1]["phi"]) - 180) < 1e-6 and abs(abs(d[0]["omega"] or 180) - 180) < 1e-6 and d[2]["psi"] is None
    rows = spark.createDataFrame([(-60.0, -45.0, "ALA"), (120.0, 120.0, "GLY"), (-60.0, 150.0, "PRO"), (180.0, 0.0, "ALA"), (None, 1.0, "ALA")], "phi double, psi double, n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(chem.ramachandran(F.col("phi"), F.col("psi"), F.col("n"))).collect()] == ["favored", "outlier", "favored", "outlier", None]
    assert backbone.chain_strings(atoms_of(spark, *TRIPEPTIDE)).first()["ss"] == "CCC"


def helix():
    out, n = [], 1
    # ideal helix: 100 degrees and 1.5 Angstrom a residue
    for i in range(12):
        for name, r, t, z, e in (("N", 1.55, -27.3, -0.87, "N"), ("CA", 2.28, 0.0, 0.0, "C"), ("C", 1.66, 26.1, 1.11, "C"), ("O", 1.93, 21.5, 2.34, "O")):
            a = math.radians(100 * i + t)
            out.append(line(n, name, "ALA", "A", i + 1, r * math.cos(a), r * math.sin(a), 1.5 * i + z, e))
            n += 1
    return out


def test_ideal_helix_is_a_helix(spark):
    assert backbone.chain_strings(atoms_of(spark, *helix())).first()["ss"].count("H") >= 6


def test_quality(spark):
    a = atoms_of(spark, *TRIPEPTIDE[:4], *(line(20 + i, n, "ALA", "A", 7, 0.3 + i, 0.2, 0.1, n[0]) for i, n in enumerate(("N", "CA", "C"))))
    q = quality.residue_quality(a, all_residues=False).orderBy("res_ord").collect()
    s = quality.quality_summary(a).first()
    assert s["missing_backbone_residue_count"] == 1 and q[-1]["missing_backbone"] == ["O"]
    assert s["quality_residue_count"] == 2
    assert quality.clashes(a).where("residue_id_a = residue_id_b").count() == 0
    with pytest.raises(ValueError):
        quality.clashes(a, overlap=-1)


def test_ligands(spark):
    a = atoms_of(spark, line(1, "CA", "ALA", "A", 1, 3.5, 0, 0, "C"), line(2, "CA", "ALA", "A", 2, 6.5, 0, 0, "C"), line(3, "OD1", "ASP", "A", 3, 0, 2.8, 0, "O"), line(4, "N1", "HEM", "A", 9, 0, 0, 0, "N", "HETATM"), line(5, "O", "HOH", "A", 10, 0, 0, 3.0, "O", "HETATM"))
    r = ligands.ligand_features(a).first()
    assert len(r["binding_site_residues"]) == 2 and r["interactions"]["hydrogen_bond"] == 2 and r["residue_name"] == "HEM"
    assert ligands.ligand_features(a, chem.LigandFilter(include=["hoh"])).first()["residue_name"] == "HOH"
    assert ligands.ligand_features(a, chem.LigandFilter(exclude=["HEM"])).count() == 0
    s = ligands.ligand_summary(a).first()
    assert (s["ligand_count"], s["binding_site_residue_count"], s["protein_ligand_contact_count"]) == (1, 2, 3)


def test_alignment_and_superposition():
    assert len(superpose.global_pairs("ACDEFG", "ACEFG")) == 5
    local = superpose.local_pairs("WWWDEFGHWW", "YYDEFGHYYY")
    assert len(local) == 5 and local[0] == (3, 2)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    fit = superpose.superpose(x, x @ turn.T + 5)
    assert fit.rmsd < 1e-6 and np.allclose((x @ turn.T + 5) @ fit.rotation.T + fit.translation, x)
    with pytest.raises(superpose.RmsdError):
        superpose.superpose(x, x[:3])
    with pytest.raises(superpose.RmsdError):
        superpose.compare_pair("AAA", x[:3], "CCC", x[:3], superpose.RmsdParams(align=True))

    def slow(a, b):  # the plain table
        s = [[-(i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1)
        return s[-1][-1]

    for _ in range(20):
        a, b = ("".join(rng.choice(list("ACD"), rng.integers(1, 15))) for _ in "ab")
        pairs = superpose.global_pairs(a, b)
        gaps = len(a) + len(b) - 2 * len(pairs)
        assert sum(1 if a[i] == b[j] else -1 for i, j in pairs) - gaps == slow(a, b)


def test_graphs(spark):
    a = atoms_of(spark, line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C"), line(2, "CA", "ALA", "A", 2, 3.8, 0, 0, "C"), line(3, "CA", "ALA", "B", 1, 0, 5, 0, "C"))
    e = {(r["a"], r["b"]): r["kind"] for r in contacts.residue_graph(a).collect()}
    assert e == {(0, 1): "covalent_adjacency", (0, 2): "distance_contact", (1, 2): "distance_contact"}
    assert contacts.interface_graph(a).count() == 2
    found = spark.createDataFrame([("structure", "hydrogen_bond", "x", "y", 0, 1, 2.9), ("structure", "hydrogen_bond", "x", "y", 0, 2, 2.9), ("structure", "cation_pi", "x", "y", 1, 2, 3.0)], "structure_id string, kind string, atom_id_a string, atom_id_b string, res_a int, res_b int, distance double")
    e = {(r["a"], r["b"]): r["kind"] for r in contacts.residue_graph(a, interactions=found).collect()}
    assert e == {(0, 1): "covalent_adjacency", (0, 2): "hydrogen_bond", (1, 2): "distance_contact"}


def test_features_sinks_sql_and_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdb").write_text("\n".join([*TRIPEPTIDE, line(20, "N1", "HEM", "B", 1, 2, 2, 3, "N", "HETATM")]))
    (tmp_path / "in/b.pdb").write_text("\n".join(helix()))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run_id, text = cli.run(spark, ["featurize", src, "--out", out, "--provenance", "--sqlite", f"{out}/p/runs.db", "--jsonl", f"{out}/p/log.jsonl"]).split("\n", 1)
    manifest = json.loads(text)
    assert json.load(open(f"{out}/manifest.json")) == manifest and run_id.startswith("run_id=")
    log = [json.loads(x) for x in open(f"{out}/p/log.jsonl")]
    assert [x["event"] for x in log] == ["parse_start", "feature_complete"] * 2 + ["write_complete", "run_complete"] and log[1]["structure_id"] == "a"
    table = spark.read.parquet(manifest["parquet_path"])
    assert table.schema["centroid"].dataType.typeName() == "string" and len(table.columns) == 56
    rows = {r["structure_id"]: r for r in table.collect()}
    assert rows["a"]["ligand_count"] == 1 and rows["a"]["interface_pair_count"] == 1 and rows["b"]["helix_residue_count"] >= 6
    assert rows["b"]["interface_chain_a"] == "" and rows["b"]["connected_components"] == 1 and len(json.loads(rows["b"]["centroid"])) == 3
    assert "structure_failed" not in open(f"{out}/p/log.jsonl").read() and len(provenance.runs(f"{out}/p/runs.db")) == 1
    assert "| a " in cli.run(spark, ["query", out, "--sql", "SELECT structure_id, atom_count FROM features ORDER BY 1"])
    refused = ("DROP VIEW features", f"FROM features INSERT OVERWRITE DIRECTORY '{out}/x' USING parquet SELECT *", f"WITH x AS (SELECT 1) INSERT OVERWRITE DIRECTORY '{out}/x' USING parquet SELECT * FROM x",
               "CREATE TABLE t AS SELECT 1", "INSERT INTO t VALUES (1)", "SET a = b", "BEGIN SELECT 1; END", "", "nonsense")
    for statement in refused:
        with pytest.raises(ValueError):
            sql.query(spark, out, statement)
    for statement in ("WITH x AS (SELECT * FROM features) SELECT count(*) FROM x", "FROM features SELECT structure_id", "DESCRIBE features", "VALUES (1)", "SELECT 1 UNION SELECT 2 ORDER BY 1"):
        assert sql.query(spark, out, statement).count() >= 1
    assert "atoms=13" in cli.run(spark, ["parse", f"{src}/a.pdb"])
    for kind in ("graphml", "gml", "json", "html"):
        path = cli.run(spark, ["graph", f"{src}/a.pdb", "--format", kind, "--out", f"{out}/g.{kind}"])
        assert len(open(path).read()) > 100
    assert cli.run(spark, ["rmsd", f"{src}/b.pdb", f"{src}/b.pdb", "--align"]) == "rmsd=0.0000; atoms=12; selection=aligned-ca"
    for command, n in (("ligands", 1), ("interfaces", 1), ("quality", 0), ("residues", 16)):
        records = [json.loads(x) for x in cli.run(spark, [command, src]).splitlines()]
        assert len(records) == n or command == "quality", command
        assert {r["structure_id"] for r in records} <= {"a", "b"}
    with pytest.raises(ValueError, match="more"):
        cli.run(spark, ["graph", src])
    assert 'const t="ATOM      1' in open(f"{out}/g.html").read()
    result = json.loads(cli.run(spark, ["compare", src, "--delta-fields", "sasa_total,atom_count"]))
    assert result["reference_mode"] == "first_input" and result["reference_path"].endswith("in/a.pdb")
    (tmp_path / "none").mkdir()
    (tmp_path / "none/notes.txt").write_text("x")
    for command in (["parse"], ["featurize", "--out", out], ["ligands"], ["compare"]):
        with pytest.raises(ValueError, match="no supported structures"):
            cli.run(spark, [command[0], str(tmp_path / "none"), *command[1:]])
    assert result["structure_count"] == 2 and result["matrix"]["rmsd"][0][0] == 0.0 and "delta_sasa_total" in result["deltas"][0]
    sinks.write_comparison(spark, result, f"{out}/cmp", "csv")
    assert open(f"{out}/cmp/matrix.csv").read().startswith(",a,b") and open(f"{out}/cmp/deltas.csv").read().startswith("structure_id,source_path,")
    text = sinks.to_pdb(read_atoms(spark, f"{src}/b.pdb"))
    assert len(formats.parse_pdb(text)[1]) == 48 and text.endswith("END\n")


def test_files_of_one_name_are_two_structures(spark, tmp_path):
    for folder, n in (("pdb", 8), ("mmcif", 12)):
        (tmp_path / folder).mkdir()
        (tmp_path / f"{folder}/1abc.pdb").write_text("\n".join(TRIPEPTIDE[:n]))
    atoms = read_atoms(spark, str(tmp_path))
    table = stored(features(atoms), "features")
    rows = table.orderBy("source_path").collect()
    assert [(r["structure_id"], r["atom_count"], r["residue_count"]) for r in rows] == [("1abc", 12, 3), ("1abc", 8, 2)]
    assert {r["chain_id"] for r in atoms.select("chain_id").collect()} == {"1abc:A"}
    first = superpose.pick_reference(table, f"{tmp_path}/pdb/1abc.pdb")
    assert first["source_path"].endswith("/pdb/1abc.pdb") and superpose.rmsd_matrix(atoms)[0] == ["1abc", "1abc"]
    assert [d["delta_atom_count"] for d in superpose.deltas(table, first, ["atom_count"]).collect()] == [4]


def test_quality_goldens(spark):
    def model(*rows):
        return atoms_of(spark, *(line(i + 1, n, "ALA", "A", s, x, y, 0, n[0]) for i, (n, s, x, y) in enumerate(rows)))

    two = model(("N", 1, 0, 0), ("CA", 1, 1.458, 0), ("C", 1, 2.009, 1.42), ("O", 1, 2.5, 2.2), ("N", 2, 3.332, 1.54), ("CA", 2, 3.97, 2.84), ("C", 2, 5.48, 2.7), ("O", 2, 6, 3.6))
    s = quality.quality_summary(two).first().asDict()
    assert s.pop("structure_id") == "structure" and s.pop("quality_residue_count") == 2 and set(s.values()) == {0}
    assert quality.residue_quality(two, all_residues=False).count() == 0
    panel = model(
        ("N", 1, 0, 0), ("CA", 1, 0, 0), ("C", 1, 1.5, 0), ("O", 1, 2, 1), ("N", 2, 10, 0), ("CA", 2, 11.458, 0), ("C", 2, 12.009, 1.42), ("O", 2, 13, 1),
        ("N", 3, 2, 0), ("CA", 3, 2, 0), ("C", 3, 3.5, 0), ("O", 3, 4, 1), ("N", 4, 5, 0), ("CA", 4, 6.458, 0), ("C", 4, 7.009, 1.42),
    )
    s = quality.quality_summary(panel).first().asDict()
    assert (s["quality_residue_count"], s["ramachandran_evaluated_count"], s["clash_pair_count"], s["missing_backbone_residue_count"]) == (4, 0, 12, 1)
    found = quality.residue_quality(panel, all_residues=False).orderBy("seq_number").collect()
    assert [(r["seq_number"], r["phi"], r["missing_backbone"], r["clash_count"]) for r in found] == [(1, None, [], 12), (3, None, [], 12), (4, None, ["O"], 0)]


def test_compare_goldens(spark):
    rows = [line(i + 1, "CA", n, "A", i + 1, x, y, 0, "C") for i, (n, x, y) in enumerate((("ALA", 0, 0), ("GLY", 1, 0), ("VAL", 0, 1)))]
    atoms = None
    for i, x in enumerate((0.0, 0.5, 1.0), 1):
        one = atoms_of(spark, line(1, "CA", "ALA", "A", 1, x, 0, 0, "C"), *rows[1:], sid=f"s{i}")
        atoms = one if atoms is None else atoms.unionByName(one)
    labels, matrix = superpose.rmsd_matrix(atoms, superpose.RmsdParams(atoms="ca"))
    want = [[0.0, 0.2183097158051996, 0.4314632312985458], [0.2183097158051996, 0.0, 0.2183097158051996], [0.4314632312985458, 0.2183097158051996, 0.0]]
    assert labels == ["s1", "s2", "s3"] and np.allclose(matrix, want, atol=1e-6)
    table = spark.createDataFrame([(f"s{i}", None, 900.0 + 100 * i) for i in (1, 2, 3)], "structure_id string, source_path string, sasa_total double")
    first = superpose.pick_reference(table)
    found = superpose.deltas(table, first, ["sasa_total"]).orderBy("structure_id").collect()
    assert first["structure_id"] == "s1" and [tuple(r) for r in found] == [("s2", None, 1100.0, 1000.0, 100.0), ("s3", None, 1200.0, 1000.0, 200.0)]
    with pytest.raises(ValueError):
        superpose.rmsd_matrix(atoms, most=2)


def test_surfaces_of_structures_over_many_cubes(spark):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-150, 150, (400, 3)).round(2)
    xyz[200:] = xyz[:200] + rng.uniform(-2, 2, (200, 3)).round(2)  # neighbours, some of them in other cubes
    xyz[:4] = [[47.9, 0, 0], [48.1, 0, 0], [-48, 48, 48], [-48.5, 47.5, 48]]
    rows = [("s", i, i % 3, *map(float, p), "CNOS"[i % 4], "CA") for i, p in enumerate(xyz)]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_ord long, chain_index int, x double, y double, z double, element string, atom_name string")
    got = {r["atom_ord"]: (r["points"], r["points_alone"], r["open_low"], r["open_high"]) for r in surface.atom_sasa(atoms).collect()}
    radius = np.array([{"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}[r[6]] + 1.4 for r in rows])
    chain = np.array([r[2] for r in rows])
    for i in range(len(rows)):
        p = xyz[i] + surface.POINTS * radius[i]
        inside = ((p[:, None] - xyz[None]) ** 2).sum(axis=2) <= radius**2
        inside[:, i] = False
        bits = int.from_bytes(np.packbits(~inside.any(axis=1), bitorder="little").tobytes(), "little")
        mask = (1 << 64) - 1
        assert got[i] == ((~inside.any(axis=1)).sum(), (~inside[:, chain == chain[i]].any(axis=1)).sum(), got[i][2], got[i][3])
        assert (got[i][2] & mask, got[i][3] & mask) == (bits & mask, bits >> 64)


def test_graph_statistics_against_brute_force(spark):
    rng = np.random.default_rng(6)
    nodes, edges, want = [], [], {}
    for s, n in enumerate((1, 2, 7, 30, 12)):
        links = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25}
        near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(n)}
        local = [sum((min(x, y), max(x, y)) in links for x in near[i] for y in near[i] if x < y) / (len(near[i]) * (len(near[i]) - 1) / 2) if len(near[i]) > 1 else 0.0 for i in range(n)]
        left, parts = set(range(n)), 0
        while left:
            todo, parts = [left.pop()], parts + 1
            while todo:
                new = near[todo.pop()] & left
                left -= new
                todo += new
        want[f"s{s}"] = (len(links), len(links) / (n * (n - 1) / 2) if n > 1 else 0.0, sum(local) / n, parts, [len(near[i]) for i in range(n)])
        nodes += [(f"s{s}", 3 * i) for i in range(n)]
        edges += [(f"s{s}", 3 * a, 3 * b) for a, b in links]
    got = contacts.graph_statistics(spark.createDataFrame(nodes, "structure_id string, node int"), spark.createDataFrame(edges, "structure_id string, a int, b int")).collect()
    assert {r[0] for r in got} == set(want)
    for r in got:
        e = want[r[0]]
        assert (r[1], r[4], r[5]) == (e[0], e[3], e[4]) and r[2:4] == pytest.approx(e[1:3])


def test_bonds_of_residues_without_ca(spark):
    rows = [x for i, x in enumerate(helix()) if i not in (5, 13, 29)]  # CA of three residues
    a = atoms_of(spark, *rows)
    found = [sorted(map(tuple, backbone.hydrogen_bonds(a, grid=g).collect())) for g in (None, False)]
    assert found[0] == found[1] and len(found[0]) >= 6


def test_pairs_of_structures_once(spark):
    a = atoms_of(spark, *TRIPEPTIDE, sid="s0")
    for i in range(1, 9):
        a = a.unionByName(atoms_of(spark, *TRIPEPTIDE, sid=f"s{i}"))
    got = [(r["id_a"], r["id_b"]) for r in superpose.rmsd_pairs(a, partitions=3).collect()]
    assert len(got) == len(set(got)) == 36 and all(x < y for x, y in got)


def test_package_is_found_from_other_folders(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "a.pdb").write_text("\n".join(TRIPEPTIDE))
    code = f"""import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from foldscale.sources.scan import read_atoms
from foldscale.operators.surface import atom_sasa
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print(atom_sasa(read_atoms(spark, {str(tmp_path)!r})).count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("12"), out.stderr[-2000:]


def test_stream_adds_new_files(spark, tmp_path):
    from foldscale.streaming.incremental import feature_stream

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.pdb").write_text("\n".join(TRIPEPTIDE))
        feature_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {r["structure_id"] for r in spark.read.parquet(str(tmp_path / "out")).select("structure_id").collect()} == {"a", "b"}


def test_registered_queries_against_sql(spark):
    import duckdb

    from foldscale import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    assert set(queries.oracle_sql()) == set(queries.queries())
    for name in ("structure_features", "alternate_locations", "quality_of_incomplete_models", "structure_rmsd_pairs", "residue_interaction_graph"):
        got, want = queries.queries()[name](spark, folder).toPandas(), con.sql(queries.oracle_sql()[name]).df()
        c = sorted(want.columns)
        rows = lambda f: sorted(map(str, f[c].astype(object).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name


@pytest.mark.parametrize("name", ["atom_contact_graph", "large_structure_contacts"])
def test_distance_joins_gather_no_side_on_the_driver(spark, name):
    """The estimate of a side is that of its file's columns, far below the rows in its cells."""
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["interface_features", "structure_features"])
def test_feature_joins_gather_no_side_on_the_driver(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rmsd_pairs_carry_no_structures(spark):
    """Cells are compared as a whole: no join, so nothing is gathered and no pair's row holds two structures."""
    plan = queries()["structure_rmsd_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_rmsd_pairs_of_unequal_structures(spark):
    """Blocks of structures of several sizes, an empty selection among them, give what single superpositions give."""
    rng = np.random.default_rng(5)
    xyz = {f"é{k}": rng.normal(size=(n, 3)) * 9 for k, n in enumerate((4, 7, 4, 0, 7, 1, 4, 0, 1))}
    rows = [(s, i, "CA", *map(float, p)) for s, points in xyz.items() for i, p in enumerate(points)]
    rows += [(s, 99, "N", 0.0, 0.0, 0.0) for s in xyz]
    a = spark.createDataFrame(rows, "structure_id string, atom_ord long, atom_name string, x double, y double, z double")
    for parts in (None, 1, 5):
        got = {(r["id_a"], r["id_b"]): r["rmsd"] for r in superpose.rmsd_pairs(a, superpose.RmsdParams(), parts).collect()}
        assert sorted(got) == [(s, t) for s in sorted(xyz) for t in sorted(xyz) if s < t]
        for (s, t), rmsd in got.items():
            if len(xyz[s]) != len(xyz[t]) or not len(xyz[s]):
                assert rmsd is None
            else:
                assert rmsd == pytest.approx(superpose.superpose(xyz[s], xyz[t]).rmsd, abs=1e-6)
