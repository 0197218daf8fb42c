"""Command line: parse, featurize, ligands, interfaces, quality, residues, graph, query, compare, rmsd, provenance."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscale import provenance, sinks, sql
from foldscale.functions.chemistry import LigandFilter
from foldscale.operators import contacts, interactions, interface, ligands, quality, summary, superpose
from foldscale.operators.interface import InterfaceParams
from foldscale.plans import features as plans
from foldscale.shared import scratch
from foldscale.sources.canonical import SEPARATOR, readable, residues
from foldscale.sources.scan import parse_status, read_atoms, require_files


def _list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldscale", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, *groups):
        p = sub.add_parser(name)
        if name not in ("rmsd", "provenance"):
            p.add_argument("input")
        if "ligand" in groups:
            p.add_argument("--ligand-exclude", type=_list, default=[])
            p.add_argument("--ligand-include", type=_list, default=[])
            p.add_argument("--binding-distance", type=float, default=5.0)
        if "interface" in groups:
            for n, d in (("--interface-distance", 8.0), ("--interface-area-distance", 5.0), ("--interface-sc-distance", 5.0)):
                p.add_argument(n, type=float, default=d)
        if "quality" in groups:
            p.add_argument("--clash-overlap", type=float, default=0.4)
            p.add_argument("--all-residues", action="store_true")
        return p

    add("parse").add_argument("--format", choices=("text", "json"), default="text")
    p = add("featurize", "ligand", "interface", "quality")
    p.add_argument("--features", default="all")
    p.add_argument("--out", required=True)
    p.add_argument("--provenance", action="store_true")
    p.add_argument("--sqlite")
    p.add_argument("--jsonl")
    p.add_argument("--guard", action="store_true")
    p.add_argument("-j", "--jobs", type=int)
    for name, groups in (("ligands", ("ligand",)), ("interfaces", ("interface",)), ("quality", ("quality",)), ("residues", ())):
        add(name, *groups).add_argument("--out")
    p = add("graph")
    p.add_argument("--graph-type", choices=("residue", "interface", "atom"), default="residue")
    p.add_argument("--format", choices=("graphml", "gml", "json", "html"), default="graphml")
    p.add_argument("--out")
    p.add_argument("--ring-edges", action="store_true")
    add("query").add_argument("--sql", required=True)
    p = add("compare", "ligand", "interface", "quality")
    p.add_argument("--reference")
    p.add_argument("--auto-reference", action="store_true")
    p.add_argument("--reference-by")
    p.add_argument("--atoms", default="ca")
    p.add_argument("--align", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--local", action="store_true")
    p.add_argument("--delta-fields", type=_list, default=[])
    p.add_argument("--format", choices=("json", "csv"), default="json")
    p.add_argument("--out")
    p = add("rmsd")
    p.add_argument("reference")
    p.add_argument("mobile")
    p.add_argument("--atoms", default="ca")
    p.add_argument("--align", action="store_true")
    p.add_argument("--local", action="store_true")
    add("provenance").add_argument("sqlite")
    return top


def _params(a) -> dict:
    return {
        "ligand_filter": LigandFilter(a.ligand_include, a.ligand_exclude), "binding_distance": a.binding_distance,
        "interface_params": InterfaceParams(a.interface_distance, a.interface_area_distance, a.interface_sc_distance),
        "clash_overlap": a.clash_overlap,
    }


def _records(df: DataFrame, out: str | None) -> str:
    """Records as JSON lines: written where asked for, else returned for the terminal."""
    df = readable(df)
    if out:
        return sinks.write_lines(df, out)
    return "\n".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect())


def compare(spark: SparkSession, a) -> dict:
    require_files(spark, a.input)
    status = parse_status(spark, a.input)
    if status.count() < 2:
        raise ValueError("compare needs at least two inputs")
    failed = [r.asDict() for r in status.where("not ok").select("path", "error").collect()]
    atoms = read_atoms(spark, a.input).persist()
    table = plans.features(atoms, **_params(a)).persist()
    if table.count() < 2:
        raise ValueError("compare needs at least two structures that can be parsed")
    by = tuple(a.reference_by.split(":", 1)) if a.reference_by else None
    by = (by[0], by[1] if len(by) > 1 else "min") if by else None
    ref = superpose.pick_reference(table, a.reference, None if a.reference else by, a.auto_reference)
    labels, matrix = superpose.rmsd_matrix(atoms, superpose.RmsdParams(a.atoms, a.align, a.local))
    mode = "explicit" if a.reference else "reference_by" if by else "auto_quality" if a.auto_reference else "first_input"
    out = {
        "reference_id": ref["structure_id"], "reference_path": ref["source_path"], "reference_mode": mode, "structure_count": len(labels), "structures": labels,
        "matrix": {"labels": labels, "rmsd": matrix},
        "deltas": [r.asDict() for r in superpose.deltas(table, ref, a.delta_fields).orderBy("source_path").collect()],
    }
    return out | ({"failed": failed} if failed else {})


def featurize(spark: SparkSession, a) -> str:
    require_files(spark, a.input)
    manifest = sinks.write_features(plans.features(read_atoms(spark, a.input), **_params(a)), a.out)
    text = json.dumps(manifest, indent=2)
    if not a.provenance:
        return text
    done = spark.read.parquet(manifest["parquet_path"]).select("structure_id", F.col("source_path").alias("path"))
    status = parse_status(spark, a.input).join(done, "path", "left").orderBy("path")
    with provenance.Recorder("featurize", a.sqlite or f"{a.out}/run.sqlite", a.jsonl or f"{a.out}/events.jsonl") as log:
        for r in status.toLocalIterator():
            log.record("parse_start", path=r["path"])
            if r["ok"]:
                log.record("feature_complete", r["structure_id"], path=r["path"])
            else:
                log.record("structure_failed", path=r["path"], error=r["error"])
        log.record("write_complete", manifest=manifest["feature_records_path"], record_count=done.count())
        log.record("run_complete")
        return f"run_id={log.run_id}\n{text}"


def graph(spark: SparkSession, a) -> str:
    atoms = read_atoms(spark, a.input).persist()
    found = atoms.select("structure_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a graph needs one structure that can be parsed, {a.input} has {'more' if found else 'none'}")
    sid = found[0]["structure_id"].split(SEPARATOR)[0]
    r = residues(atoms).select("structure_id", F.col("res_ord").alias("node"), F.col("residue_id").alias("id"), "residue_name", "chain_id", "seq_number")
    if a.graph_type == "atom":
        edges = contacts.atom_graph(atoms)
        nodes = atoms.select("structure_id", F.col("atom_ord").alias("node"), F.col("atom_id").alias("id"), "atom_name", "element", "residue_id")
    else:
        found = interactions.interactions(atoms)
        make = contacts.residue_graph if a.graph_type == "residue" else contacts.interface_graph
        edges = make(atoms, interactions=found, ring_edges=a.ring_edges).persist()
        nodes = r
        if a.graph_type == "interface":
            nodes = r.join(edges.select("structure_id", F.explode(F.array("a", "b")).alias("node")).distinct(), ["structure_id", "node"], "left_semi")
    n, e = sinks.graph_rows(nodes, edges)
    page = lambda x, y: sinks.to_html(x, y, sid, sinks.to_pdb(atoms))
    text = {"graphml": sinks.to_graphml, "gml": sinks.to_gml, "json": sinks.to_node_link}.get(a.format, page)(n, e)
    return sinks.write_text(spark, a.out or os.path.abspath(f"{sid}.{a.graph_type}.{a.format}"), text)


def run(spark: SparkSession, argv: list[str]) -> str:
    a = parser().parse_args(argv)
    if a.command == "featurize":
        return featurize(spark, a)
    if a.command == "query":
        return sql.text_table(sql.query(spark, a.input, a.sql))
    if a.command == "provenance":
        return "\n".join(provenance.runs(a.sqlite))
    if a.command == "graph":
        return graph(spark, a)
    if a.command == "rmsd":
        params = superpose.RmsdParams(a.atoms, a.align, a.local)
        sides = [superpose.profiles(read_atoms(spark, p), params).first() for p in (a.reference, a.mobile)]
        import numpy as np

        xyz = [np.column_stack([s[c] for c in "xyz"]).reshape(-1, 3) for s in sides]
        rmsd, n, selection = superpose.compare_pair(sides[0]["letters"], xyz[0], sides[1]["letters"], xyz[1], params)
        return f"rmsd={rmsd:.4f}; atoms={n}; selection={selection}"
    if a.command == "compare":
        result = compare(spark, a)
        if a.out:
            sinks.write_comparison(spark, result, a.out, a.format)
            return a.out
        return json.dumps(result, indent=2)
    require_files(spark, a.input)
    atoms = read_atoms(spark, a.input)
    if a.command == "parse":
        rows = readable(summary.summary(atoms).orderBy("structure_id")).collect()
        if not rows:
            raise ValueError(f"nothing could be parsed in {a.input}")
        if a.format == "json":
            return json.dumps([r.asDict() for r in rows] if len(rows) > 1 else rows[0].asDict(), indent=2)
        line = "structure_id={}; chains={}; residues={}; atoms={}; heteroatoms={}; ligands={}"
        return "\n".join(line.format(*(r[c] for c in ("structure_id", "chain_count", "residue_count", "atom_count", "heteroatom_count", "ligand_count"))) for r in rows)
    if a.command == "ligands":
        return _records(ligands.ligand_features(atoms, LigandFilter(a.ligand_include, a.ligand_exclude), a.binding_distance), a.out)
    if a.command == "interfaces":
        return _records(interface.interfaces(atoms, InterfaceParams(a.interface_distance, a.interface_area_distance, a.interface_sc_distance)), a.out)
    if a.command == "quality":
        return _records(quality.residue_quality(atoms, a.clash_overlap, a.all_residues).orderBy("structure_id", "res_ord"), a.out)
    return _records(plans.residue_features(atoms).orderBy("structure_id", "res_ord"), a.out)


def main() -> None:
    spark = SparkSession.builder.appName("foldscale").getOrCreate()
    try:
        with scratch(spark):
            print(run(spark, sys.argv[1:]))
    except ValueError as e:
        sys.exit(f"error: {e}")


if __name__ == "__main__":
    main()
