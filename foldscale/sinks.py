"""Writers of results: JSON lines, Parquet, graph files, comparison reports, PDB text."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscale.plans.features import flat


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text as one file in any store that Spark can write to."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return path


def write_lines(df: DataFrame, path: str) -> str:
    """One JSON object per row as a distributed text data set; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return path


def write_features(table: DataFrame, out: str) -> dict:
    """``features.jsonl`` (nested), ``features.parquet`` (arrays as JSON text) and ``manifest.json``."""
    names = [c for c in table.columns if c not in ("structure_id", "source_path")]
    nested = table.orderBy("source_path", "structure_id").select("structure_id", "source_path", F.struct(*names).alias("features"))
    manifest = {
        "feature_records_path": write_lines(nested, f"{out}/features.jsonl"),
        "parquet_path": f"{out}/features.parquet",
        "notes": [
            "Parquet is the primary analytical output; query it with SQL over the view features.",
            "JSONL is written alongside as a line-oriented interchange format.",
        ],
    }
    flat(table).write.mode("overwrite").parquet(manifest["parquet_path"])
    write_text(table.sparkSession, f"{out}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one structure's graph in order; a report for one structure, so it is collected."""
    found = [r.asDict() for r in nodes.orderBy("node").collect()]
    place = {r["node"]: i for i, r in enumerate(found)}
    links = [r.asDict() for r in edges.orderBy("a", "b").collect()]
    used = [{"source": place[e["a"]], "target": place[e["b"]], "distance": e["distance"], "kind": e["kind"]} for e in links]
    return [{k: v for k, v in r.items() if k not in ("node", "structure_id")} for r in found], used


def to_graphml(nodes: list[dict], edges: list[dict]) -> str:
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <graph edgedefault="undirected">']
    for n in nodes:
        data = "".join(f'<data key="{k}">{v}</data>' for k, v in n.items() if k != "id")
        lines.append(f'    <node id="{n["id"]}">{data}</node>')
    for e in edges:
        ends = f'source="{nodes[e["source"]]["id"]}" target="{nodes[e["target"]]["id"]}"'
        lines.append(f'    <edge {ends}><data key="kind">{e["kind"]}</data><data key="distance">{e["distance"]:.3f}</data></edge>')
    return "\n".join([*lines, "  </graph>", "</graphml>", ""])


def _gml_value(value) -> str:
    text = str(value)
    if re.fullmatch(r"[+-]?\d+", text):
        return str(int(text))
    try:
        return f"{float(text):g}"
    except ValueError:
        return f'"{text}"'


def to_gml(nodes: list[dict], edges: list[dict]) -> str:
    lines = ["graph [", "  directed 0"]
    for i, n in enumerate(nodes):
        lines += ["  node [", f"    id {i}", f'    label "{n["id"]}"', *(f"    {k} {_gml_value(v)}" for k, v in n.items() if k != "id"), "  ]"]
    for e in edges:
        lines += ["  edge [", f"    source {e['source']}", f"    target {e['target']}", f"    distance {e['distance']:.3f}", f'    kind "{e["kind"]}"', "  ]"]
    return "\n".join([*lines, "]", ""])


def to_node_link(nodes: list[dict], edges: list[dict]) -> str:
    listed = [{"id": i, **{("name" if k == "id" else k): v for k, v in n.items()}} for i, n in enumerate(nodes)]
    return json.dumps({"nodes": listed, "links": edges}, indent=2)


def to_html(nodes: list[dict], edges: list[dict], title: str, pdb: str = "") -> str:
    """A self-contained page: the graph with nodes on a circle, names on hover, and the structure's CA trace, turned by
    dragging. The structure's text is part of the page."""
    data = to_node_link(nodes, edges).replace("</", "<\\/")
    text = json.dumps(pdb).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><svg id="g" viewBox="-110 -110 220 220" width="48%"></svg>
<canvas id="v" width="600" height="600"></canvas>
<script>const t={text},q=t.split("\\n").filter(l=>/^(ATOM|HETATM)/.test(l)&&l.slice(12,16).trim()=="CA").map(l=>[30,38,46].map(i=>+l.slice(i,i+8)).concat(l[21]));
const m=[0,1,2].map(i=>q.reduce((s,a)=>s+a[i],0)/(q.length||1)),w=Math.max(1,...q.map(a=>Math.hypot(a[0]-m[0],a[1]-m[1],a[2]-m[2]))),k=document.getElementById("v"),c=k.getContext("2d");let u=0,v=0;
function draw(){{c.clearRect(0,0,600,600);let o;q.forEach(a=>{{const[x,y,z]=[0,1,2].map(i=>(a[i]-m[i])*280/w),r=x*Math.cos(u)+z*Math.sin(u),d=z*Math.cos(u)-x*Math.sin(u),e=[300+r,300+y*Math.cos(v)-d*Math.sin(v),a[3]];
if(o&&o[2]==e[2]){{c.beginPath();c.moveTo(o[0],o[1]);c.lineTo(e[0],e[1]);c.stroke()}}c.fillRect(e[0]-2,e[1]-2,4,4);o=e}})}}
k.onpointermove=e=>{{if(e.buttons){{u+=e.movementX/100;v+=e.movementY/100;draw()}}}};draw()</script>
<script>const g={data},s=document.getElementById("g"),n=g.nodes.length,p=i=>[100*Math.cos(6.2832*i/n),100*Math.sin(6.2832*i/n)];
const add=(t,a)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",t);for(const k in a)e.setAttribute(k,a[k]);s.append(e);return e}};
g.links.forEach(l=>{{const[a,b]=p(l.source),[c,d]=p(l.target);add("line",{{x1:a,y1:b,x2:c,y2:d,stroke:"#999","stroke-width":.3}})}});
g.nodes.forEach((x,i)=>{{const[a,b]=p(i);const c=add("circle",{{cx:a,cy:b,r:1.5}});const t=document.createElementNS("http://www.w3.org/2000/svg","title");t.textContent=x.name;c.append(t)}});</script>
"""


def to_pdb(atoms: DataFrame) -> str:
    """One structure as PDB text: every atom as ATOM, serials from 1."""
    rows = atoms.orderBy("atom_ord").collect()
    line = "ATOM  {:5d} {:4} {:3} {}{:4d}{}   {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:<2}"
    text = [
        line.format(i, r["atom_name"], r["residue_name"], r["chain_id"][-1], r["seq_number"], r["insertion_code"] or " ", r["x"], r["y"], r["z"], 1.0 if r["occupancy"] is None else r["occupancy"], r["temp_factor"] or 0.0, r["element"] or " ")
        for i, r in enumerate(rows, 1)
    ]
    return "\n".join([*text, "END", ""])


def csv_cell(value) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",\n\r]', text) else text


def matrix_csv(labels: list[str], matrix: list[list]) -> str:
    rows = [",".join(["", *labels])]
    rows += [",".join([label, *("" if v is None else str(v) for v in row)]) for label, row in zip(labels, matrix, strict=True)]
    return "\n".join(rows) + "\n"


def write_comparison(spark: SparkSession, result: dict, out: str, kind: str = "json") -> None:
    if kind == "json":
        write_text(spark, f"{out}/matrix.json", json.dumps(result["matrix"], indent=2))
        write_text(spark, f"{out}/deltas.jsonl", "".join(json.dumps(d) + "\n" for d in result["deltas"]))
    elif kind == "csv":
        write_text(spark, f"{out}/matrix.csv", matrix_csv(result["matrix"]["labels"], result["matrix"]["rmsd"]))
        keys = ["structure_id", "source_path", *sorted({k for d in result["deltas"] for k in d} - {"structure_id", "source_path"})]
        write_text(spark, f"{out}/deltas.csv", "\n".join([",".join(keys), *(",".join(csv_cell(d.get(k)) for k in keys) for d in result["deltas"])]))
    else:
        raise ValueError(f"unknown format: {kind}")
