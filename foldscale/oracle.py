"""The registered queries' questions in SQL (DuckDB), from named pieces. All constants are written out here, so that a
wrong one in the engine does not go unnoticed."""

from __future__ import annotations

from foldscale.sources.synthetic import ATOMS_SQL

#: Common table expressions by name, with the pieces that they need.
PIECES: dict[str, tuple[tuple[str, ...], str]] = {"ids": ((), ATOMS_SQL)}


def _piece(name: str, *needs: str):
    def add(sql: str) -> None:
        PIECES[name] = (needs, sql)

    return add


def with_pieces(names: str, select: str) -> str:
    """A statement over the pieces ``names``, each after those that it needs."""
    done: list[str] = []

    def visit(name: str) -> None:
        for n in PIECES[name][0]:
            visit(n)
        if name not in done:
            done.append(name)

    for name in names.split():
        visit(name)
    return f"WITH RECURSIVE {', '.join(PIECES[n][1] for n in done)} {select}"


def _square(p: str = "p", q: str = "q") -> str:
    return f"(({p}.x-{q}.x)*({p}.x-{q}.x)+({p}.y-{q}.y)*({p}.y-{q}.y)+({p}.z-{q}.z)*({p}.z-{q}.z))"


DIST = f"sqrt{_square()}"
SAME = "p.structure_id = q.structure_id"
HYDROPHOBIC = "('ALA','VAL','LEU','ILE','PRO','MET','PHE','TYR','TRP')"
ACIDIC = "('ASP OD1','ASP OD2','GLU OE1','GLU OE2')"
BASIC = "('LYS NZ','ARG NH1','ARG NH2','ARG NE','HIS ND1','HIS NE2')"
JUDGED = """('ALA','ARG','ASN','ASP','CYS','GLN','GLU','GLY','HIS','ILE','LEU','LYS','MET','PHE','PRO','SER','THR','TRP','TYR','VAL')"""
_VDW = "CASE element WHEN 'H' THEN 1.20 WHEN 'C' THEN 1.70 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'S' THEN 1.80 ELSE 1.70 END::DOUBLE"
_MAX_AREA = """CASE residue_name WHEN 'ALA' THEN 129 WHEN 'ARG' THEN 274 WHEN 'ASN' THEN 195 WHEN 'ASP' THEN 193 WHEN 'CYS' THEN 167 WHEN 'GLU' THEN 223
  WHEN 'GLN' THEN 225 WHEN 'GLY' THEN 104 WHEN 'HIS' THEN 224 WHEN 'ILE' THEN 197 WHEN 'LEU' THEN 201 WHEN 'LYS' THEN 236 WHEN 'MET' THEN 224 WHEN 'PHE' THEN 240
  WHEN 'PRO' THEN 159 WHEN 'SER' THEN 155 WHEN 'THR' THEN 172 WHEN 'TRP' THEN 285 WHEN 'TYR' THEN 263 WHEN 'VAL' THEN 174 END::DOUBLE"""

# ---- graphs
_piece("res", "ids")("""res AS (SELECT structure_id, res_ord, chain_index, chain_label, residue_index, seq_number, residue_name, residue_id, is_hetero,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(temp_factor) AS b FROM ids GROUP BY ALL)""")
_piece("edges", "res")(f"""cov AS (SELECT p.structure_id, p.res_ord AS a, q.res_ord AS b, {DIST} AS d FROM res p JOIN res q
    ON {SAME} AND p.chain_index = q.chain_index AND q.residue_index = p.residue_index + 1 WHERE abs(q.seq_number - p.seq_number) = 1),
  near AS (SELECT p.structure_id, p.res_ord AS a, q.res_ord AS b, {DIST} AS d FROM res p JOIN res q ON {SAME} AND p.res_ord < q.res_ord WHERE {DIST} <= 8.0),
  edges AS (SELECT *, 'covalent_adjacency' AS kind FROM cov UNION ALL SELECT *, 'distance_contact' FROM near n
    WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.structure_id = n.structure_id AND c.a = n.a AND c.b = n.b))""")
_piece("between", "res")(f"""between_chains AS (SELECT p.structure_id, p.res_ord AS a, q.res_ord AS b, {DIST} AS d FROM res p JOIN res q
  ON {SAME} AND p.res_ord < q.res_ord AND p.chain_index <> q.chain_index WHERE {DIST} <= 8.0)""")
_piece("graph", "edges")("""sym AS (SELECT structure_id, a, b FROM edges UNION ALL SELECT structure_id, b, a FROM edges),
  deg AS (SELECT r.structure_id, r.res_ord AS node, count(s.b) AS k FROM res r LEFT JOIN sym s ON s.structure_id = r.structure_id AND s.a = r.res_ord GROUP BY ALL),
  tri AS (SELECT u.structure_id, u.a AS node, count(*) AS t FROM sym u JOIN sym v ON u.structure_id = v.structure_id AND u.a = v.a AND u.b < v.b
    JOIN sym w ON w.structure_id = u.structure_id AND w.a = u.b AND w.b = v.b GROUP BY ALL),
  reach AS (SELECT structure_id, res_ord AS node, res_ord AS root FROM res UNION SELECT s.structure_id, s.b, r.root FROM reach r JOIN sym s ON s.structure_id = r.structure_id AND s.a = r.node),
  comps AS (SELECT structure_id, count(*) AS connected_components FROM (SELECT structure_id, node, min(root) AS m FROM reach GROUP BY ALL) WHERE m = node GROUP BY 1),
  graph AS (SELECT d.structure_id, CAST(sum(k) / 2 AS BIGINT) AS contact_count, round((sum(k) / 2) / (count(*) * (count(*) - 1) / 2), 6) + 0.0 AS graph_density,
    round(avg(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1) / 2) ELSE 0 END), 6) + 0.0 AS clustering_coefficient,
    string_agg(CAST(k AS VARCHAR), ',' ORDER BY d.node) AS degrees FROM deg d LEFT JOIN tri USING (structure_id, node) GROUP BY 1)""")

# ---- interactions
_piece("kinds", "ids")(f"""pairs AS (SELECT p.structure_id, p.res_ord AS ra, q.res_ord AS rb, p.residue_name || ' ' || p.atom_name AS pk, q.residue_name || ' ' || q.atom_name AS qk,
      p.residue_name AS pr, q.residue_name AS qr, p.atom_name AS pn, q.atom_name AS qn, p.residue_id AS pi, q.residue_id AS qi, {DIST} AS d
      FROM ids p JOIN ids q ON {SAME} AND p.atom_ord < q.atom_ord WHERE {DIST} <= 4.5),
    found AS (SELECT structure_id, ra, rb, d, CASE WHEN pk = 'CYS SG' AND qk = 'CYS SG' AND d < 2.5 THEN 'disulfide'
      WHEN ((pk IN {ACIDIC} AND qk IN {BASIC}) OR (qk IN {ACIDIC} AND pk IN {BASIC})) AND d < 4.0 THEN 'salt_bridge'
      WHEN pi <> qi AND left(pn, 1) IN ('N','O') AND left(qn, 1) IN ('N','O') AND d BETWEEN 2.4 AND 3.5 THEN 'hydrogen_bond' END AS kind FROM pairs WHERE d <= 4.0
      UNION ALL SELECT structure_id, ra, rb, d, 'hydrophobic' FROM pairs WHERE pi <> qi AND d < 4.5 AND pr IN {HYDROPHOBIC} AND qr IN {HYDROPHOBIC}
        AND left(pn, 1) = 'C' AND left(qn, 1) = 'C' AND pn NOT IN ('C','CA') AND qn NOT IN ('C','CA')),
    kinds AS (SELECT structure_id, least(ra, rb) AS a, greatest(ra, rb) AS b, d, kind FROM found WHERE kind IS NOT NULL)""")
_piece("merged", "edges", "kinds")("""every_edge AS (SELECT * FROM edges UNION ALL SELECT * FROM kinds WHERE a <> b),
  merged AS (SELECT *, CASE kind WHEN 'covalent_adjacency' THEN 100 WHEN 'disulfide' THEN 7 WHEN 'salt_bridge' THEN 6 WHEN 'hydrogen_bond' THEN 5 WHEN 'hydrophobic' THEN 2 ELSE 1 END AS p
    FROM every_edge QUALIFY row_number() OVER (PARTITION BY structure_id, a, b ORDER BY p DESC, d, kind) = 1)""")

# ---- backbone
_piece("bb", "ids")("""bb AS (SELECT structure_id, chain_index, residue_index, res_ord, residue_name, seq_number,
  max(x) FILTER (atom_name='N') AS nx, max(y) FILTER (atom_name='N') AS ny, max(z) FILTER (atom_name='N') AS nz,
  max(x) FILTER (atom_name='CA') AS ax, max(y) FILTER (atom_name='CA') AS ay, max(z) FILTER (atom_name='CA') AS az,
  max(x) FILTER (atom_name='C') AS cx, max(y) FILTER (atom_name='C') AS cy, max(z) FILTER (atom_name='C') AS cz,
  max(x) FILTER (atom_name='O') AS ox, max(y) FILTER (atom_name='O') AS oy, max(z) FILTER (atom_name='O') AS oz FROM ids GROUP BY ALL)""")


def _torsion(a: str, b: str, c: str, d: str) -> str:
    u = [[f"({q}{k}-{p}{k})" for k in "xyz"] for p, q in ((a, b), (b, c), (c, d))]
    cross = lambda m, n: [f"({m[1]}*{n[2]}-{m[2]}*{n[1]})", f"({m[2]}*{n[0]}-{m[0]}*{n[2]})", f"({m[0]}*{n[1]}-{m[1]}*{n[0]})"]
    dot = lambda m, n: f"({m[0]}*{n[0]}+{m[1]}*{n[1]}+{m[2]}*{n[2]})"
    n1, n2 = cross(u[0], u[1]), cross(u[1], u[2])
    return f"degrees(atan2({dot(cross(n1, n2), u[1])} / sqrt({dot(u[1], u[1])}), {dot(n1, n2)}))"


_piece("dih", "bb")(f"""nb AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(cz) OVER w AS pcz, lag(ax) OVER w AS pax, lag(ay) OVER w AS pay, lag(az) OVER w AS paz,
    lead(nx) OVER w AS nnx, lead(ny) OVER w AS nny, lead(nz) OVER w AS nnz FROM bb WINDOW w AS (PARTITION BY structure_id, chain_index ORDER BY residue_index)),
  dih AS (SELECT structure_id, res_ord, residue_name, {_torsion('pc', 'n', 'a', 'c')} AS phi, {_torsion('n', 'a', 'c', 'nn')} AS psi, {_torsion('pa', 'pc', 'n', 'a')} AS omega FROM nb)""")
_IN = lambda x0, x1, y0, y1: f"(phi >= {x0} AND phi < {x1} AND psi >= {y0} AND psi < {y1})"
RAMACHANDRAN = f"""CASE WHEN phi IS NULL OR psi IS NULL THEN NULL
  WHEN residue_name = 'GLY' THEN CASE WHEN {_IN(-150, -33, -78, -12)} OR {_IN(-180, -60, 30, 180)} THEN 'favored' WHEN {_IN(-180, 180, -180, 80)} OR {_IN(-180, -60, 80, 180)} THEN 'allowed' ELSE 'outlier' END
  WHEN residue_name = 'PRO' THEN CASE WHEN {_IN(-100, -30, -30, 180)} THEN 'favored' WHEN {_IN(-180, 180, -180, 180)} THEN 'allowed' ELSE 'outlier' END
  ELSE CASE WHEN {_IN(-150, -33, -78, -12)} OR {_IN(-180, -90, 110, 180)} OR {_IN(90, 180, 110, 180)} THEN 'favored' WHEN {_IN(-180, 180, -180, 180)} THEN 'allowed' ELSE 'outlier' END END"""
_piece("hb", "bb")("""prev AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(cz) OVER w AS pcz, lag(ox) OVER w AS pox, lag(oy) OVER w AS poy, lag(oz) OVER w AS poz FROM bb
    WINDOW w AS (PARTITION BY structure_id, chain_index ORDER BY residue_index)),
  leng AS (SELECT *, sqrt((pcx-pox)*(pcx-pox)+(pcy-poy)*(pcy-poy)+(pcz-poz)*(pcz-poz)) AS l FROM prev WHERE pcx IS NOT NULL AND residue_name <> 'PRO'),
  don AS (SELECT *, nx + (pcx-pox)/l AS hx, ny + (pcy-poy)/l AS hy, nz + (pcz-poz)/l AS hz FROM leng WHERE l > 1e-6),
  r AS (SELECT a.structure_id, a.res_ord AS i, d.res_ord AS j,
    sqrt((a.ox-d.nx)*(a.ox-d.nx)+(a.oy-d.ny)*(a.oy-d.ny)+(a.oz-d.nz)*(a.oz-d.nz)) AS r_on, sqrt((a.cx-d.hx)*(a.cx-d.hx)+(a.cy-d.hy)*(a.cy-d.hy)+(a.cz-d.hz)*(a.cz-d.hz)) AS r_ch,
    sqrt((a.ox-d.hx)*(a.ox-d.hx)+(a.oy-d.hy)*(a.oy-d.hy)+(a.oz-d.hz)*(a.oz-d.hz)) AS r_oh, sqrt((a.cx-d.nx)*(a.cx-d.nx)+(a.cy-d.ny)*(a.cy-d.ny)+(a.cz-d.nz)*(a.cz-d.nz)) AS r_cn
    FROM bb a JOIN don d ON a.structure_id = d.structure_id AND a.res_ord <> d.res_ord
    WHERE coalesce(sqrt((a.ax-d.ax)*(a.ax-d.ax)+(a.ay-d.ay)*(a.ay-d.ay)+(a.az-d.az)*(a.az-d.az)) <= 9.0, true)),
  hb AS (SELECT structure_id, i, j FROM r WHERE least(r_on, r_ch, r_oh, r_cn) >= 1e-3 AND 27.888::DOUBLE * (1.0::DOUBLE/r_on + 1.0::DOUBLE/r_ch - 1.0::DOUBLE/r_oh - 1.0::DOUBLE/r_cn) < -0.5)""")
_piece("ss", "hb")("""ch AS (SELECT DISTINCT structure_id, res_ord, chain_index, residue_index FROM ids),
  helix AS (SELECT h.structure_id, unnest(range(h.i, h.i + v.n)) AS res_ord, v.rank FROM hb h JOIN (VALUES (4, 5), (3, 3), (5, 2)) v(n, rank) ON h.j = h.i + v.n
    JOIN hb g ON g.structure_id = h.structure_id AND g.i = h.i - 1 AND g.j = h.j - 1
    JOIN ch c0 ON c0.structure_id = h.structure_id AND c0.res_ord = h.i - 1 JOIN ch c1 ON c1.structure_id = h.structure_id AND c1.res_ord = h.j AND c1.chain_index = c0.chain_index),
  mid AS (SELECT c.structure_id, c.res_ord FROM ch c JOIN ch p ON p.structure_id = c.structure_id AND p.chain_index = c.chain_index AND p.res_ord = c.res_ord - 1
    JOIN ch n ON n.structure_id = c.structure_id AND n.chain_index = c.chain_index AND n.res_ord = c.res_ord + 1),
  br AS (SELECT a.structure_id, a.i + 1 AS i, a.j AS j FROM hb a JOIN hb b ON b.structure_id = a.structure_id AND b.i = a.j AND b.j = a.i + 2 SEMI JOIN mid m ON m.structure_id = a.structure_id AND m.res_ord = a.i + 1
    UNION ALL SELECT a.structure_id, a.j, a.i + 1 FROM hb a JOIN hb b ON b.structure_id = a.structure_id AND b.i = a.j AND b.j = a.i + 2 SEMI JOIN mid m ON m.structure_id = a.structure_id AND m.res_ord = a.i + 1
    UNION ALL SELECT a.structure_id, a.i, a.j FROM hb a JOIN hb b ON b.structure_id = a.structure_id AND b.i = a.j AND b.j = a.i
    UNION ALL SELECT a.structure_id, a.i + 1, a.j - 1 FROM hb a JOIN hb b ON b.structure_id = a.structure_id AND b.i = a.j - 2 AND b.j = a.i + 2
      SEMI JOIN mid m ON m.structure_id = a.structure_id AND m.res_ord = a.i + 1 SEMI JOIN mid o ON o.structure_id = a.structure_id AND o.res_ord = a.j - 1),
  bridge AS (SELECT b.* FROM br b JOIN ch x ON x.structure_id = b.structure_id AND x.res_ord = b.i JOIN ch y ON y.structure_id = b.structure_id AND y.res_ord = b.j
    WHERE b.i < b.j AND (x.chain_index <> y.chain_index OR b.j > b.i + 2)),
  best AS (SELECT structure_id, res_ord, max(rank) AS rank FROM (SELECT * FROM helix UNION ALL SELECT structure_id, i, 4 FROM bridge UNION ALL SELECT structure_id, j, 4 FROM bridge) GROUP BY ALL),
  ss AS (SELECT c.structure_id, c.res_ord, CASE rank WHEN 5 THEN 'H' WHEN 4 THEN 'E' WHEN 3 THEN 'G' WHEN 2 THEN 'I' ELSE 'C' END AS secondary_structure
    FROM ch c LEFT JOIN best b USING (structure_id, res_ord))""")

# ---- quality
_piece("clash", "ids")(f"""heavy AS (SELECT *, {_VDW} AS vdw FROM ids WHERE residue_name IN {JUDGED}),
  clash AS (SELECT p.structure_id, p.residue_id AS ra, q.residue_id AS rb, {DIST} AS d FROM heavy p JOIN heavy q ON {SAME} AND p.atom_ord < q.atom_ord
    WHERE p.residue_id <> q.residue_id AND NOT (p.chain_index = q.chain_index AND abs(p.residue_index - q.residue_index) = 1) AND {DIST} < p.vdw + q.vdw - 0.4::DOUBLE)""")
_piece("judged", "dih", "clash")(f"""missing AS (SELECT structure_id, res_ord, residue_id, chain_label, residue_name, seq_number,
    concat_ws(',', CASE WHEN NOT bool_or(atom_name='N') THEN 'N' END, CASE WHEN NOT bool_or(atom_name='CA') THEN 'CA' END, CASE WHEN NOT bool_or(atom_name='C') THEN 'C' END,
      CASE WHEN NOT bool_or(atom_name='O') THEN 'O' END) AS missing FROM ids WHERE residue_name IN {JUDGED} GROUP BY ALL),
  sides AS (SELECT structure_id, ra AS residue_id FROM clash UNION ALL SELECT structure_id, rb FROM clash),
  clashing AS (SELECT structure_id, residue_id, count(*) AS n FROM sides GROUP BY ALL),
  judged AS (SELECT m.structure_id, m.residue_id, m.chain_label AS chain_id, m.residue_name, m.seq_number, d.phi, d.psi, CASE WHEN missing = '' THEN d.class END AS ramachandran, missing,
    coalesce(c.n, 0) AS clash_count FROM missing m JOIN (SELECT *, {RAMACHANDRAN} AS class FROM dih) d USING (structure_id, res_ord) LEFT JOIN clashing c USING (structure_id, residue_id)),
  quality AS (SELECT j.structure_id, count(*) AS quality_residue_count, count(ramachandran) AS ramachandran_evaluated_count, count(*) FILTER (ramachandran = 'favored') AS ramachandran_favored_count,
    count(*) FILTER (ramachandran = 'allowed') AS ramachandran_allowed_count, count(*) FILTER (ramachandran = 'outlier') AS ramachandran_outlier_count,
    count(*) FILTER (missing <> '') AS missing_backbone_residue_count, coalesce(max(p.n), 0) AS clash_pair_count
    FROM judged j LEFT JOIN (SELECT structure_id, count(*) AS n FROM clash GROUP BY 1) p USING (structure_id) GROUP BY 1)""")

# ---- surfaces and interfaces
_piece("area", "ids")(f"""k AS (SELECT unnest(range(92)) AS k), turn AS (SELECT k, 1.0-2.0*(k+0.5::DOUBLE)/92 AS uy, pi()*(1.0+sqrt(5.0::DOUBLE))*(k+0.5::DOUBLE) AS t FROM k),
  pts AS (SELECT k, cos(t) * sqrt(greatest(1.0-uy*uy, 0)) AS ux, uy, sin(t) * sqrt(greatest(1.0-uy*uy, 0)) AS uz FROM turn),
  sph AS (SELECT *, {_VDW} + 1.4::DOUBLE AS r FROM ids),
  nbr AS (SELECT p.structure_id, p.atom_ord, p.x, p.y, p.z, p.r, q.x AS qx, q.y AS qy, q.z AS qz, q.r AS qr, p.chain_index = q.chain_index AS same FROM sph p JOIN sph q
    ON {SAME} AND p.atom_ord <> q.atom_ord WHERE {DIST} < p.r + q.r),
  covered AS (SELECT structure_id, atom_ord, k, bool_or(same) AS same FROM nbr, pts WHERE (x+ux*r-qx)*(x+ux*r-qx)+(y+uy*r-qy)*(y+uy*r-qy)+(z+uz*r-qz)*(z+uz*r-qz) <= qr*qr GROUP BY ALL),
  cover AS (SELECT structure_id, atom_ord, count(*) AS c, count(*) FILTER (same) AS c_alone FROM covered GROUP BY ALL),
  area AS (SELECT s.structure_id, s.atom_ord, s.res_ord, s.residue_id, s.chain_label, 92 - coalesce(c, 0) AS points, 4 * pi() * r * r / 92 * (92 - coalesce(c, 0)) AS sasa,
    4 * pi() * r * r / 92 * (92 - coalesce(c_alone, 0)) AS sasa_alone FROM sph s LEFT JOIN cover USING (structure_id, atom_ord))""")
_piece("ressasa", "area", "res")(f"""ressasa AS (SELECT structure_id, res_ord, sum(sasa) AS sasa, sum(sasa) / any_value({_MAX_AREA}) AS rsa FROM area JOIN res USING (structure_id, res_ord) GROUP BY ALL)""")
_piece("contacts", "ids")(f"""m AS (SELECT p.structure_id, p.chain_label AS chain_a, q.chain_label AS chain_b, p.res_ord AS a, q.res_ord AS b FROM ids p JOIN ids q
    ON {SAME} AND p.chain_label < q.chain_label WHERE {DIST} <= 8.0 GROUP BY ALL),
  contacts AS (SELECT structure_id, chain_a, chain_b, count(*) AS contact_count FROM m GROUP BY ALL)""")
_piece("interfaces", "contacts", "area")(f"""touch AS (SELECT DISTINCT p.structure_id, p.atom_ord, p.chain_label AS own, q.chain_label AS other FROM ids p JOIN ids q ON {SAME} AND p.chain_label <> q.chain_label WHERE {DIST} <= 5.0),
  buried AS (SELECT structure_id, chain_label, sum(greatest(sasa_alone - sasa, 0)) AS d FROM area GROUP BY ALL),
  patch AS (SELECT t.structure_id, least(own, other) AS chain_a, greatest(own, other) AS chain_b, sum(greatest(a.sasa_alone - a.sasa, 0)) AS interface_area,
    count(DISTINCT a.residue_id) FILTER (own < other) AS interface_residue_count_a, count(DISTINCT a.residue_id) FILTER (own > other) AS interface_residue_count_b
    FROM touch t JOIN area a USING (structure_id, atom_ord) GROUP BY ALL),
  dots AS (SELECT t.structure_id, least(own, other) AS chain_a, greatest(own, other) AS chain_b, own < other AS first, s.x + ux * s.r AS x, s.y + uy * s.r AS y, s.z + uz * s.r AS z, ux, uy, uz
    FROM touch t JOIN sph s USING (structure_id, atom_ord) CROSS JOIN pts ANTI JOIN covered c ON c.structure_id = t.structure_id AND c.atom_ord = t.atom_ord AND c.k = pts.k),
  facing AS (SELECT p.structure_id, p.chain_a, p.chain_b, {_square()} AS d2, ((q.x-p.x)*p.ux+(q.y-p.y)*p.uy+(q.z-p.z)*p.uz) * -((q.x-p.x)*q.ux+(q.y-p.y)*q.uy+(q.z-p.z)*q.uz) / {_square()} AS f
    FROM dots p JOIN dots q ON {SAME} AND p.chain_a = q.chain_a AND p.chain_b = q.chain_b AND p.first AND NOT q.first AND abs(p.x - q.x) <= 5.0 WHERE {_square()} <= 25.0 AND {_square()} > 2.3e-16),
  total AS (SELECT structure_id, chain_a, chain_b, sum(exp(-0.5 * d2) * greatest(f, 0)) AS s FROM facing GROUP BY ALL),
  close AS (SELECT p.structure_id, p.chain_a, p.chain_b, p.first, sum(1.0 - {_square()} / 4.0) AS w FROM dots p JOIN dots q
    ON {SAME} AND p.chain_a = q.chain_a AND p.chain_b = q.chain_b AND p.first = q.first AND abs(p.x - q.x) < 2.0 WHERE {_square()} < 4.0 AND {_square()} > 0 GROUP BY ALL),
  counted AS (SELECT structure_id, chain_a, chain_b, first, count(*) AS n FROM dots GROUP BY ALL),
  weight AS (SELECT structure_id, chain_a, chain_b, sum(n + coalesce(w, 0)) / 2 AS w FROM counted LEFT JOIN close USING (structure_id, chain_a, chain_b, first) GROUP BY ALL HAVING count(*) = 2),
  interfaces AS (SELECT c.structure_id, c.chain_a, c.chain_b, contact_count, coalesce(interface_residue_count_a, 0) AS interface_residue_count_a, coalesce(interface_residue_count_b, 0) AS interface_residue_count_b,
    x.d + y.d AS bsa, coalesce(interface_area, 0) AS interface_area, coalesce(s / w.w, 0) AS shape_complementarity FROM contacts c
    JOIN buried x ON x.structure_id = c.structure_id AND x.chain_label = c.chain_a JOIN buried y ON y.structure_id = c.structure_id AND y.chain_label = c.chain_b
    LEFT JOIN patch p ON p.structure_id = c.structure_id AND p.chain_a = c.chain_a AND p.chain_b = c.chain_b
    LEFT JOIN total t ON t.structure_id = c.structure_id AND t.chain_a = c.chain_a AND t.chain_b = c.chain_b
    LEFT JOIN weight w ON w.structure_id = c.structure_id AND w.chain_a = c.chain_a AND w.chain_b = c.chain_b)""")

# ---- ligands
_piece("ligands", "area")(f"""lig AS (SELECT * FROM ids WHERE residue_name = 'HEM'),
  site AS (SELECT DISTINCT p.structure_id, p.residue_id AS ligand_id, q.residue_id FROM lig p JOIN ids q ON {SAME} AND NOT q.is_hetero WHERE {DIST} <= 5.0),
  pair AS (SELECT p.structure_id, p.residue_id AS ligand_id, {DIST} AS d, p.residue_name || ' ' || p.atom_name AS pk, q.residue_name || ' ' || q.atom_name AS qk, p.atom_name AS pn, q.atom_name AS qn,
    q.residue_name AS qr FROM lig p JOIN ids q ON {SAME} AND q.residue_name <> 'HEM' WHERE {DIST} <= 4.5),
  cnt AS (SELECT structure_id, ligand_id, count(*) FILTER (d < 4.5) AS contact, count(*) FILTER (left(pn,1) IN ('N','O') AND left(qn,1) IN ('N','O') AND d BETWEEN 2.4 AND 3.5) AS hydrogen_bond,
    count(*) FILTER (((pk IN {ACIDIC} AND qk IN {BASIC}) OR (qk IN {ACIDIC} AND pk IN {BASIC})) AND d < 4.0) AS salt_bridge,
    count(*) FILTER (d < 4.5 AND left(pn,1) = 'C' AND qr IN {HYDROPHOBIC} AND left(qn,1) = 'C' AND qn NOT IN ('C','CA')) AS hydrophobic FROM pair GROUP BY ALL),
  ligands AS (SELECT l.structure_id, l.residue_id AS ligand_id, l.chain_label AS chain_id, l.seq_number, any_value(a.sasa) AS sasa, coalesce(any_value(s.n), 0) AS site_residues,
    coalesce(any_value(c.contact), 0) AS contact, coalesce(any_value(c.hydrogen_bond), 0) AS hydrogen_bond, coalesce(any_value(c.salt_bridge), 0) AS salt_bridge, coalesce(any_value(c.hydrophobic), 0) AS hydrophobic
    FROM lig l JOIN (SELECT structure_id, residue_id, sum(sasa) AS sasa FROM area GROUP BY ALL) a ON a.structure_id = l.structure_id AND a.residue_id = l.residue_id
    LEFT JOIN (SELECT structure_id, ligand_id, count(*) AS n FROM site GROUP BY ALL) s ON s.structure_id = l.structure_id AND s.ligand_id = l.residue_id
    LEFT JOIN cnt c ON c.structure_id = l.structure_id AND c.ligand_id = l.residue_id GROUP BY ALL)""")

_R = lambda c, n=4: f"round({c}, {n}) + 0.0 AS {c.split('.')[-1]}"
_SUMMARY = """SELECT structure_id, CAST(count(DISTINCT chain_index) AS BIGINT) AS chain_count, count(DISTINCT res_ord) AS residue_count,
  count(*) AS atom_count, count(*) FILTER (is_hetero) AS heteroatom_count, count(DISTINCT res_ord) FILTER (is_hetero) AS ligand_count FROM ids GROUP BY 1"""
_MOMENTS = """SELECT structure_id, round(avg(x), 4) + 0.0 AS cx, round(avg(y), 4) + 0.0 AS cy, round(avg(z), 4) + 0.0 AS cz,
  round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) + 0.0 AS radius_of_gyration, round(avg(temp_factor), 4) + 0.0 AS bfactor_mean,
  round(stddev_pop(temp_factor), 4) + 0.0 AS bfactor_std, min(temp_factor) AS bfactor_min, max(temp_factor) AS bfactor_max FROM ids GROUP BY 1"""
_INTERFACES = f"""SELECT structure_id, chain_a, chain_b, contact_count, interface_residue_count_a, interface_residue_count_b, {_R('bsa')}, {_R('interface_area')}, {_R('shape_complementarity', 6)} FROM interfaces"""
_EDGE = "structure_id, a, b, kind, round(d, 4) + 0.0 AS distance"

# ---- superposition: sums over matched atoms, the characteristic polynomial of the quaternion matrix, Newton steps
_CA = """ca AS (SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY atom_ord) AS o, x, y, z FROM ids WHERE atom_name = 'CA'),
  mean AS (SELECT structure_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ca GROUP BY 1),
  c AS (SELECT ca.structure_id, o, n, x - mx AS x, y - my AS y, z - mz AS z FROM ca JOIN mean USING (structure_id))"""
_SUMS = f"""s AS (SELECT p.structure_id AS id_a, q.structure_id AS id_b, any_value(p.n) AS n, any_value(q.n) AS m, sum(p.x*p.x+p.y*p.y+p.z*p.z+q.x*q.x+q.y*q.y+q.z*q.z) AS g,
  {', '.join(f'sum(q.{u}*p.{v}) AS {u}{v}' for u in 'xyz' for v in 'xyz')} FROM c p JOIN c q ON p.o = q.o AND p.structure_id < q.structure_id GROUP BY ALL)"""
_MATRIX = [["xx+yy+zz", "yz-zy", "zx-xz", "xy-yx"], ["yz-zy", "xx-yy-zz", "xy+yx", "zx+xz"], ["zx-xz", "xy+yx", "yy-xx-zz", "yz+zy"], ["xy-yx", "zx+xz", "yz+zy", "zz-xx-yy"]]


def _determinant(rows: list[int], columns: list[int]) -> str:
    if len(rows) == 1:
        return f"({_MATRIX[rows[0]][columns[0]]})"
    parts = [f"{'+-'[i % 2]}({_MATRIX[rows[0]][c]})*{_determinant(rows[1:], [x for x in columns if x != c])}" for i, c in enumerate(columns)]
    return f"({''.join(parts)})"


_MINORS = "+".join(_determinant(list(r), list(r)) for r in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)))
_POLY = f"""poly AS (SELECT id_a, id_b, n, m, g, -2*(xx*xx+xy*xy+xz*xz+yx*yx+yy*yy+yz*yz+zx*zx+zy*zy+zz*zz) AS c2, -({_MINORS}) AS c1, {_determinant([0, 1, 2, 3], [0, 1, 2, 3])} AS c0 FROM s),
  step AS (SELECT *, g / 2 AS v, 0 AS i FROM poly UNION ALL SELECT * REPLACE (v - (((v*v+c2)*v+c1)*v+c0) / (4*v*v*v+2*c2*v+c1) AS v, i + 1 AS i) FROM step WHERE i < 40 AND abs(4*v*v*v+2*c2*v+c1) > 0)"""

SQL: dict[str, str] = {
    "structure_summary": with_pieces("ids", _SUMMARY),
    "structure_moments": with_pieces("ids", _MOMENTS),
    "residue_contact_graph": with_pieces("edges", f"SELECT {_EDGE} FROM edges"),
    "residue_contact_graph_grid": with_pieces("edges", f"SELECT {_EDGE} FROM edges"),
    "interface_contact_graph": with_pieces("between", "SELECT structure_id, a, b, round(d, 4) + 0.0 AS distance FROM between_chains"),
    "atom_contact_graph": with_pieces("ids", f"SELECT p.structure_id, count(*) AS edges, round(sum({DIST}), 3) + 0.0 AS total FROM ids p JOIN ids q ON {SAME} AND p.atom_ord < q.atom_ord WHERE {DIST} <= 5.0 GROUP BY 1"),
    "residue_graph_statistics": with_pieces("graph", "SELECT * FROM graph"),
    "residue_graph_components": with_pieces("graph", "SELECT * FROM comps"),
    "residue_interaction_graph": with_pieces("merged", f"SELECT {_EDGE} FROM merged"),
    "interface_interaction_graph": with_pieces("merged", """SELECT e.structure_id, e.a, e.b, CASE WHEN kind = 'distance_contact' THEN 'interface_contact' ELSE kind END AS kind, round(e.d, 4) + 0.0 AS distance
      FROM merged e JOIN res u ON u.structure_id = e.structure_id AND u.res_ord = e.a JOIN res v ON v.structure_id = e.structure_id AND v.res_ord = e.b WHERE u.chain_index <> v.chain_index"""),
    "typed_interactions": with_pieces("kinds", "SELECT structure_id, kind, count(*) AS n, round(sum(d), 3) + 0.0 AS total FROM kinds GROUP BY ALL"),
    "backbone_torsions": with_pieces("dih", f"SELECT structure_id, res_ord, {_R('phi', 3)}, {_R('psi', 3)}, {_R('omega', 3)} FROM dih"),
    "ramachandran_classes": with_pieces("dih", f"SELECT residue_name, {RAMACHANDRAN} AS class, count(*) AS n FROM dih GROUP BY ALL"),
    "steric_clashes": with_pieces("clash", "SELECT structure_id, ra AS residue_a, rb AS residue_b, count(*) AS n, round(min(d), 4) + 0.0 AS nearest FROM clash GROUP BY ALL"),
    "model_quality_summary": with_pieces("judged", "SELECT * FROM quality"),
    "problem_residues": with_pieces("judged", f"""SELECT structure_id, residue_id, chain_id, residue_name, seq_number, {_R('phi', 3)}, {_R('psi', 3)}, ramachandran, missing AS missing_backbone, clash_count
      FROM judged WHERE ramachandran = 'outlier' OR missing <> '' OR clash_count > 0"""),
    "backbone_hydrogen_bonds": with_pieces("hb", "SELECT structure_id, i, j FROM hb"),
    "secondary_structure_states": with_pieces("ss", "SELECT * FROM ss"),
    "accessible_surface_points": with_pieces("area", "SELECT structure_id, sum(points)::BIGINT AS points FROM area GROUP BY 1"),
    "residue_surfaces": with_pieces("ressasa", f"SELECT structure_id, res_ord, {_R('sasa')}, {_R('rsa', 6)} FROM ressasa"),
    "chain_pair_contacts": with_pieces("contacts", "SELECT * FROM contacts"),
    "interface_features": with_pieces("interfaces", _INTERFACES),
    "ligand_binding_sites": with_pieces("ligands", "SELECT * REPLACE (round(sasa, 4) + 0.0 AS sasa) FROM ligands"),
    "pdb_text_round_trip": with_pieces("ids", "SELECT structure_id, chain_label AS chain, residue_index, residue_name, count(*) AS atoms, round(sum(x), 3) + 0.0 AS x FROM ids GROUP BY ALL"),
    "residue_features": with_pieces("ressasa ss dih", f"""SELECT r.structure_id, res_ord, r.residue_id, r.structure_id || ':' || r.chain_label AS chain_id, r.residue_name, seq_number, round(b, 4) + 0.0 AS bfactor_mean, {_R('sasa')}, {_R('rsa', 6)}, secondary_structure, {_R('phi', 3)}, {_R('psi', 3)}, {_R('omega', 3)}
      FROM res r JOIN ressasa USING (structure_id, res_ord) JOIN ss USING (structure_id, res_ord) JOIN dih d USING (structure_id, res_ord)"""),
    "structure_rmsd_pairs": f"WITH RECURSIVE {ATOMS_SQL}, {_CA}, {_SUMS}, {_POLY} SELECT id_a, id_b, round(sqrt(greatest(g - 2 * min(v), 0) / n), 4) + 0.0 AS rmsd FROM step GROUP BY id_a, id_b, g, n",
}

_FEATURES = f"""SELECT s.structure_id, chain_count, residue_count, atom_count, heteroatom_count, o.*  EXCLUDE (structure_id), g.* EXCLUDE (structure_id), connected_components,
  coalesce(i.n, 0) AS interface_contact_count, coalesce(i.r, 0) AS interface_residue_count, {_R('a.sasa_total')}, buried_residue_count, exposed_residue_count, helix_residue_count, strand_residue_count, coil_residue_count,
  {', '.join(f"coalesce(t.{k}, 0) AS {k}_count" for k in ('disulfide', 'salt_bridge', 'hydrogen_bond', 'hydrophobic'))}, 0::BIGINT AS cation_pi_count, 0::BIGINT AS pi_pi_parallel_count, 0::BIGINT AS pi_pi_perpendicular_count,
  l.ligand_count, {_R('l.ligand_sasa_total')}, {_R('l.ligand_sasa_mean')}, coalesce(binding_site_residue_count, 0) AS binding_site_residue_count, protein_ligand_hbond_count, protein_ligand_salt_bridge_count,
  protein_ligand_hydrophobic_count, protein_ligand_contact_count, interface_pair_count, {_R('interface_bsa_total')}, {_R('interface_area_total')}, {_R('interface_sc_mean', 6)}, {_R('interface_bsa_max')}, {_R('interface_area_max')},
  {_R('interface_sc_max', 6)}, interface_chain_a, interface_chain_b, q.* EXCLUDE (structure_id)
  FROM ({_SUMMARY}) s JOIN ({_MOMENTS}) o USING (structure_id) JOIN graph g USING (structure_id) JOIN comps USING (structure_id)
  LEFT JOIN (SELECT structure_id, count(*) AS n, any_value(r) AS r FROM between_chains JOIN (SELECT structure_id, count(DISTINCT e) AS r FROM (SELECT structure_id, unnest([a, b]) AS e FROM between_chains) GROUP BY 1) USING (structure_id)
    GROUP BY 1) i USING (structure_id)
  JOIN (SELECT structure_id, sum(sasa) AS sasa_total, count(*) FILTER (rsa < 0.25) AS buried_residue_count, count(*) FILTER (rsa >= 0.25) AS exposed_residue_count FROM ressasa GROUP BY 1) a USING (structure_id)
  JOIN (SELECT structure_id, count(*) FILTER (secondary_structure IN ('H', 'G', 'I')) AS helix_residue_count, count(*) FILTER (secondary_structure = 'E') AS strand_residue_count,
    count(*) FILTER (secondary_structure = 'C') AS coil_residue_count FROM ss GROUP BY 1) f USING (structure_id)
  LEFT JOIN (SELECT structure_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('disulfide', 'salt_bridge', 'hydrogen_bond', 'hydrophobic'))} FROM kinds GROUP BY 1) t USING (structure_id)
  JOIN (SELECT structure_id, count(*) AS ligand_count, sum(sasa) AS ligand_sasa_total, avg(sasa) AS ligand_sasa_mean, sum(hydrogen_bond)::BIGINT AS protein_ligand_hbond_count, sum(salt_bridge)::BIGINT AS protein_ligand_salt_bridge_count,
    sum(hydrophobic)::BIGINT AS protein_ligand_hydrophobic_count, sum(contact)::BIGINT AS protein_ligand_contact_count FROM ligands GROUP BY 1) l USING (structure_id)
  LEFT JOIN (SELECT structure_id, count(DISTINCT residue_id) AS binding_site_residue_count FROM site GROUP BY 1) b USING (structure_id)
  JOIN (SELECT structure_id, count(*) AS interface_pair_count, sum(bsa) AS interface_bsa_total, sum(interface_area) AS interface_area_total, avg(shape_complementarity) AS interface_sc_mean FROM interfaces GROUP BY 1) p USING (structure_id)
  JOIN (SELECT structure_id, bsa AS interface_bsa_max, interface_area AS interface_area_max, shape_complementarity AS interface_sc_max, chain_a AS interface_chain_a, chain_b AS interface_chain_b FROM interfaces
    QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY bsa DESC, chain_a, chain_b) = 1) x USING (structure_id)
  JOIN quality q USING (structure_id)"""
SQL["structure_features"] = with_pieces("graph between ressasa ss kinds ligands interfaces judged", _FEATURES)

# ---- models with atoms left out, so that torsions, backbones and classes have gaps
PIECES["thinned"] = ((), ATOMS_SQL.replace("FROM atoms)", "FROM atoms WHERE (atom_ord * 7 + CAST(substr(structure_id, 2) AS BIGINT)) % 13 <> 0)"))
_GAPPED = {n: (tuple("thinned" if x == "ids" else x for x in needs), sql) for n, (needs, sql) in PIECES.items() if n != "ids"}
_full, PIECES = PIECES, _GAPPED | {"thinned": PIECES["thinned"]}
SQL["quality_of_incomplete_models"] = with_pieces("judged", f"SELECT structure_id, residue_id, {_R('phi', 3)}, {_R('psi', 3)}, ramachandran, missing AS missing_backbone, clash_count FROM judged")
SQL["states_of_incomplete_models"] = with_pieces("ss", "SELECT * FROM ss")
PIECES = _full

# ---- alternate locations and insertion codes: the rows as a parser gives them, and the rule
SQL["alternate_locations"] = """WITH raw AS (SELECT 'v' || (o_orderkey // 240) AS structure_id, (o_orderkey % 240) // 8 AS r, o_orderkey % 8 AS a, o_custkey AS c FROM orders),
  named AS (SELECT structure_id, CASE WHEN r < 10 THEN 'B' WHEN r < 20 THEN 'A' ELSE '_' END AS chain, r // 2 AS seq, CASE WHEN r % 2 = 1 THEN 'A' END AS ins, r % 10 = 9 AS het, a, c, r,
    ['N','CA','C','O','CB','CB','CG','CG'][a + 1] AS atom_name, CASE WHEN a IN (4, 6) THEN 'A' WHEN a IN (5, 7) THEN 'B' END AS alt, ((c * 7919) % 3) / 4.0::DOUBLE AS occ, c / 8.0::DOUBLE AS x FROM raw WHERE c % 7 <> 3),
  sums AS (SELECT structure_id, chain, seq, ins, het, alt, sum(occ) AS occ, count(*) AS n FROM named WHERE alt IS NOT NULL GROUP BY ALL),
  best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY structure_id, chain, seq, ins, het ORDER BY occ DESC, n DESC, alt DESC) = 1),
  kept AS (SELECT m.* FROM named m LEFT JOIN best b ON m.structure_id = b.structure_id AND m.chain = b.chain AND m.seq = b.seq AND m.ins IS NOT DISTINCT FROM b.ins AND m.het = b.het WHERE m.alt IS NULL OR m.alt = b.alt),
  ranked AS (SELECT *, dense_rank() OVER (PARTITION BY structure_id ORDER BY chain, seq, ins NULLS FIRST, het) - 1 AS res_ord, dense_rank() OVER (PARTITION BY structure_id ORDER BY chain) - 1 AS chain_index,
    dense_rank() OVER (PARTITION BY structure_id, chain ORDER BY seq, ins NULLS FIRST, het) - 1 AS residue_index FROM kept)
  SELECT structure_id, CAST(res_ord AS INTEGER) AS res_ord, CAST(chain_index AS INTEGER) AS chain_index, CAST(residue_index AS INTEGER) AS residue_index, structure_id || ':' || chain || ':' || seq || ':' || coalesce(ins, '_') AS residue_id,
    count(*) AS atoms, string_agg(atom_name, ',' ORDER BY a) AS names, sum(x) AS x FROM ranked GROUP BY ALL"""

# ---- large structures on a lattice
_LATTICE = """SELECT 'g' || (o_orderkey // 30000) AS structure_id, o_orderkey % 30000 AS atom_ord, ((o_orderkey % 30000) % 31 * 3000 + (o_custkey * 7919) % 997) / 1000.0::DOUBLE AS x,
  (((o_orderkey % 30000) // 31) % 31 * 3000 + (o_custkey * 104729) % 997) / 1000.0::DOUBLE AS y, ((o_orderkey % 30000) // 961 * 3000 + (o_custkey * 1299709) % 997) / 1000.0::DOUBLE AS z FROM orders"""
SQL["large_structure_contacts"] = f"""WITH p0 AS ({_LATTICE}), p AS (SELECT *, z::INTEGER // 5 AS slab FROM p0), q AS (SELECT * EXCLUDE (slab), slab + unnest([-1, 0, 1]) AS slab FROM p)
  SELECT p.structure_id, count(*) AS edges, round(sum({DIST}), 3) + 0.0 AS total FROM p JOIN q ON {SAME} AND p.slab = q.slab AND p.atom_ord < q.atom_ord AND abs(p.x - q.x) <= 5 WHERE {DIST} <= 5.0 GROUP BY 1"""

# ---- rings
SQL["ring_interactions"] = """WITH base AS (SELECT o_orderkey // 600 AS s, o_custkey AS c, o_orderkey % 600 AS w, (o_orderkey % 600) // 10 AS r, (o_orderkey % 600) % 10 AS a FROM orders),
  pos AS (SELECT 't' || s AS structure_id, r, a, r % 4 AS kind, ((r % 4) * 3900 + a * 350 + (c * 7919) % 397) / 1000.0::DOUBLE AS x,
    (((r // 4) % 4) * 3900 + (a * a * 310) % 1700) / 1000.0::DOUBLE AS y, ((r // 16) * 3900 + (a * 700) % 1900 + (c * 104729) % 397) / 1000.0::DOUBLE AS z FROM base),
  part AS (SELECT *, CASE kind WHEN 3 THEN a >= 1 ELSE a >= 4 END AS ring, CASE kind WHEN 3 THEN 1 ELSE 4 END AS g, CASE kind WHEN 3 THEN 2 ELSE 5 END AS d, CASE kind WHEN 3 THEN 6 ELSE 8 END AS e FROM pos WHERE kind <> 2),
  full_rings AS (SELECT structure_id, r, avg(x) FILTER (ring) AS x, avg(y) FILTER (ring) AS y, avg(z) FILTER (ring) AS z,
    max(x) FILTER (a = d) - max(x) FILTER (a = g) AS ux, max(y) FILTER (a = d) - max(y) FILTER (a = g) AS uy, max(z) FILTER (a = d) - max(z) FILTER (a = g) AS uz,
    max(x) FILTER (a = e) - max(x) FILTER (a = g) AS vx, max(y) FILTER (a = e) - max(y) FILTER (a = g) AS vy, max(z) FILTER (a = e) - max(z) FILTER (a = g) AS vz
    FROM part GROUP BY ALL HAVING count(*) FILTER (ring) = CASE any_value(kind) WHEN 3 THEN 9 ELSE 6 END),
  raw AS (SELECT *, uy*vz-uz*vy AS nx, uz*vx-ux*vz AS ny, ux*vy-uy*vx AS nz FROM full_rings),
  rings AS (SELECT structure_id, r, x, y, z, nx / sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny / sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz / sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM raw),
  pp AS (SELECT p.structure_id, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS d,
    degrees(acos(least(abs(p.nx*q.nx+p.ny*q.ny+p.nz*q.nz), 1.0))) AS t FROM rings p JOIN rings q ON p.structure_id = q.structure_id AND p.r < q.r),
  found AS (SELECT structure_id, CASE WHEN t < 30 THEN 'pi_pi_parallel' WHEN t BETWEEN 60 AND 90 THEN 'pi_pi_perpendicular' END AS kind FROM pp WHERE d < 5.5
    UNION ALL SELECT q.structure_id, 'cation_pi' FROM rings q JOIN pos p ON p.structure_id = q.structure_id AND p.kind = 2 AND p.a = 8
      WHERE sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) < 6.0)
  SELECT structure_id, kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL"""
