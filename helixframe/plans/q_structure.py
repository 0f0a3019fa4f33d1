"""Queries on atoms and residues (selection, geometry) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.constants import AMINO_ACIDS, AMINO_ORDER, NUM_RBF
from helixframe.operators import geometry as G
from helixframe.operators import structure as S
from helixframe.plans import views as V
from helixframe.plans.common import big, joined, r6, table, with_ctes

ATOMS = [V.SQL_ATOMS]
RES = [V.SQL_ATOMS, V.SQL_RESIDUES]
ONE_CASE = "CASE resname " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in {**AMINO_ACIDS, "DA": "A", "DC": "C", "DG": "G", "DT": "T"}.items()) + " END"
PT = """v_pt AS (
  SELECT p.structure_id, p.kind_idx AS res_idx, p.chain, p.resname, p.has_ca,
    coalesce(p.ca_x, p.mx) AS x, coalesce(p.ca_y, p.my) AS y, coalesce(p.ca_z, p.mz) AS z FROM (
    SELECT r.structure_id, r.kind_idx, r.chain, r.resname, bool_or(a.name = 'CA') AS has_ca,
      arg_min(a.x, a.atom_ord) FILTER (WHERE a.name = 'CA') AS ca_x, avg(a.x) FILTER (WHERE heavy) AS mx,
      arg_min(a.y, a.atom_ord) FILTER (WHERE a.name = 'CA') AS ca_y, avg(a.y) FILTER (WHERE heavy) AS my,
      arg_min(a.z, a.atom_ord) FILTER (WHERE a.name = 'CA') AS ca_z, avg(a.z) FILTER (WHERE heavy) AS mz
    FROM v_prot r JOIN (SELECT *, element <> 'H' AND name NOT LIKE 'H%' AS heavy FROM v_atoms) a
      USING (structure_id, chain, resseq, icode, resname)
    GROUP BY ALL) p),
v_edge AS (
  SELECT s.structure_id, s.res_idx AS src, d.res_idx AS dst,
    sqrt((s.x-d.x)*(s.x-d.x)+(s.y-d.y)*(s.y-d.y)+(s.z-d.z)*(s.z-d.z)) AS dist
  FROM v_pt s JOIN v_pt d USING (structure_id)
  WHERE (s.x-d.x)*(s.x-d.x)+(s.y-d.y)*(s.y-d.y)+(s.z-d.z)*(s.z-d.z) < 196.0
    AND (s.x-d.x)*(s.x-d.x)+(s.y-d.y)*(s.y-d.y)+(s.z-d.z)*(s.z-d.z) > 0),
v_nres AS (SELECT structure_id, count(*) AS n_res FROM v_pt GROUP BY ALL)"""
GEO = [*RES, PT]


def points(spark, sf):
    """Points of the protein residues, densely indexed."""
    atoms = V.atoms(spark, sf)
    pts = S.ca_or_centroid(atoms.where(S.residue_kind() == "protein"))
    from helixframe.operators.ordering import dense_index

    return dense_index(pts, ["structure_id"], "res_ord", "res_idx")


def edges(spark, sf):
    return G.residue_graph_edges(points(spark, sf))


def group_residues(spark, sf):
    return S.group_residues(V.atoms(spark, sf)).select(
        "structure_id", "chain", "resseq", "icode", "resname", "res_ord", "n_atoms", big("res_idx").alias("res_idx"))


def infer_element(spark, sf):
    return S.infer_element(V.raw_atoms(spark, sf)).groupBy("name", "element").agg(F.count("*").alias("n"))


def parse_chain_list(spark, sf):
    m = V.manifest_rows(spark, sf)
    return m.select("ord", joined(S.parse_chain_list("protein_chains"), "|").alias("protein_set"),
                    joined(S.parse_chain_list("dna_chains"), "|").alias("dna_set"))


def classify_residues(spark, sf):
    return S.classify_residues(S.group_residues(V.atoms(spark, sf))).groupBy("structure_id", "kind").agg(
        F.count("*").alias("n_residues"), F.sum("n_atoms").alias("n_atoms"))


def select_residues(spark, sf):
    atoms = V.atoms(spark, sf)
    # Structures s0..s3 keep chains A and C, the others have no restriction.
    chains = atoms.select("structure_id").distinct().select(
        "structure_id", F.when(F.col("structure_id") < "s4", F.array(F.lit("A"), F.lit("C"))).alias("chains"))
    return S.select_residues(S.group_residues(atoms), "protein", chains).select(
        "structure_id", "chain", "resseq", "res_ord", big("sel_idx").alias("sel_idx"))


def residue_ids(spark, sf):
    return S.group_residues(V.atoms(spark, sf)).select("structure_id", "res_ord", S.residue_id().alias("residue_id"))


def _selected(spark, sf, kind):
    return S.select_residues(S.group_residues(V.atoms(spark, sf)), kind)


def residue_sequence(spark, sf):
    return S.residue_sequence(_selected(spark, sf, "protein")).select("structure_id", "sequence")


def dna_chain_sequences(spark, sf):
    return S.dna_chain_sequences(_selected(spark, sf, "dna")).select(
        "structure_id", "chain", big("chain_ord").alias("chain_ord"), "sequence",
        joined("indices").alias("indices"))


def heavy_atoms(spark, sf):
    return S.heavy_atoms(V.atoms(spark, sf)).groupBy("structure_id", "chain").agg(
        F.count("*").alias("n_heavy"), F.min("atom_ord").alias("first_ord"), F.max("atom_ord").alias("last_ord"))


def split_base_backbone(spark, sf):
    return S.split_base_backbone(V.atoms(spark, sf)).groupBy("structure_id", "part", "name").agg(F.count("*").alias("n"))


def ca_or_centroid(spark, sf):
    return points(spark, sf).select("structure_id", big("res_idx").alias("res_idx"), "has_ca", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


def missing_atom_audit(spark, sf):
    return S.missing_atom_audit(V.atoms(spark, sf)).select("structure_id", "res_ord", "kind", "missing", "n_heavy")


def monomer_guard(spark, sf):
    atoms = V.atoms(spark, sf)
    # One candidate input per (structure, chain, kind): the protein-only cuts pass.
    named = atoms.withColumn("structure_id", F.concat_ws(":", "structure_id", "chain", S.residue_kind()))
    return S.monomer_guard(named.select("structure_id").distinct(), named)


def encode_residue(spark, sf):
    return S.encode_residues(_selected(spark, sf, "protein")).select(
        "structure_id", big("sel_idx").alias("sel_idx"), big("aa_idx").alias("aa_idx"), joined("one_hot", "").alias("one_hot"))


def join_embeddings(spark, sf):
    sel = _selected(spark, sf, "protein")
    vec = table(spark, sf, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("structure_id"),
        (F.col("vec_id") * 21).alias("res_ord"), F.col("embedding").cast("array<double>").alias("vector"))
    keyed = vec.join(sel.select("structure_id", "res_ord", "sel_idx"), ["structure_id", "res_ord"]).drop("res_ord")
    # Residue 1 of every structure has no vector, residue 2 two of them.
    twice = keyed.unionByName(keyed.where(F.col("sel_idx") == 2))
    out = S.join_embeddings(sel, twice.where(F.col("sel_idx") != 1), width=64)
    return out.select("structure_id", big("sel_idx").alias("sel_idx"), "vec_error",
                      r6(F.expr("aggregate(vector, 0D, (s, v) -> s + v)")).alias("vec_sum"))


def min_group_distance(spark, sf):
    t = S.tag_atoms(V.atoms(spark, sf))
    a = t.where("kind = 'protein'").select("structure_id", F.col("res_ord").alias("a_id"), "x", "y", "z")
    b = t.where("kind = 'dna'").select("structure_id", F.col("res_ord").alias("b_id"), "x", "y", "z")
    return G.min_group_distance(a, b, 8.0).select("structure_id", "a_id", "b_id", r6("dist").alias("dist"))


def residue_graph_edges(spark, sf):
    return edges(spark, sf).select("structure_id", big("src").alias("src"), big("dst").alias("dst"), r6("dist").alias("dist"))


def rbf_encode(spark, sf):
    bins = edges(spark, sf).select("structure_id", big("src").alias("src"), G.rbf_encode(F.col("dist")).alias("v"))
    # Summed as columns: a row an edge, not one for each of its bins.
    per = bins.groupBy("structure_id", "src").agg(*[f(F.get("v", F.lit(k))).alias(f"{n}{k}") for k in range(NUM_RBF) for n, f in (("s", F.sum), ("m", F.max))])
    each = F.posexplode(F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.col(f"m{k}").alias("m")) for k in range(NUM_RBF)])).alias("k", "v")
    return per.select("structure_id", "src", each).select("structure_id", "src", big("k").alias("k"), r6("v.s").alias("rbf_sum"), r6("v.m").alias("rbf_max"))


def sequence_separation(spark, sf):
    pts = points(spark, sf)
    e = G.sized_edges(pts)
    return e.select("structure_id", big("src").alias("src"), big("dst").alias("dst"),
                    r6(G.sequence_separation(F.col("src"), F.col("dst"), F.col("n_res"))).alias("seq_sep"))


def _features(spark, sf):
    pts = points(spark, sf)
    return pts, G.edge_features(G.sized_edges(pts))


def edge_features(spark, sf):
    _, e = _features(spark, sf)
    return e.select("structure_id", big("src").alias("src"), big("dst").alias("dst"), big(F.size("edge_attr")).alias("width"),
                    *[r6(F.expr(f"edge_attr[{k}]")).alias(f"bin_{k}") for k in range(16)],
                    r6(F.expr("edge_attr[16]")).alias("seq_sep"))


def center_radius(spark, sf):
    return G.center_radius(points(spark, sf)).select(
        "structure_id", big("res_idx").alias("res_idx"), r6("c_x").alias("c_x"), r6("c_y").alias("c_y"), r6("c_z").alias("c_z"), r6("radius").alias("radius"))


def neighbor_aggregate(spark, sf):
    pts, e = _features(spark, sf)
    nodes = pts.withColumn("aa", (F.instr(F.lit(AMINO_ORDER), S.one_letter()) - 1).cast("double"))
    out = G.neighbor_aggregate(nodes, e.withColumn("gate", F.col("seq_sep")), ["aa"])
    return out.select("structure_id", big("res_idx").alias("res_idx"), big("degree").alias("degree"),
                      r6("sum_aa").alias("sum_aa"), *[r6(f"shift_{a}").alias(f"shift_{a}") for a in "xyz"])


QUERIES = {
    "group_residues": group_residues, "infer_element": infer_element, "parse_chain_list": parse_chain_list,
    "classify_residues": classify_residues, "select_residues": select_residues, "residue_ids": residue_ids,
    "residue_sequence": residue_sequence, "dna_chain_sequences": dna_chain_sequences, "heavy_atoms": heavy_atoms,
    "split_base_backbone": split_base_backbone, "ca_or_centroid": ca_or_centroid,
    "missing_atom_audit": missing_atom_audit, "monomer_guard": monomer_guard, "encode_residue": encode_residue,
    "join_embeddings": join_embeddings, "min_group_distance": min_group_distance,
    "residue_graph_edges": residue_graph_edges, "rbf_encode": rbf_encode,
    "sequence_separation": sequence_separation, "edge_features": edge_features, "center_radius": center_radius,
    "neighbor_aggregate": neighbor_aggregate,
}

_CHAINSET = """CASE WHEN trim({c}) = '' THEN NULL ELSE array_to_string(
  list_transform(string_split({c}, ','), lambda x: CASE WHEN trim(x) = '' THEN '_' ELSE trim(x) END), '|') END"""
_SEP = "ln(1 + abs(src - dst)) / ln(1 + greatest(n_res - 1, 1))"
_RBF = "exp(-(dist - 20.0*k/15)*(dist - 20.0*k/15) / ((20.0/15)*(20.0/15)))"
_IDX = f"(strpos('{AMINO_ORDER}', {ONE_CASE}) - 1)"

ORACLES = {
    "group_residues": with_ctes(RES, "SELECT structure_id, chain, resseq, icode, resname, res_ord, n_atoms, res_idx FROM v_res"),
    "infer_element": with_ctes(ATOMS, "SELECT name, element, count(*) AS n FROM v_atoms GROUP BY ALL"),
    "parse_chain_list": with_ctes([V.SQL_MANIFEST], f"SELECT ord, {_CHAINSET.format(c='protein_chains')} AS protein_set, {_CHAINSET.format(c='dna_chains')} AS dna_set FROM v_man"),
    "classify_residues": with_ctes(RES, "SELECT structure_id, kind, count(*) AS n_residues, sum(n_atoms)::BIGINT AS n_atoms FROM v_res GROUP BY ALL"),
    "select_residues": with_ctes(RES, """SELECT structure_id, chain, resseq, res_ord,
        row_number() OVER (PARTITION BY structure_id ORDER BY res_ord) - 1 AS sel_idx
        FROM v_prot WHERE structure_id >= 's4' OR chain IN ('A','C')"""),
    "residue_ids": with_ctes(RES, "SELECT structure_id, res_ord, chain || ':' || resseq || icode AS residue_id FROM v_res"),
    "residue_sequence": with_ctes(RES, f"SELECT structure_id, string_agg({ONE_CASE}, '' ORDER BY kind_idx) AS sequence FROM v_prot GROUP BY ALL"),
    "dna_chain_sequences": with_ctes(RES, f"""SELECT structure_id, chain, min(kind_idx) AS chain_ord,
        string_agg({ONE_CASE}, '' ORDER BY kind_idx) AS sequence, string_agg(kind_idx::VARCHAR, ',' ORDER BY kind_idx) AS indices
        FROM v_dna GROUP BY structure_id, chain"""),
    "heavy_atoms": with_ctes(ATOMS, "SELECT structure_id, chain, count(*) AS n_heavy, min(atom_ord) AS first_ord, max(atom_ord) AS last_ord FROM v_heavy GROUP BY ALL"),
    "split_base_backbone": with_ctes(ATOMS, "SELECT structure_id, CASE WHEN is_base THEN 'base' ELSE 'backbone' END AS part, name, count(*) AS n FROM v_heavy WHERE kind = 'dna' GROUP BY ALL"),
    "ca_or_centroid": with_ctes(GEO, "SELECT structure_id, res_idx, has_ca, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM v_pt"),
    "missing_atom_audit": with_ctes([*RES], """SELECT * FROM (SELECT r.structure_id, r.res_ord, r.kind,
        CASE WHEN count(h.x) = 0 THEN 'heavy' WHEN r.kind = 'dna' AND count_if(h.is_base) = 0 THEN 'base'
             WHEN r.kind = 'dna' AND count_if(NOT h.is_base) = 0 THEN 'backbone' END AS missing, count(h.x) AS n_heavy
        FROM v_res r LEFT JOIN v_heavy h USING (structure_id, chain, resseq, icode, resname)
        GROUP BY r.structure_id, r.res_ord, r.kind) WHERE missing IS NOT NULL"""),
    "monomer_guard": with_ctes(ATOMS, "SELECT DISTINCT structure_id || ':' || chain || ':' || kind AS structure_id FROM v_atoms WHERE kind = 'protein'"),
    "encode_residue": with_ctes(RES, f"SELECT structure_id, kind_idx AS sel_idx, {_IDX} AS aa_idx, repeat('0', {_IDX}) || '1' || repeat('0', 19 - {_IDX}) AS one_hot FROM v_prot"),
    "join_embeddings": with_ctes(RES, """SELECT p.structure_id, p.kind_idx AS sel_idx,
        CASE WHEN p.kind_idx = 1 THEN 'missing vector' WHEN p.kind_idx = 2 THEN '2 vectors' END AS vec_error,
        CASE WHEN p.kind_idx <> 1 THEN round(list_sum(e.embedding::DOUBLE[]), 6) END AS vec_sum
        FROM v_prot p JOIN embeddings e ON e.vec_id = p.resseq"""),
    "min_group_distance": with_ctes([*RES], """SELECT structure_id, a_id, b_id, round(sqrt(min(d2)), 6) AS dist FROM (
        SELECT structure_id, p.atom_ord // 21 * 21 AS a_id, d.atom_ord // 21 * 21 AS b_id,
          (p.x-d.x)*(p.x-d.x)+(p.y-d.y)*(p.y-d.y)+(p.z-d.z)*(p.z-d.z) AS d2
        FROM v_heavy p JOIN v_heavy d USING (structure_id) WHERE p.kind = 'protein' AND d.kind = 'dna')
        WHERE sqrt(d2) <= 8.0 GROUP BY ALL"""),
    "residue_graph_edges": with_ctes(GEO, "SELECT structure_id, src, dst, round(dist, 6) AS dist FROM v_edge"),
    "rbf_encode": with_ctes(GEO, f"""SELECT structure_id, src, k, round(sum({_RBF}), 6) AS rbf_sum, round(max({_RBF}), 6) AS rbf_max
        FROM (SELECT *, unnest(range(16)) AS k FROM v_edge) GROUP BY ALL"""),
    "sequence_separation": with_ctes(GEO, f"SELECT structure_id, src, dst, round({_SEP}, 6) AS seq_sep FROM v_edge JOIN v_nres USING (structure_id)"),
    "edge_features": with_ctes(GEO, f"""SELECT structure_id, src, dst, 17::BIGINT AS width,
        {", ".join(f"round({_RBF.replace('k', str(k))}, 6) AS bin_{k}" for k in range(16))},
        round({_SEP}, 6) AS seq_sep FROM v_edge JOIN v_nres USING (structure_id)"""),
    "center_radius": with_ctes(GEO, """SELECT structure_id, res_idx, round(cx, 6) + 0.0::DOUBLE AS c_x, round(cy, 6) + 0.0::DOUBLE AS c_y, round(cz, 6) + 0.0::DOUBLE AS c_z,
        round(sqrt(cx*cx + cy*cy + cz*cz) / 20, 6) AS radius FROM (
        SELECT p.structure_id, p.res_idx, x - mx AS cx, y - my AS cy, z - mz AS cz FROM v_pt p JOIN (
          SELECT structure_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v_pt GROUP BY ALL) USING (structure_id))"""),
    "neighbor_aggregate": with_ctes(GEO, f"""SELECT n.structure_id, n.res_idx, coalesce(count(e.src), 0) AS degree,
        coalesce(round(sum({_IDX.replace('resname', 's.resname')}), 6), 0.0)::DOUBLE AS sum_aa,
        coalesce(round(sum((n.x - s.x) * 0.1 * {_SEP}) / count(e.src), 6), 0.0) + 0.0::DOUBLE AS shift_x,
        coalesce(round(sum((n.y - s.y) * 0.1 * {_SEP}) / count(e.src), 6), 0.0) + 0.0::DOUBLE AS shift_y,
        coalesce(round(sum((n.z - s.z) * 0.1 * {_SEP}) / count(e.src), 6), 0.0) + 0.0::DOUBLE AS shift_z
        FROM v_pt n JOIN v_nres USING (structure_id)
        LEFT JOIN v_edge e ON e.structure_id = n.structure_id AND e.dst = n.res_idx
        LEFT JOIN v_pt s ON s.structure_id = e.structure_id AND s.res_idx = e.src
        GROUP BY n.structure_id, n.res_idx"""),
}
