"""Typed views over the driver tables: one DataFrame function and one SQL text
per view.  Both read the whole tables; arithmetic on keys only *assigns* labels
(chain letters, splits, formats), it never drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions.constants import AMINO_ACIDS
from helixframe.functions.pwm import normalized, settled
from helixframe.plans.common import table

BACKBONE_NAMES = ["P", "OP1", "OP2", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C1'"]
BASE_NAMES = ["N1", "C2", "N3", "C4", "C5", "C6", "N7", "C8", "N9", "O6"]
ALT_BACKBONE = ["C1*", "C2*", "C3*", "C4*", "C5*", "O2*", "O3*", "O4*", "O5*", "O3P"]
ALT_BASE = ["N2", "N4", "N6", "O2", "O4", "C7", "CM", "NX", "OX", "CX"]
AMINO3 = list(AMINO_ACIDS)
DNA3 = ["DA", "DC", "DG", "DT"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _arr(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


# --------------------------------------------------------------------- motifs
def pwm(spark: SparkSession, sf: str) -> DataFrame:
    """motif_id, pos, a, c, g, t: 16 rows per embedding vector."""
    raw = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("motif_id"),
        F.col("embedding").cast("array<double>").alias("e"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"),
    )
    w = [F.abs(F.expr(f"e[4 * pos + {k}]")) for k in range(4)]
    return settled(raw, ["motif_id", "pos"], dict(zip("acgt", normalized(w), strict=True)))


SQL_PWM = """v_pwm AS (
  SELECT motif_id, pos, wa/s AS a, wc/s AS c, wg/s AS g, wt/s AS t FROM (
    SELECT *, wa + wc + wg + wt AS s FROM (
      SELECT vec_id AS motif_id, p AS pos,
             greatest(abs(embedding[4*p+1]::DOUBLE), 1e-8) AS wa,
             greatest(abs(embedding[4*p+2]::DOUBLE), 1e-8) AS wc,
             greatest(abs(embedding[4*p+3]::DOUBLE), 1e-8) AS wg,
             greatest(abs(embedding[4*p+4]::DOUBLE), 1e-8) AS wt
      FROM embeddings CROSS JOIN (SELECT unnest(range(16)) AS p) r)))"""


def pwm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Motif t as target beside motif t+1 as prediction, row by row."""
    v = pwm(spark, sf)
    p = v.select(
        (F.col("motif_id") - 1).alias("motif_id"), "pos",
        F.col("a").alias("p_a"), F.col("c").alias("p_c"),
        F.col("g").alias("p_g"), F.col("t").alias("p_t"),
    )
    return v.join(p, ["motif_id", "pos"]).withColumnRenamed("motif_id", "sample_id")


SQL_PWMPAIR = """v_pair AS (
  SELECT x.motif_id AS sample_id, x.pos, x.a, x.c, x.g, x.t,
         y.a AS p_a, y.c AS p_c, y.g AS p_g, y.t AS p_t
  FROM v_pwm x JOIN v_pwm y ON y.motif_id = x.motif_id + 1 AND y.pos = x.pos)"""


def motifs(spark: SparkSession, sf: str) -> DataFrame:
    """Every 16-row matrix split into two whole motifs of 6..10 positions."""
    v = pwm(spark, sf)
    head = 6 + F.col("motif_id") % 5
    second = F.col("pos") >= head
    return v.select(
        (F.col("motif_id") * 2 + second.cast("int")).alias("motif_id"),
        (F.col("pos") - F.when(second, head).otherwise(0)).cast("int").alias("pos"),
        "a", "c", "g", "t",
    )


SQL_MOTIF = """v_motif AS (
  SELECT motif_id*2 + (CASE WHEN pos >= 6 + motif_id % 5 THEN 1 ELSE 0 END) AS motif_id,
         pos - (CASE WHEN pos >= 6 + motif_id % 5 THEN 6 + motif_id % 5 ELSE 0 END) AS pos,
         a, c, g, t FROM v_pwm)"""


# ---------------------------------------------------------------------- atoms
def raw_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Atom records as a structure file would give them (element may be blank)."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("r"), "label",
        F.col("embedding").cast("array<double>").alias("e"),
        F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"),
    )
    half = F.expr("r div 2")
    is_protein = F.col("r") % 2 == 0
    protein_name = (
        F.when(F.col("j") == 0, F.when(F.col("r") % 26 == 0, "CB").otherwise("CA"))
        .when(F.col("j") < 20, F.concat(F.expr("substring('CNOS', j % 4 + 1, 1)"), F.col("j").cast("string")))
        .otherwise(F.when(F.col("r") % 3 == 0, "1HB").otherwise("HA"))
    )
    jm = (F.col("j") % 10).cast("int")
    dna_name = (
        F.when(F.col("j") == 20, F.when(F.col("r") % 3 == 0, "1H5").otherwise("H8"))
        .when(F.col("j") < 10,
              F.when(F.col("r") % 1009 == 3, F.get(_arr(ALT_BASE), jm)).otherwise(F.get(_arr(BACKBONE_NAMES), jm)))
        .otherwise(F.when(F.col("r") % 29 == 1, F.get(_arr(ALT_BACKBONE), jm)).otherwise(F.get(_arr(BASE_NAMES), jm)))
    )
    out = e.select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("structure_id"),
        (F.col("r") * 21 + F.col("j")).alias("atom_ord"),
        F.when(F.col("r") % 11 == 0, "HETATM").otherwise("ATOM").alias("record"),
        F.when(is_protein, protein_name).otherwise(dna_name).alias("name"),
        F.when(is_protein, F.get(_arr(AMINO3), (half % 20).cast("int")))
        .otherwise(F.get(_arr(DNA3), (F.expr("r div 10") % 4).cast("int"))).alias("resname"),
        F.expr("substring('ABCD', cast((r div 2) % 4 as int) + 1, 1)").alias("chain"),
        F.col("r").cast("int").alias("resseq"),
        F.when(F.col("r") % 37 == 5, "A").otherwise("").alias("icode"),
        F.expr("round(8 * ((r div 10) % 5) + 12 * e[3*j], 3)").alias("x"),
        F.expr("round(8 * ((r div 50) % 5) + 12 * e[3*j+1], 3)").alias("y"),
        F.expr("round(8 * ((r div 250) % 4) + 12 * e[3*j+2], 3)").alias("z"),
        "r", "j",
    )
    return out.withColumn(
        "element",
        F.when(F.col("r") % 5 == 0, "").when(F.col("j") == 20, "H").otherwise(F.substring("name", 1, 1)),
    ).drop("r", "j")


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    from helixframe.operators.structure import infer_element

    return infer_element(raw_atoms(spark, sf))


SQL_ATOMS = f"""v_raw AS (
  SELECT 's' || label AS structure_id, r*21 + j AS atom_ord,
    CASE WHEN r % 11 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record,
    CASE WHEN r % 2 = 0 THEN
      CASE WHEN j = 0 THEN (CASE WHEN r % 26 = 0 THEN 'CB' ELSE 'CA' END)
           WHEN j < 20 THEN substr('CNOS', j % 4 + 1, 1) || j
           WHEN r % 3 = 0 THEN '1HB' ELSE 'HA' END
    ELSE
      CASE WHEN j = 20 THEN (CASE WHEN r % 3 = 0 THEN '1H5' ELSE 'H8' END)
           WHEN j < 10 THEN (CASE WHEN r % 1009 = 3 THEN {_sql_list(ALT_BASE)}[j % 10 + 1]
                                  ELSE {_sql_list(BACKBONE_NAMES)}[j % 10 + 1] END)
           ELSE (CASE WHEN r % 29 = 1 THEN {_sql_list(ALT_BACKBONE)}[j % 10 + 1]
                      ELSE {_sql_list(BASE_NAMES)}[j % 10 + 1] END) END
    END AS name,
    CASE WHEN r % 2 = 0 THEN {_sql_list(AMINO3)}[(r // 2) % 20 + 1]
         ELSE {_sql_list(DNA3)}[(r // 10) % 4 + 1] END AS resname,
    substr('ABCD', ((r // 2) % 4 + 1)::INT, 1) AS chain,
    r::INT AS resseq, CASE WHEN r % 37 = 5 THEN 'A' ELSE '' END AS icode,
    round(8 * ((r // 10) % 5) + 12 * embedding[3*j+1]::DOUBLE, 3) AS x,
    round(8 * ((r // 50) % 5) + 12 * embedding[3*j+2]::DOUBLE, 3) AS y,
    round(8 * ((r // 250) % 4) + 12 * embedding[3*j+3]::DOUBLE, 3) AS z,
    r, j
  FROM (SELECT vec_id AS r, label, embedding, unnest(range(21)) AS j FROM embeddings)),
v_rawel AS (
  SELECT *, CASE WHEN r % 5 = 0 THEN '' WHEN j = 20 THEN 'H' ELSE substr(name, 1, 1) END AS element_raw
  FROM v_raw),
v_atoms AS (
  SELECT *, CASE WHEN element_raw <> '' THEN element_raw
                 WHEN regexp_matches(name, '^[0-9].') THEN upper(substr(name, 2, 1))
                 ELSE upper(substr(name, 1, 1)) END AS element,
         CASE WHEN r % 2 = 0 THEN 'protein' ELSE 'dna' END AS kind
  FROM v_rawel),
v_heavy AS (
  SELECT *, NOT (name IN ('P','OP1','OP2','OP3','O1P','O2P','O3P') OR name LIKE '%''' OR name LIKE '%*') AS is_base
  FROM v_atoms WHERE element <> 'H' AND name NOT LIKE 'H%')"""

# Residue level: dense indices per structure, for all residues and per kind.
SQL_RESIDUES = """v_res0 AS (
  SELECT structure_id, kind, chain, resseq, icode, resname, min(atom_ord) AS res_ord, count(*) AS n_atoms
  FROM v_atoms GROUP BY ALL),
v_res AS (
  SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY res_ord) - 1 AS res_idx,
         row_number() OVER (PARTITION BY structure_id, kind ORDER BY res_ord) - 1 AS kind_idx
  FROM v_res0),
v_prot AS (SELECT * FROM v_res WHERE kind = 'protein'),
v_dna AS (SELECT * FROM v_res WHERE kind = 'dna')"""

# Minimum distances per protein residue and DNA residue, base and backbone apart.
SQL_MINDIST = """v_hp AS (
  SELECT h.structure_id, p.kind_idx AS res_idx, h.x, h.y, h.z FROM v_heavy h
  JOIN v_prot p USING (structure_id, chain, resseq, icode, resname)),
v_hd AS (
  SELECT h.structure_id, d.kind_idx AS dna_idx, h.is_base, h.x, h.y, h.z FROM v_heavy h
  JOIN v_dna d USING (structure_id, chain, resseq, icode, resname)),
v_mind AS (
  SELECT p.structure_id, p.res_idx, d.dna_idx,
    sqrt(min((p.x-d.x)*(p.x-d.x)+(p.y-d.y)*(p.y-d.y)+(p.z-d.z)*(p.z-d.z)) FILTER (WHERE d.is_base)) AS base_dist,
    sqrt(min((p.x-d.x)*(p.x-d.x)+(p.y-d.y)*(p.y-d.y)+(p.z-d.z)*(p.z-d.z)) FILTER (WHERE NOT d.is_base)) AS backbone_dist
  FROM v_hp p JOIN v_hd d USING (structure_id) GROUP BY ALL)"""


# --------------------------------------------------------------------- chains
def text_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is a sample; each of its lines, reduced to ACGT, is a chain.

    sample_id, chain_ord, chain, sequence, offset (residues before this chain),
    motif_id.  Whole texts are used.
    """
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.posexplode(F.split(F.regexp_replace(F.upper("text"), "[^ACGT\n]+", ""), "\n")).alias("chain_ord", "sequence"),
    ).where(F.length("sequence") > 0)
    before = Window.partitionBy("sample_id").orderBy("chain_ord").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(
        "sample_id", "chain_ord",
        F.concat(F.lit("L"), F.col("chain_ord").cast("string")).alias("chain"),
        "sequence",
        F.coalesce(F.sum(F.length("sequence")).over(before), F.lit(0)).cast("int").alias("offset"),
        (F.col("sample_id") % 1000).alias("motif_id"),
    )


SQL_CHAIN = """v_chain AS (
  SELECT sample_id, chain_ord, 'L' || chain_ord AS chain, sequence,
    coalesce(sum(length(sequence)) OVER (PARTITION BY sample_id ORDER BY chain_ord
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
    sample_id % 1000 AS motif_id
  FROM (SELECT doc_id AS sample_id, unnest(range(len(ls))) AS chain_ord, unnest(ls) AS sequence
        FROM (SELECT doc_id, string_split(regexp_replace(upper(text), '[^ACGT\\n]', '', 'g'), chr(10)) AS ls FROM documents))
  WHERE length(sequence) > 0)"""


# ------------------------------------------------------- contacts, predictions
def contact_cells(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, res_idx, slot, base_label, base_mask, backbone_label,
    contact_label, score; 30 consecutive orders form one sample."""
    li = table(spark, sf, "lineitem")
    cells = li.groupBy(
        F.expr("l_orderkey div 30").alias("sample_id"),
        F.col("l_linenumber").cast("int").alias("res_idx"),
        (F.col("l_partkey") % 8).cast("int").alias("slot"),
    ).agg(
        F.max((F.col("l_quantity") > 25).cast("int")).alias("base_label"),
        F.max((F.col("l_returnflag") != "N").cast("int")).alias("base_mask"),
        F.max((F.col("l_discount") > 0.05).cast("int")).alias("backbone_label"),
        F.max("l_extendedprice").alias("score"),
    )
    return cells.withColumn("contact_label", F.greatest("base_label", "backbone_label"))


SQL_CONTACT = """v_contact AS (
  SELECT *, greatest(base_label, backbone_label) AS contact_label FROM (
    SELECT l_orderkey // 30 AS sample_id, l_linenumber AS res_idx, l_partkey % 8 AS slot,
      max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS base_label,
      max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS base_mask,
      max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS backbone_label,
      max(l_extendedprice) AS score
    FROM lineitem GROUP BY ALL))"""


def model_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Per-model logits and energies on the same cells."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        (F.col("l_suppkey") % 5).alias("model_id"),
        F.expr("l_orderkey div 30").alias("sample_id"),
        F.col("l_linenumber").cast("int").alias("res_idx"),
        (F.col("l_partkey") % 8).cast("int").alias("slot"),
    ).agg(
        F.avg((F.col("l_quantity") - 25) / 10).alias("base_logit"),
        F.avg((F.col("l_discount") - 0.05) * 40).alias("backbone_logit"),
        F.avg(F.col("l_tax") * 10).alias("e_a"),
        F.avg(F.col("l_discount") * 10).alias("e_c"),
        F.avg(F.col("l_quantity") / 50).alias("e_g"),
        F.avg(F.col("l_extendedprice") / 1e5).alias("e_t"),
    )


SQL_MODEL = """v_model AS (
  SELECT l_suppkey % 5 AS model_id, l_orderkey // 30 AS sample_id, l_linenumber AS res_idx, l_partkey % 8 AS slot,
    avg((l_quantity - 25) / 10) AS base_logit, avg((l_discount - 0.05) * 40) AS backbone_logit,
    avg(l_tax * 10) AS e_a, avg(l_discount * 10) AS e_c, avg(l_quantity / 50) AS e_g,
    avg(l_extendedprice / 1e5) AS e_t
  FROM lineitem GROUP BY ALL)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Ensemble means per cell: what the network would have written.  Logits are
    rounded to 12 digits so that equal means tie exactly in any summation order."""
    from helixframe.operators.predictions import ensemble_mean

    out = ensemble_mean(model_cells(spark, sf), ["sample_id", "res_idx", "slot"],
                        ["base_logit", "backbone_logit", "e_a", "e_c", "e_g", "e_t"]).drop("n_models", "error")
    return out.withColumn("base_logit", F.round("base_logit", 12)).withColumn(
        "backbone_logit", F.round("backbone_logit", 12))


SQL_PRED = """v_pred AS (
  SELECT *, 1 / (1 + exp(-base_logit)) AS a_base FROM (
    SELECT sample_id, res_idx, slot, round(avg(base_logit), 12) AS base_logit, round(avg(backbone_logit), 12) AS backbone_logit,
      avg(e_a) AS e_a, avg(e_c) AS e_c, avg(e_g) AS e_g, avg(e_t) AS e_t
    FROM v_model GROUP BY ALL))"""


def sample_pwm(spark: SparkSession, sf: str) -> DataFrame:
    """Target motif rows of the prediction samples: 8 slots of motif sample % 500,
    rows 2*slot and 2*slot+1 averaged so that the whole matrix is used."""
    keys = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 30").alias("sample_id")).distinct()
    slots = pwm(spark, sf).groupBy("motif_id", F.expr("pos div 2").cast("int").alias("slot")).agg(
        *[F.avg(b).alias(b) for b in "acgt"])
    return keys.withColumn("motif_id", F.col("sample_id") % 500).join(slots, "motif_id").drop("motif_id")


SQL_SAMPLE_PWM = """v_spwm AS (
  SELECT k.sample_id, s.slot, s.a, s.c, s.g, s.t
  FROM (SELECT DISTINCT l_orderkey // 30 AS sample_id FROM lineitem) k
  JOIN (SELECT motif_id, pos // 2 AS slot, avg(a) AS a, avg(c) AS c, avg(g) AS g, avg(t) AS t
        FROM v_pwm GROUP BY ALL) s ON s.motif_id = k.sample_id % 500)"""


# ------------------------------------------------------------------ binary rows
def binary_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("y_true"))
    return docs.join(labels, "doc_id").select(
        "grp", F.col("doc_id").alias("row_id"), "y_true",
        (((F.col("doc_id") * 7919) % 997) / F.lit(997.0)).alias("score"))


SQL_BINARY = """v_bin AS (
  SELECT source AS grp, doc_id AS row_id, quality AS y_true, ((doc_id * 7919) % 997) / 997.0::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id))"""


# ------------------------------------------------------------ folds, manifests
def fold_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of fold lists: split, ord, entry."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    motif = (
        F.when(k % 3 == 0, F.concat(F.lit("MA"), F.lpad((F.col("o_custkey") % 50).cast("string"), 4, "0"), F.lit(".1.jaspar")))
        .when(k % 3 == 1, F.concat(F.lit("TF"), (F.col("o_custkey") % 50).cast("string"), F.lit("_HUMAN.H11MO.0.A")))
        .otherwise(F.concat(F.lit("TF"), (F.col("o_custkey") % 50).cast("string"), F.lit("_MOUSE.H11MO.0.B")))
    )
    chain = F.when(k % 23 == 7, F.lit("AA")).otherwise(F.expr("substring('ABCD', cast(o_orderkey % 4 as int) + 1, 1)"))
    split = F.when(k % 7 == 0, "id").otherwise(
        F.concat(F.when(k % 6 == 0, "valid").otherwise("train"), (k % 5).cast("string")))
    return o.select(
        split.alias("split"), k.alias("ord"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string"), F.lit("_"), chain, F.lit("_"), motif, F.lit(".npz")).alias("entry"))


SQL_FOLDS = """v_lines AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'id'
              ELSE (CASE WHEN o_orderkey % 6 = 0 THEN 'valid' ELSE 'train' END) || (o_orderkey % 5) END AS split,
    o_orderkey AS ord,
    'P' || o_custkey AS rid,
    CASE WHEN o_orderkey % 23 = 7 THEN 'AA' ELSE substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) END AS chain,
    CASE WHEN o_orderkey % 3 = 0 THEN 'MA' || lpad((o_custkey % 50)::VARCHAR, 4, '0') || '.1.jaspar'
         WHEN o_orderkey % 3 = 1 THEN 'TF' || (o_custkey % 50) || '_HUMAN.H11MO.0.A'
         ELSE 'TF' || (o_custkey % 50) || '_MOUSE.H11MO.0.B' END AS motif_id
  FROM orders),
v_folds AS (
  SELECT split, ord, rid || '_' || chain || '_' || motif_id || '.npz' AS entry,
         lower(rid) AS structure_id, chain, motif_id FROM v_lines)"""


def motif_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the motif ids of odd-numbered factors plus a second, later
    version of some of them; ids of parts serve as the source of rows."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"))
    n = F.col("ord") % 47
    motif = (
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("MA"), F.lpad(n.cast("string"), 4, "0"), F.lit(".1.jaspar")))
        .when(F.col("ord") % 3 == 1, F.concat(F.lit("TF"), n.cast("string"), F.lit("_HUMAN.H11MO.0.A")))
        .otherwise(F.concat(F.lit("TF"), n.cast("string"), F.lit("_MOUSE.H11MO.0.B"))))
    return p.select(
        "ord",
        F.when(F.col("ord") % 101 == 5, "").otherwise(motif).alias("motif_id"),
        F.when(F.col("ord") % 3 == 0, "JASPAR").otherwise("HOCOMOCO").alias("motif_source"),
        F.concat(F.lit("v"), F.expr("ord div 141").cast("string")).alias("motif_version"),
        F.concat(F.lit("pwms/m"), F.col("ord").cast("string"), F.lit(".txt")).alias("motif_path"))


SQL_INDEX = """v_index AS (
  SELECT p_partkey AS ord,
    CASE WHEN p_partkey % 101 = 5 THEN ''
         WHEN p_partkey % 3 = 0 THEN 'MA' || lpad((p_partkey % 47)::VARCHAR, 4, '0') || '.1.jaspar'
         WHEN p_partkey % 3 = 1 THEN 'TF' || (p_partkey % 47) || '_HUMAN.H11MO.0.A'
         ELSE 'TF' || (p_partkey % 47) || '_MOUSE.H11MO.0.B' END AS motif_id,
    CASE WHEN p_partkey % 3 = 0 THEN 'JASPAR' ELSE 'HOCOMOCO' END AS motif_source,
    'v' || (p_partkey // 141) AS motif_version, 'pwms/m' || p_partkey || '.txt' AS motif_path
  FROM part)"""


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Source manifest rows as read (12 strings) plus ``ord``."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "source", "lang")
    k = F.col("ord")
    ks = k.cast("string")
    fmts = _arr(["pdb", "cif", "mmcif", "pdbx", ".PDB", "xyz"])
    return d.select(
        "ord",
        F.when(k % 41 == 3, " ").otherwise(F.concat(F.lit(" smp"), ks)).alias("sample_id"),
        F.col("source").alias("split"),
        F.when(k % 43 == 4, "").otherwise(F.concat(F.lit("S"), F.upper("lang"), ks)).alias("structure_id"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("/data/st/"), ks, F.lit(".pdb")))
        .otherwise(F.concat(F.lit("st/"), ks, F.lit(".cif"))).alias("structure_path"),
        F.get(fmts, (k % 6).cast("int")).alias("structure_format"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "A, B").when(k % 5 == 2, "A,,C").otherwise("A").alias("protein_chains"),
        F.when(k % 4 == 0, "").otherwise("C,D").alias("dna_chains"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("m"), (k % 200).cast("string"))).alias("motif_id"),
        F.lit("JASPAR").alias("motif_source"), F.lit("v1").alias("motif_version"),
        F.when(k % 19 == 2, "").when(k % 2 == 0, F.concat(F.lit("/data/pwm/"), ks, F.lit(".txt")))
        .otherwise(F.concat(F.lit("pwm/"), ks, F.lit(".txt"))).alias("motif_path"),
        F.lit("").alias("notes"))


SQL_MANIFEST = """v_man AS (
  SELECT doc_id AS ord,
    CASE WHEN doc_id % 41 = 3 THEN ' ' ELSE ' smp' || doc_id END AS sample_id, source AS split,
    CASE WHEN doc_id % 43 = 4 THEN '' ELSE 'S' || upper(lang) || doc_id END AS structure_id,
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/data/st/' || doc_id || '.pdb' ELSE 'st/' || doc_id || '.cif' END AS structure_path,
    ['pdb','cif','mmcif','pdbx','.PDB','xyz'][doc_id % 6 + 1] AS structure_format,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'A, B' WHEN 2 THEN 'A,,C' ELSE 'A' END AS protein_chains,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'C,D' END AS dna_chains,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'm' || (doc_id % 200) END AS motif_id,
    'JASPAR' AS motif_source, 'v1' AS motif_version,
    CASE WHEN doc_id % 19 = 2 THEN '' WHEN doc_id % 2 = 0 THEN '/data/pwm/' || doc_id || '.txt'
         ELSE 'pwm/' || doc_id || '.txt' END AS motif_path, '' AS notes
  FROM documents)"""


def failure_rows(spark: SparkSession, sf: str) -> DataFrame:
    """split, ord, entry, reason (NULL = success) from the event log."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    i = F.col("event_id").cast("string")
    texts = [
        F.concat(F.lit("DNA residue C:"), i, F.lit(" has no base heavy atoms.")),
        F.concat(F.lit("DNA residue C:"), i, F.lit(" has no backbone heavy atoms.")),
        F.concat(F.lit("No selected DNA chain is long enough for PWM length "), i),
        F.concat(F.lit("No PWM-DNA alignment candidate passed contact constraints. candidate_count="), i),
        F.lit("No protein residues found. Check --protein-chains."),
        F.lit("HTTPError 404"),
        F.concat(F.lit("Curated PWM not found for m"), i),
        F.lit("skip_multi_char_chain"),
        F.lit("esm2 weights missing"),
        F.lit("out of memory"),
    ]
    return ev.select(
        F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("split"),
        F.col("event_id").alias("ord"), F.concat(F.lit("e"), i).alias("entry"),
        F.get(F.array(*texts), (F.col("event_id") % 11).cast("int")).alias("reason"))


SQL_FAIL = """v_fail AS (
  SELECT 'w' || (user_id % 8) AS split, event_id AS ord, 'e' || event_id AS entry,
    CASE event_id % 11
      WHEN 0 THEN 'DNA residue C:' || event_id || ' has no base heavy atoms.'
      WHEN 1 THEN 'DNA residue C:' || event_id || ' has no backbone heavy atoms.'
      WHEN 2 THEN 'No selected DNA chain is long enough for PWM length ' || event_id
      WHEN 3 THEN 'No PWM-DNA alignment candidate passed contact constraints. candidate_count=' || event_id
      WHEN 4 THEN 'No protein residues found. Check --protein-chains.'
      WHEN 5 THEN 'HTTPError 404'
      WHEN 6 THEN 'Curated PWM not found for m' || event_id
      WHEN 7 THEN 'skip_multi_char_chain'
      WHEN 8 THEN 'esm2 weights missing'
      WHEN 9 THEN 'out of memory' END AS reason
  FROM events)"""


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("sample_id"), F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("method"),
        (F.col("o_totalprice") / 1e5).alias("pwm_mae"),
        F.when(k % 10 == 0, None).otherwise(F.col("o_totalprice") / 2e5).alias("pwm_kl"),
        F.when(k % 14 == 3, F.lit(float("nan"))).otherwise((k % 101) / F.lit(101.0)).alias("site_ap"),
        (k % 13).cast("int").alias("A_contact_pos"), (k % 5).cast("int").alias("A_base_pos"))


SQL_EVAL = """v_eval AS (
  SELECT o_orderkey AS sample_id, o_custkey AS grp, o_orderpriority AS method, o_totalprice / 1e5 AS pwm_mae,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 2e5 END AS pwm_kl,
    CASE WHEN o_orderkey % 14 = 3 THEN 'nan'::DOUBLE ELSE (o_orderkey % 101) / 101.0::DOUBLE END AS site_ap,
    (o_orderkey % 13)::INT AS A_contact_pos, (o_orderkey % 5)::INT AS A_base_pos
  FROM orders)"""
