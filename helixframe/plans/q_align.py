"""Queries that place motifs on sequences."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage
from helixframe.operators import align as A
from helixframe.operators import contacts as C
from helixframe.operators import predictions as P
from helixframe.operators import structure as S
from helixframe.operators.ordering import highest_of_runs
from helixframe.plans import views as V
from helixframe.plans.common import big, joined, r6, table, with_ctes


# ----------------------------------------------------------------- text samples
def _text(spark, sf, mode="ic_log_likelihood"):
    scoring = A.scoring_table(V.motifs(spark, sf), mode)
    return A.segment_text_chains(V.text_chains(spark, sf), scoring), scoring


def _cand(df):
    return df.select("sample_id", "chain", "reverse_complement", big("start").alias("start"), "aligned_sequence",
                     joined("slot_to_dna_index").alias("slots"))


def enumerate_full_windows(spark, sf):
    chains, scoring = _text(spark, sf)
    return _cand(A.enumerate_windows(chains, scoring, "full"))


def enumerate_partial_windows(spark, sf):
    chains, scoring = _text(spark, sf)
    return _cand(A.enumerate_windows(chains, scoring, "partial"))


def _scores(mode):
    def run(spark, sf):
        chains, scoring = _text(spark, sf, mode)
        scored = A.score_candidates(A.place(chains, scoring)).withColumnRenamed("raw", "score")
        return scored.groupBy("sample_id", "chain", "reverse_complement").agg(
            F.count("*").alias("n"), r6(F.max("score")).alias("best"), r6(F.min("score")).alias("worst"),
            r6(F.avg("score")).alias("mean"))
    return run


def align_sequence_only(spark, sf):
    chains, scoring = _text(spark, sf)
    return A.align_sequence_only(chains, scoring).select(
        "sample_id", "chain", big("start").alias("start"), "reverse_complement", r6("score").alias("score"),
        "aligned_sequence", joined("slot_to_dna_index").alias("slots"), "is_full")


# ------------------------------------------------------------ structure samples
def complex_samples(spark, sf):
    """Two motifs per vector, each on the structure its vector belongs to."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("structure_id"),
        F.explode(F.array(F.col("vec_id") * 2, F.col("vec_id") * 2 + 1)).alias("sample_id"),
    ).withColumn("motif_id", F.col("sample_id"))


class Complexes:
    """The tables every structure-based alignment needs.

    The residue index, the DNA positions and the sparse distances are written once
    (checkpoint) when first asked for: they are small beside the atoms and every later
    step reads them.
    """

    def __init__(self, spark, sf, mode="ic_log_likelihood", max_cutoff=5.0):
        self.at, self.mode, self.max_cutoff = (spark, sf), mode, max_cutoff
        self.slots = None
        self.samples = complex_samples(spark, sf)

    @cached_property
    def scoring(self):
        return cut_lineage(A.scoring_table(V.motifs(*self.at), self.mode))

    @cached_property
    def residues(self):
        return cut_lineage(S.index_kinds(S.residue_table(V.atoms(*self.at))))

    @cached_property
    def protein(self):
        return self.residues.where("kind = 'protein'")

    @cached_property
    def dna(self):
        return self.residues.where("kind = 'dna'")

    def of_slots(self, slots):
        """From now on distances and contacts are those of nucleotides that some slot has."""
        self.slots = slots
        return self

    @cached_property
    def positions(self):
        return cut_lineage(C.chain_positions(self.dna))

    @cached_property
    def chains(self):
        return cut_lineage(A.structure_chains(self.positions, A.wanted_classes(self.samples, self.scoring)))

    @cached_property
    def atoms(self):
        return S.tag_atoms(V.atoms(*self.at))

    @cached_property
    def distances(self):
        if self.slots is not None:
            used = self.slots.select("structure_id", F.col("dna_idx").alias("sel_idx")).distinct()
            return cut_lineage(C.residue_distances(self.atoms, self.protein, self.dna.join(used, ["structure_id", "sel_idx"], "left_semi"), self.max_cutoff))
        placed = self.dna.join(self.positions.select("structure_id", F.col("dna_idx").alias("sel_idx"), "pos"), ["structure_id", "sel_idx"])
        # Not written: candidates read their contacts once, as sums.
        return C.residue_distances(self.atoms, self.protein, placed, self.max_cutoff, of_dna=("chain", "pos"))

    @cached_property
    def contacts(self):
        return C.contact_labels(self.distances)

    @cached_property
    def missing(self):
        return C.missing_parts(self.atoms, self.dna).join(self.positions.drop("letter"), ["structure_id", "dna_idx"])

    def candidates(self, skip_bad=False):
        return A.contact_candidates(self.samples, self.chains, self.scoring, self.positions, self.contacts,
                                    self.missing, skip_bad)

    def aligned(self, skip_bad=False, **minimums):
        out = A.align_contact_constrained(self.candidates(skip_bad), self.chains, **minimums)
        if skip_bad:
            return out
        broken = A.bad_residue_error(self.samples, self.chains, self.scoring, self.missing.where("part = 'backbone'"))
        out = out.join(broken.withColumnRenamed("error", "atom_error"), "sample_id", "left")
        return out.withColumn("error", F.coalesce("atom_error", "error")).drop("atom_error")

    def sequence_rows(self):
        return A.sample_chains(self.samples, self.chains, self.scoring)


def _contact_out(df):
    ok = F.col("error").isNull()
    pick = lambda c: F.when(ok, c)
    return df.select(
        "sample_id", pick(F.col("chain")).alias("chain"), pick(big("start")).alias("start"),
        pick(F.col("reverse_complement")).alias("reverse_complement"), pick(r6("score")).alias("score"),
        pick(F.col("aligned_sequence")).alias("aligned_sequence"), pick(joined("slot_to_dna_index")).alias("slots"),
        big("candidate_count").alias("candidate_count"), big("contact_candidate_count").alias("contact_candidate_count"),
        *[pick(big(f"{p}_pos")).alias(f"{p}_pos") for p in ("base", "backbone", "contact", "site")], "error")


def align_contact_constrained(spark, sf):
    return _contact_out(Complexes(spark, sf).aligned(min_base=1, min_contact=4, min_site=2))


def skip_bad_candidates(spark, sf):
    return _contact_out(Complexes(spark, sf).aligned(skip_bad=True, min_base=1, min_contact=4, min_site=2))


def manual_inputs(spark, sf):
    """Manual lists and starts for some samples (assigned by key)."""
    from helixframe.operators.motif import motif_lengths

    m = motif_lengths(V.motifs(spark, sf)).withColumnRenamed("motif_id", "sample_id")
    k = F.col("sample_id")
    full = F.array_join(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: (i * 2 + k % 3).cast("string")), ", ")
    return m.select(
        "sample_id", "m",
        F.when(k % 7 == 0, full).when(k % 7 == 1, "0,1,2").when(k % 7 == 2, " ").alias("manual_index"),
        F.when(k % 5 == 0, (k % 4).cast("int")).alias("manual_start"))


def align_manual(spark, sf):
    return A.manual_slots(manual_inputs(spark, sf)).select(
        "sample_id", "alignment_mode", big("start").alias("start"), joined("slot_to_dna_index").alias("slots"), "error")


def _dna_counts(c):
    return c.dna.groupBy("structure_id").agg(F.count("*").alias("n_dna"))


def validate_slots(spark, sf):
    c = Complexes(spark, sf)
    man = A.manual_slots(manual_inputs(spark, sf)).where("alignment_mode IS NOT NULL AND error IS NULL")
    k = F.col("sample_id")
    slots = (F.when(k % 35 == 0, F.array().cast("array<bigint>"))
             .when(k % 14 == 7, F.transform("slot_to_dna_index", lambda x: F.lit(-1).cast("bigint")))
             .otherwise(F.transform("slot_to_dna_index", lambda x: x * 2)))
    placed = man.withColumn("slot_to_dna_index", slots).join(c.samples, "sample_id").join(_dna_counts(c), "structure_id")
    return A.validate_slots(placed).select("sample_id", joined("slot_to_dna_index").alias("slots"), "slot_error")


def _policies(spark, sf):
    c = Complexes(spark, sf)
    seq = A.metadata_sequence(A.align_sequence_only(c.sequence_rows(), c.scoring, c.chains), "ic_log_likelihood")
    con = A.metadata_contact(c.aligned(), "ic_log_likelihood")
    man = A.metadata_manual(A.manual_slots(manual_inputs(spark, sf)))
    return c, seq, con, man


def _meta_out(df):
    return df.select(
        "sample_id", joined("slot_to_dna_index").alias("slots"), "alignment_mode", "alignment_score_mode", "alignment_chain",
        "alignment_start", "alignment_reverse_complement", r6("alignment_score").alias("alignment_score"),
        "alignment_sequence", "alignment_candidate_count", "alignment_contact_candidate_count")


def alignment_policy(spark, sf):
    c, seq, con, man = _policies(spark, sf)
    policy = F.when(F.col("sample_id") % 3 == 0, "sequence_only").otherwise("require_contact")
    return _meta_out(A.alignment_policy(c.samples.select("sample_id", policy.alias("policy")), man, seq, con))


def alignment_metadata(spark, sf):
    c = Complexes(spark, sf, "ic_pcc")
    return _meta_out(A.metadata_contact(c.aligned(), "ic_pcc"))


def policy_compare(spark, sf):
    """Sequence-only and contact-constrained placements side by side."""
    _, seq, con, man = _policies(spark, sf)
    tagged = None
    for name, df in (("sequence_only", seq), ("require_contact", con), ("manual", man)):
        part = df.select("sample_id", F.lit(name).alias("policy"), joined("slot_to_dna_index").alias("slots"))
        tagged = part if tagged is None else tagged.unionByName(part)
    wide = tagged.groupBy("sample_id").pivot("policy", ["sequence_only", "require_contact", "manual"]).agg(F.max("slots"))
    return wide.withColumn("same", F.col("sequence_only").eqNullSafe(F.col("require_contact")))


#: Shares of a structure's slots that meet copies of its residues.
PARTS = 32


def top_pair_distances(spark, sf):
    """The best pairs by a score made of their numbers, with their true distances."""
    c = Complexes(spark, sf)
    placed = c.aligned().where("error IS NULL").select("sample_id", "structure_id", "slot_to_dna_index")
    slots = cut_lineage(C.slot_rows(placed))
    # A row for each residue of a sample's structure and slot: made in some tasks for one structure, cut before they are sorted.
    residues = c.protein.select("structure_id", F.col("sel_idx").alias("res_idx"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    cells = slots.withColumn("part", F.pmod(F.hash("sample_id", "slot"), F.lit(PARTS))).join(residues, ["structure_id", "part"])
    score = (F.col("res_idx") * 37 + F.col("slot") * 11 + F.col("sample_id") * 7) % 101
    top = P.top_contact_pairs(highest_of_runs(cells.select("sample_id", "res_idx", "slot", score.alias("score")), ["sample_id"], "score", 5), "score")
    out = P.pair_distances(top, slots, c.protein, c.dna, V.atoms(spark, sf))
    return out.select("sample_id", *[big(x).alias(x) for x in ("res_idx", "slot", "score")], *[r6(x).alias(x) for x in ("base_dist", "backbone_dist")])


QUERIES = {
    "top_pair_distances": top_pair_distances, "enumerate_full_windows": enumerate_full_windows, "enumerate_partial_windows": enumerate_partial_windows,
    "score_log_likelihood": _scores("log_likelihood"), "score_ic_log_likelihood": _scores("ic_log_likelihood"),
    "score_ic_pcc": _scores("ic_pcc"), "align_sequence_only": align_sequence_only,
    "align_contact_constrained": align_contact_constrained, "skip_bad_candidates": skip_bad_candidates,
    "align_manual": align_manual, "validate_slots": validate_slots, "alignment_policy": alignment_policy,
    "alignment_metadata": alignment_metadata, "policy_compare": policy_compare,
}

# ---------------------------------------------------------------------- oracles
_P = "(CASE b WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END)"
_SCORES = {
    "log_likelihood": f"avg(ln({_P} + 1e-8))",
    "ic_log_likelihood": f"sum(ic * ln({_P} + 1e-8)) / sum(ic)",
    "ic_pcc": f"avg(ic * ({_P} - (a+c+g+t)/4) / sqrt(0.75 * ((a-(a+c+g+t)/4)**2 + (c-(a+c+g+t)/4)**2 + (g-(a+c+g+t)/4)**2 + (t-(a+c+g+t)/4)**2)))",
}
_MIC = """v_mic AS (SELECT *, 2 + a*log2(a) + c*log2(c) + g*log2(g) + t*log2(t) AS ic FROM v_motif),
v_mlen AS (SELECT motif_id, max(pos) + 1 AS m FROM v_motif GROUP BY ALL)"""
TEXT = [V.SQL_PWM, V.SQL_MOTIF, V.SQL_CHAIN, _MIC,
        "ch AS (SELECT sample_id, chain_ord, chain, sequence, motif_id, off, NULL::BIGINT[] AS idxs FROM v_chain)"]
_DCH = """v_dpos AS (SELECT *, substr(resname, 2, 1) AS letter, row_number() OVER (PARTITION BY structure_id, chain ORDER BY kind_idx) - 1 AS pos FROM v_dna),
v_dch AS (SELECT structure_id, chain, min(kind_idx) AS chain_ord, string_agg(letter, '' ORDER BY pos) AS sequence,
    list(kind_idx ORDER BY pos) AS idxs FROM v_dpos GROUP BY structure_id, chain),
v_samp AS (SELECT 's' || label AS structure_id, unnest([vec_id*2, vec_id*2+1]) AS sample_id FROM embeddings),
ch AS (SELECT sample_id, chain_ord, chain, sequence, sample_id AS motif_id, 0::BIGINT AS off, idxs, structure_id
    FROM v_samp JOIN v_dch USING (structure_id))"""
STRUCT = [V.SQL_PWM, V.SQL_MOTIF, V.SQL_ATOMS, V.SQL_RESIDUES, _MIC, _DCH]


def cand_ctes(gate: bool = True, extra: str = "") -> str:
    """Candidate rows ``cs`` from ``ch``; with the full-before-partial gate."""
    cond = "WHERE (length(sequence) >= m) = any_full" if gate else ""
    return f"""gate AS (SELECT sample_id, bool_or(length(sequence) >= m) AS any_full FROM ch JOIN v_mlen USING (motif_id) GROUP BY ALL),
c0 AS (SELECT ch.*, length(sequence) AS l, m, length(sequence) >= m AS is_full, unnest([false, true]) AS rev
    FROM ch JOIN v_mlen USING (motif_id) JOIN gate USING (sample_id) {cond}),
c1 AS (SELECT *, CASE WHEN rev THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS oseq, unnest(range(abs(l - m) + 1)) AS start FROM c0),
cs AS (SELECT *, CASE WHEN is_full THEN substr(oseq, start + 1, m) ELSE repeat('-', start) || oseq || repeat('-', m - l - start) END AS aligned FROM c1)"""


def score_ctes(mode: str) -> str:
    return f"""sl AS (SELECT sample_id, motif_id, chain_ord, rev, start, k AS pos, substr(aligned, k + 1, 1) AS b
    FROM (SELECT *, unnest(range(m)) AS k FROM cs) WHERE substr(aligned, k + 1, 1) <> '-'),
sc AS (SELECT sample_id, chain_ord, rev, start, {_SCORES[mode]} AS score FROM sl JOIN v_mic USING (motif_id, pos)
    GROUP BY sample_id, chain_ord, rev, start),
csc AS (SELECT cs.*, sc.score FROM cs JOIN sc USING (sample_id, chain_ord, rev, start))"""


_FWD = "(CASE WHEN is_full THEN (CASE WHEN rev THEN l - 1 - (start + k) ELSE start + k END) ELSE (CASE WHEN rev THEN l - 1 - (k - start) ELSE k - start END) END)"
_VIS = "(is_full OR (k >= start AND k < start + l))"
_IDX = f"(CASE WHEN NOT {_VIS} THEN -1 WHEN idxs IS NULL THEN off + {_FWD} ELSE idxs[{_FWD} + 1] END)"
_SLOTS = f"array_to_string(list_transform(range(m), lambda k: {_IDX}), ',')"
_SCSQL = """SELECT sample_id, chain, rev AS reverse_complement, count(*) AS n, round(max(score), 6) AS best,
    round(min(score), 6) AS worst, round(avg(score), 6) AS mean FROM csc GROUP BY ALL"""
_SEQBEST = """sb AS (SELECT * FROM csc QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chain_ord, rev, start) = 1)"""

_CONTACT = f"""v_ct AS (SELECT structure_id, res_idx, dna_idx, coalesce(base_dist <= 4.5, false)::INT AS bl, coalesce(backbone_dist <= 5.0, false)::INT AS kl FROM v_mind
    WHERE coalesce(base_dist <= 4.5, false) OR coalesce(backbone_dist <= 5.0, false)),
cslot AS (SELECT sample_id, structure_id, chain_ord, rev, start, k, {_IDX} AS dna_idx FROM (SELECT *, unnest(range(m)) AS k FROM cs)),
ccnt AS (SELECT sample_id, chain_ord, rev, start, sum(bl)::BIGINT AS base_pos, sum(kl)::BIGINT AS backbone_pos,
    count(*) AS contact_pos, count(DISTINCT res_idx) AS site_pos
    FROM cslot JOIN v_ct USING (structure_id, dna_idx) GROUP BY ALL),
v_part AS (SELECT d.structure_id, d.kind_idx AS dna_idx, d.chain, d.resseq, d.icode,
    count_if(h.is_base) AS nb, count_if(NOT h.is_base) AS nk FROM v_dna d LEFT JOIN v_heavy h USING (structure_id, chain, resseq, icode, resname) GROUP BY ALL),
cbad AS (SELECT sample_id, chain_ord, rev, start, k, chain || ':' || resseq || icode AS rid, nb, nk
    FROM cslot JOIN v_part USING (structure_id, dna_idx) WHERE nb = 0 OR nk = 0)"""


def contact_tail(base: int, contact: int, site: int, skip: bool) -> str:
    drop = "WHERE NOT EXISTS (SELECT 1 FROM cbad b WHERE b.sample_id = csc.sample_id AND b.chain_ord = csc.chain_ord AND b.rev = csc.rev AND b.start = csc.start)" if skip else ""
    broken = "SELECT NULL::BIGINT AS sample_id, NULL::VARCHAR AS atom_error WHERE false" if skip else \
        "SELECT sample_id, 'DNA residue ' || arg_min(rid, (chain_ord, rev, start, k)) || ' has no backbone heavy atoms.' AS atom_error FROM cbad WHERE nk = 0 GROUP BY sample_id"
    return f"""cc AS (SELECT csc.*, coalesce(base_pos, 0) AS base_pos, coalesce(backbone_pos, 0) AS backbone_pos,
    coalesce(contact_pos, 0) AS contact_pos, coalesce(site_pos, 0) AS site_pos,
    coalesce(base_pos, 0) >= {base} AND coalesce(contact_pos, 0) >= {contact} AND coalesce(site_pos, 0) >= {site} AS ok
    FROM csc LEFT JOIN ccnt USING (sample_id, chain_ord, rev, start) {drop}),
cn AS (SELECT sample_id, count(*) AS candidate_count, count_if(ok)::BIGINT AS contact_candidate_count FROM cc GROUP BY ALL),
bo AS (SELECT * FROM cc WHERE ok QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chain_ord, rev, start) = 1),
bs AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chain_ord, rev, start) = 1),
br AS ({broken}),
al AS (SELECT cn.*, bo.* EXCLUDE (sample_id), coalesce(atom_error, CASE WHEN contact_candidate_count = 0 THEN
    format('No PWM-DNA alignment candidate passed contact constraints. candidate_count={{}} min_contact_pairs={contact} min_site_residues={site} min_base_pairs={base} best_sequence_only=chain:{{}} start:{{}} rc:{{}} score:{{:.6f}}',
      candidate_count, bs.chain, bs.start, CASE WHEN bs.rev THEN 'True' ELSE 'False' END, bs.score) END) AS error
    FROM cn LEFT JOIN bo USING (sample_id) JOIN bs USING (sample_id) LEFT JOIN br USING (sample_id))"""


_OKV = "CASE WHEN error IS NULL THEN {} END"
_COUT = ("SELECT sample_id, " + ", ".join(f"{_OKV.format(e)} AS {n}" for e, n in [
    ("chain", "chain"), ("start", "start"), ("rev", "reverse_complement"), ("round(score, 6)", "score"), ("aligned", "aligned_sequence"),
    (_SLOTS, "slots"), ("base_pos", "base_pos"), ("backbone_pos", "backbone_pos"), ("contact_pos", "contact_pos"), ("site_pos", "site_pos")])
    + ", candidate_count, contact_candidate_count, error FROM al")
GEOM = [*STRUCT, V.SQL_MINDIST, cand_ctes(), score_ctes("ic_log_likelihood"), _CONTACT]

MANUAL = """mi AS (SELECT motif_id AS sample_id, m,
    CASE sample_id % 7 WHEN 0 THEN array_to_string(list_transform(range(m), lambda i: i*2 + motif_id % 3), ', ') WHEN 1 THEN '0,1,2' WHEN 2 THEN ' ' END AS manual_index,
    CASE WHEN sample_id % 5 = 0 THEN sample_id % 4 END AS manual_start FROM (SELECT motif_id, max(pos) + 1 AS m, motif_id AS sample_id FROM v_motif GROUP BY ALL)),
man AS (SELECT sample_id, m,
    CASE WHEN trim(coalesce(manual_index, '')) <> '' THEN 'manual_slot_to_dna_index' WHEN manual_start IS NOT NULL THEN 'manual_dna_start_index' END AS alignment_mode,
    CASE WHEN trim(coalesce(manual_index, '')) <> '' THEN -1 ELSE manual_start END AS start,
    CASE WHEN trim(coalesce(manual_index, '')) <> '' THEN list_transform(string_split(manual_index, ','), lambda x: trim(x)::BIGINT)
         WHEN manual_start IS NOT NULL THEN range(manual_start, manual_start + m) END AS slots,
    CASE WHEN trim(coalesce(manual_index, '')) <> '' AND len(string_split(manual_index, ',')) <> m
         THEN '--slot-to-dna-index length ' || len(string_split(manual_index, ',')) || ' != PWM length ' || m || '.' END AS error FROM mi)"""
_METAMAN = """SELECT sample_id, array_to_string(slots, ',') AS slots, alignment_mode, 'manual' AS alignment_score_mode, '' AS alignment_chain,
    start::BIGINT AS alignment_start, false AS alignment_reverse_complement, NULL::DOUBLE AS alignment_score, '' AS alignment_sequence,
    0::BIGINT AS alignment_candidate_count, 0::BIGINT AS alignment_contact_candidate_count
    FROM (SELECT * REPLACE (CASE WHEN error IS NULL THEN slots END AS slots) FROM man) WHERE alignment_mode IS NOT NULL"""
_METASEQ = f"""SELECT sample_id, {_SLOTS} AS slots, CASE WHEN is_full THEN 'auto_pwm_dna' ELSE 'partial_auto_pwm_dna' END AS alignment_mode,
    'ic_log_likelihood' AS alignment_score_mode, chain AS alignment_chain, start AS alignment_start, rev AS alignment_reverse_complement,
    round(score, 6) AS alignment_score, aligned AS alignment_sequence, 0::BIGINT AS alignment_candidate_count, 0::BIGINT AS alignment_contact_candidate_count FROM sb"""
_METACON = f"""SELECT sample_id, {_SLOTS} AS slots, CASE WHEN is_full THEN 'contact_constrained_pwm_dna' ELSE 'partial_contact_constrained_pwm_dna' END AS alignment_mode,
    '@MODE@' AS alignment_score_mode, chain AS alignment_chain, start AS alignment_start, rev AS alignment_reverse_complement,
    round(score, 6) AS alignment_score, aligned AS alignment_sequence, candidate_count AS alignment_candidate_count,
    contact_candidate_count AS alignment_contact_candidate_count FROM al WHERE error IS NULL"""
_POL = [*GEOM, contact_tail(0, 1, 1, False), _SEQBEST, MANUAL, f"mm AS ({_METAMAN})", f"ms AS ({_METASEQ})",
        f"mc AS ({_METACON.replace('@MODE@', 'ic_log_likelihood')})"]

ORACLES = {
    "top_pair_distances": with_ctes([*GEOM, contact_tail(0, 1, 1, False), f"""ts AS (SELECT sample_id, structure_id, unnest(list_transform(range(m), lambda k: {_IDX})) AS dna_idx, unnest(range(m)) AS slot FROM al WHERE error IS NULL),
tp AS (SELECT sample_id, structure_id, kind_idx AS res_idx, slot, dna_idx, (kind_idx * 37 + slot * 11 + sample_id * 7) % 101 AS score FROM ts JOIN v_prot USING (structure_id)
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY (kind_idx * 37 + slot * 11 + sample_id * 7) % 101 DESC, kind_idx, slot) <= 5)"""],
        "SELECT sample_id, res_idx::BIGINT AS res_idx, slot::BIGINT AS slot, score::BIGINT AS score, round(base_dist, 6) AS base_dist, round(backbone_dist, 6) AS backbone_dist FROM tp LEFT JOIN v_mind USING (structure_id, res_idx, dna_idx)"),
    "enumerate_full_windows": with_ctes([*TEXT, cand_ctes(False)], f"SELECT sample_id, chain, rev AS reverse_complement, start, aligned AS aligned_sequence, {_SLOTS} AS slots FROM cs WHERE is_full"),
    "enumerate_partial_windows": with_ctes([*TEXT, cand_ctes(False)], f"SELECT sample_id, chain, rev AS reverse_complement, start, aligned AS aligned_sequence, {_SLOTS} AS slots FROM cs WHERE NOT is_full"),
    **{f"score_{m}": with_ctes([*TEXT, cand_ctes(False), score_ctes(m)], _SCSQL) for m in _SCORES},
    "align_sequence_only": with_ctes([*TEXT, cand_ctes(), score_ctes("ic_log_likelihood"), _SEQBEST],
        f"SELECT sample_id, chain, start, rev AS reverse_complement, round(score, 6) AS score, aligned AS aligned_sequence, {_SLOTS} AS slots, is_full FROM sb"),
    "align_contact_constrained": with_ctes([*GEOM, contact_tail(1, 4, 2, False)], _COUT),
    "skip_bad_candidates": with_ctes([*GEOM, contact_tail(1, 4, 2, True)], _COUT),
    "align_manual": with_ctes([V.SQL_PWM, V.SQL_MOTIF, MANUAL], "SELECT sample_id, alignment_mode, start::BIGINT AS start, array_to_string(slots, ',') AS slots, error FROM man"),
    "validate_slots": with_ctes([*STRUCT, MANUAL], """SELECT sample_id, coalesce(array_to_string(s, ','), '') AS slots,
        CASE WHEN len(s) = 0 THEN 'slot_to_dna_index is empty.' WHEN list_max(s) < 0 THEN 'slot_to_dna_index has no visible DNA residues.'
             WHEN list_max(s) >= n_dna THEN 'slot_to_dna_index out of range for selected DNA residues: 0..' || (n_dna - 1) || '.' END AS slot_error
        FROM (SELECT sample_id, structure_id, CASE WHEN sample_id % 35 = 0 THEN []::BIGINT[] WHEN sample_id % 14 = 7 THEN list_transform(slots, lambda x: -1::BIGINT)
                ELSE list_transform(slots, lambda x: x * 2) END AS s FROM man JOIN v_samp USING (sample_id) WHERE alignment_mode IS NOT NULL AND error IS NULL)
        JOIN (SELECT structure_id, count(*) AS n_dna FROM v_dna GROUP BY ALL) USING (structure_id)"""),
    "alignment_policy": with_ctes(_POL, """SELECT * FROM mm UNION ALL
        SELECT * FROM ms WHERE sample_id % 3 = 0 AND sample_id NOT IN (SELECT sample_id FROM mm) UNION ALL
        SELECT * FROM mc WHERE sample_id % 3 <> 0 AND sample_id NOT IN (SELECT sample_id FROM mm)"""),
    "alignment_metadata": with_ctes([*STRUCT, V.SQL_MINDIST, cand_ctes(), score_ctes("ic_pcc"), _CONTACT, contact_tail(0, 1, 1, False)], _METACON.replace("@MODE@", "ic_pcc")),
    "policy_compare": with_ctes(_POL, """SELECT sample_id, ms.slots AS sequence_only, mc.slots AS require_contact, mm.slots AS manual,
        ms.slots IS NOT DISTINCT FROM mc.slots AS same FROM ms FULL JOIN mc USING (sample_id) FULL JOIN mm USING (sample_id)"""),
}
