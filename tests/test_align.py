import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import align as A
from helixframe.operators import contacts as C
from helixframe.operators import structure as S
from tests.builders import consensus_matrix, first, motif_rows, text_chain, toy_complex

LOW_IC = [[0.30, 0.20, 0.20, 0.30], [0.97, 0.01, 0.01, 0.01], [0.30, 0.20, 0.20, 0.30]]


def align(spark, matrix, *sequences, mode="ic_log_likelihood", **kw):
    chains = A.segment_text_chains(text_chain(spark, sequences), **{"halo": len(matrix) - 1} | kw)
    return first(A.align_sequence_only(chains, A.scoring_table(motif_rows(spark, 1, matrix), mode)))


def test_forward(spark):
    r = align(spark, consensus_matrix("ACG"), "TTACGAA")
    assert (r.chain, r.start, r.reverse_complement, r.aligned_sequence) == ("C0", 2, False, "ACG")
    assert r.slot_to_dna_index == [2, 3, 4]


def test_reverse_complement(spark):
    r = align(spark, consensus_matrix("ACG"), "TTCGTAA")
    assert r.reverse_complement and r.aligned_sequence == "ACG" and r.slot_to_dna_index == [4, 3, 2]


def test_information_weights_lead(spark):
    r = align(spark, LOW_IC, "TTATG")
    assert r.aligned_sequence == "TAT" and r.slot_to_dna_index == [1, 2, 3]


def test_partial_placement(spark):
    r = align(spark, consensus_matrix("TTACGAA"), "ACG")
    assert (r.start, r.aligned_sequence, r.is_full) == (2, "--ACG--", False)
    assert r.slot_to_dna_index == [-1, -1, 0, 1, 2, -1, -1]


def test_partial_only_when_no_chain_fits(spark):
    r = align(spark, consensus_matrix("TTACGAA"), "ACG", "CCCCCCCC")
    assert r.is_full and r.chain == "C1"


def test_ties_take_first_chain_then_forward(spark):
    r = align(spark, consensus_matrix("AATT"), "GGAATTGG", "GGAATTGG")
    assert (r.chain, r.reverse_complement, r.start) == ("C0", False, 2)


def brute(matrix, sequences, mode):
    """Best score by plain enumeration."""
    comp = str.maketrans("ACGT", "TGCA")
    rows = [[max(v, 1e-8) for v in r] for r in matrix]
    rows = [[v / sum(r) for v in r] for r in rows]
    ic = [2 + sum(v * math.log2(v) for v in r) for r in rows]
    def score(window):
        lp = [math.log(r["ACGT".index(b)] + 1e-8) for r, b in zip(rows, window)]
        if mode == "log_likelihood":
            return sum(lp) / len(lp)
        if mode == "ic_log_likelihood":
            return sum(w * x for w, x in zip(ic, lp)) / sum(ic) if sum(ic) > 1e-8 else sum(lp) / len(lp)
        total = 0.0
        for r, w, b in zip(rows, ic, window):
            y = [v - sum(r) / 4 for v in r]
            x = [(1.0 if k == b else 0.0) - 0.25 for k in "ACGT"]
            den = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
            total += w * sum(i * j for i, j in zip(x, y)) / den if den > 1e-8 else 0.0
        return total / len(window)
    m, best = len(matrix), None
    for c, seq in enumerate(sequences):
        for rc in (False, True):
            s = seq.translate(comp)[::-1] if rc else seq
            for start in range(len(s) - m + 1):
                v = score(s[start:start + m])
                if best is None or round(v, 9) > round(best[0], 9):
                    best = (v, c, rc, start)
    return best


@pytest.mark.parametrize("mode", A.SCORE_MODES)
def test_segments_agree_with_brute_force(spark, mode):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (57, 4, 131)]
    matrix = [[rng.random() for _ in "ACGT"] for _ in range(7)]
    want = brute(matrix, seqs, mode)
    norm = [[v / sum(r) for v in r] for r in matrix]
    for segment in (10, 16384):
        r = align(spark, norm, *seqs, mode=mode, segment=segment)
        assert (r.chain, r.reverse_complement, r.start) == (f"C{want[1]}", want[2], want[3])
        assert r.score == pytest.approx(want[0], abs=1e-9)


def test_flat_motif_falls_back_to_plain_mean(spark):
    r = align(spark, [[0.25] * 4] * 3, "ACGTA")
    assert r.score == pytest.approx(math.log(0.25 + 1e-8)) and (r.start, r.reverse_complement) == (0, False)


def complex_tables(spark, sequence, contacted, motif, drop=()):
    atoms = toy_complex(spark, sequence, contacted, drop)
    res = S.index_kinds(S.residue_table(atoms))
    protein, dna = res.where("kind = 'protein'"), res.where("kind = 'dna'")
    pos = C.chain_positions(dna)
    tagged = S.tag_atoms(atoms)
    samples = spark.createDataFrame([(1, "s", 1)], "sample_id long, structure_id string, motif_id long")
    scoring = A.scoring_table(motif_rows(spark, 1, consensus_matrix(motif)))
    chains = A.structure_chains(pos, A.needed_halo(scoring))
    contacts = C.contact_labels(C.residue_distances(tagged, protein, dna))
    missing = C.missing_parts(tagged, dna).join(pos.drop("letter"), ["structure_id", "dna_idx"])
    return samples, chains, scoring, pos, contacts, missing, protein


def test_contact_overrides_sequence(spark):
    samples, chains, scoring, pos, contacts, *_ = complex_tables(spark, "AAATTTAAA", 6, "AAA")
    r = first(A.align_contact_constrained(A.contact_candidates(samples, chains, scoring, pos, contacts), chains))
    assert (r.start, r.reverse_complement, r.is_full) == (6, False, True)
    assert r.slot_to_dna_index == [6, 7, 8]
    assert r.candidate_count > r.contact_candidate_count >= 1 and r.error is None


def test_no_contact_gives_reason(spark):
    samples, chains, scoring, pos, contacts, *_ = complex_tables(spark, "AAATTTAAA", 99, "AAA")
    r = first(A.align_contact_constrained(A.contact_candidates(samples, chains, scoring, pos, contacts), chains))
    assert r.error.startswith("No PWM-DNA alignment candidate passed contact constraints. candidate_count=14 ")
    assert "best_sequence_only=chain:B start:0 rc:False" in r.error


def test_missing_backbone_fails_or_is_skipped(spark):
    samples, chains, scoring, pos, contacts, missing, _ = complex_tables(spark, "AAATTTAAA", 6, "AAA", drop=[(7, "P")])
    err = first(A.bad_residue_error(samples, chains, scoring, missing.where("part = 'backbone'")))
    assert err.error == "DNA residue B:8 has no backbone heavy atoms."
    cands = A.contact_candidates(samples, chains, scoring, pos, contacts, missing, skip_bad=True)
    r = first(A.align_contact_constrained(cands, chains))
    assert r.slot_to_dna_index is not None and 7 not in r.slot_to_dna_index and r.error is None


def labels_of(spark, sequence, contacted, slots, drop=()):
    samples, chains, scoring, pos, contacts, missing, protein = complex_tables(spark, sequence, contacted, "A", drop)
    placed = spark.createDataFrame([(1, "s", slots)], "sample_id long, structure_id string, slot_to_dna_index array<int>")
    rows = C.dense_labels(C.slot_rows(placed), protein, contacts, missing).orderBy("slot").collect()
    stored = {r.slot: r for r in C.slot_labels(C.slot_rows(placed), contacts, missing).collect()}
    assert len(stored) == len({r.slot for r in rows})
    for r in rows:
        assert (r.pwm_mask, r.base_mask) == (stored[r.slot].pwm_mask, stored[r.slot].base_mask)
        assert (r.base_label, r.backbone_label) == (int(r.res_idx in stored[r.slot].base_res), int(r.res_idx in stored[r.slot].backbone_res))
    return rows


def test_missing_base_is_unknown(spark):
    (r,) = labels_of(spark, "A", 0, [0], drop=[(0, "N1")])
    assert (r.base_label, r.base_mask, r.pwm_mask) == (0, 0, 1)


def test_unseen_slots_are_masked(spark):
    rows = labels_of(spark, "A", 0, [-1, 0, -1])
    assert [r.pwm_mask for r in rows] == [0, 1, 0]
    assert [r.base_mask for r in rows] == [0, 1, 0]
    assert [r.base_label for r in rows] == [0, 1, 0]
    assert [r.backbone_label for r in rows] == [0, 0, 0]


def test_structure_segments_match_whole_chain(spark):
    samples, _, scoring, pos, contacts, *_ = complex_tables(spark, "ACGTTGCAACGTAAGT", 9, "ACGT")
    got = []
    for seg in (3, 16384):
        chains = A.structure_chains(pos, segment=seg, halo=8)
        r = first(A.align_contact_constrained(A.contact_candidates(samples, chains, scoring, pos, contacts), chains))
        got.append((r.start, r.reverse_complement, round(r.score, 9), r.slot_to_dna_index, r.candidate_count, r.contact_candidate_count))
    assert got[0] == got[1]


def test_manual_and_slot_checks(spark):
    df = spark.createDataFrame([(1, 3, "2, 1,0", None), (2, 3, "1,2", None), (3, 3, "", 4), (4, 3, None, None)],
                               "sample_id long, m int, manual_index string, manual_start int")
    rows = {r.sample_id: r for r in A.manual_slots(df).collect()}
    assert rows[1].slot_to_dna_index == [2, 1, 0] and rows[1].start == -1
    assert rows[2].error == "--slot-to-dna-index length 2 != PWM length 3."
    assert rows[3].slot_to_dna_index == [4, 5, 6] and rows[3].alignment_mode == "manual_dna_start_index"
    assert rows[4].alignment_mode is None
    placed = spark.createDataFrame([(1, [], 3), (2, [-1, -1], 3), (3, [0, 3], 3), (4, [-1, 2], 3)],
                                   "sample_id long, slot_to_dna_index array<long>, n_dna long")
    errs = [r.slot_error for r in A.validate_slots(placed).orderBy("sample_id").collect()]
    assert errs == ["slot_to_dna_index is empty.", "slot_to_dna_index has no visible DNA residues.",
                    "slot_to_dna_index out of range for selected DNA residues: 0..2.", None]


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        A.scoring_table(motif_rows(spark, 1, LOW_IC), "other")


def test_candidate_count_formula(spark):
    chains = A.segment_text_chains(text_chain(spark, ["ACGTACGT", "AC"]), halo=2, segment=3)
    scoring = A.scoring_table(motif_rows(spark, 1, consensus_matrix("ACG")))
    full = A.enumerate_windows(chains, scoring, "full").collect()
    part = A.enumerate_windows(chains, scoring, "partial").collect()
    assert sorted((r.reverse_complement, r.start) for r in full) == sorted(itertools.product((False, True), range(6)))
    assert len(part) == 4


def test_long_motif_on_long_and_short_chains(spark):
    """A motif longer than any segment, beside a short one; both as one segment would give them."""
    rng = random.Random(1)
    letters = "".join(rng.choice("ACGT") for _ in range(5600))
    long, short = letters[300:5300], letters[2000:2012]
    motifs = motif_rows(spark, 1, consensus_matrix(long)).unionByName(motif_rows(spark, 2, consensus_matrix(short)))
    scoring = A.scoring_table(motifs)
    rows = [(s, 0, "A", text, 0, m) for s, text, m in ((1, letters, 1), (2, letters[:90], 1), (3, letters, 2), (4, letters[300:3000], 1))]
    chains = spark.createDataFrame(rows, "sample_id long, chain_ord int, chain string, sequence string, offset int, motif_id long")
    got = []
    for segment in (A.SEGMENT, 1 << 20):
        best = A.align_sequence_only(A.segment_text_chains(chains, A.needed_halo(scoring), segment), scoring).collect()
        got.append({r.sample_id: (r.is_full, r.start, r.reverse_complement, r.aligned_sequence) for r in best})
    assert got[0] == got[1]
    assert got[0][1][:3] == (True, 300, False) and got[0][3][:3] == (True, 2000, False) and not got[0][2][0]
    assert got[0][4][:2] == (False, 0) and got[0][4][3].startswith(letters[300:3000])


def test_counts_are_normalised_before_scoring(spark):
    counts = [[30, 10, 5, 5], [1, 97, 1, 1], [2, 2, 2, 94]]
    shares = [[x / sum(row) for x in row] for row in counts]
    assert align(spark, counts, "TTACTGA", mode="log_likelihood").score == pytest.approx(align(spark, shares, "TTACTGA", mode="log_likelihood").score)


def test_faulty_manual_placement_is_not_replaced(spark):
    df = spark.createDataFrame([(1, 3, "1,2", None), (2, 3, "0,1,2", None)], "sample_id long, m int, manual_index string, manual_start int")
    manual = A.manual_slots(df)
    auto = A.metadata_manual(manual.withColumn("error", F.lit(None).cast("string"))).withColumn("alignment_mode", F.lit("auto"))
    samples = df.select("sample_id", F.lit("sequence_only").alias("policy"))
    out = {r.sample_id: r for r in A.alignment_policy(samples, A.metadata_manual(manual), auto, auto).collect()}
    assert len(out) == 2 and out[1].slot_to_dna_index is None and out[2].slot_to_dna_index == [0, 1, 2]
    assert [r.sample_id for r in A.manual_errors(manual).collect()] == [1]


def test_a_long_motif_leaves_the_segments_of_others_alone(spark):
    """One motif of 50,000 rows beside short ones: only the rows of its own class grow, letters are copied once at most."""
    short = motif_rows(spark, 1, consensus_matrix("ACGTAC")).unionByName(motif_rows(spark, 2, consensus_matrix("ACGTACGTACG")))
    long = spark.range(50_000).select(F.lit(9).cast("long").alias("motif_id"), F.col("id").cast("int").alias("pos"), *[F.lit(0.25).alias(b) for b in "acgt"])
    chain = "ACGTTGCATC" * 3000
    letters = spark.range(len(chain)).select(F.lit("s").alias("structure_id"), F.lit("B").alias("chain"), F.col("id").cast("int").alias("pos"),
                                             F.expr(f"substring('{chain[:10]}', cast(id % 10 as int) + 1, 1)").alias("letter"), F.col("id").cast("int").alias("dna_idx"))
    samples = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "s", 9)], "sample_id long, structure_id string, motif_id long")
    sizes = {}
    for name, motifs in (("short", short), ("both", short.unionByName(long))):
        scoring = A.scoring_table(motifs)
        rows = A.structure_chains(letters, A.wanted_classes(samples, scoring)).select("cls", "seg_start", F.length("sequence").alias("n")).collect()
        sizes[name] = {c: sorted((r.seg_start, r.n) for r in rows if r.cls == c) for c in {r.cls for r in rows}}
    assert set(sizes["short"]) == {3, 4} and set(sizes["both"]) == {3, 4, 16} and all(sizes["both"][c] == sizes["short"][c] for c in (3, 4))
    assert max(n for _, n in sizes["both"][4]) == A.SEGMENT + 15 and all(sum(n for _, n in x) <= 2 * len(chain) for x in sizes["both"].values())
    text = text_chain(spark, [chain], 1).unionByName(text_chain(spark, [chain], 9, 2))
    cut = A.segment_text_chains(text, A.scoring_table(short.unionByName(long))).select("motif_id", F.length("sequence").alias("n")).collect()
    assert max(r.n for r in cut if r.motif_id == 1) == A.SEGMENT + 5 and sum(r.n for r in cut) < 3 * len(chain)


def test_classes_place_as_one_halo_does(spark):
    """Placements of motifs of several classes on structures are those of chains cut with one halo for all."""
    rng = random.Random(5)
    motifs = None
    for i, n in enumerate((1, 2, 3, 8, 9, 30)):
        one = motif_rows(spark, i, [[rng.random() + 0.05 for _ in range(4)] for _ in range(n)])
        motifs = one if motifs is None else motifs.unionByName(one)
    scoring = A.scoring_table(motifs)
    letters = [("s", c, p, rng.choice("ACGT"), i) for i, (c, p) in enumerate([("B", p) for p in range(70)] + [("C", p) for p in range(20)])]
    pos = spark.createDataFrame(letters, "structure_id string, chain string, pos int, letter string, dna_idx int")
    samples = spark.createDataFrame([(i, "s", i) for i in range(6)], "sample_id long, structure_id string, motif_id long")
    contacts = spark.createDataFrame([("s", 0, 33, 1, 0), ("s", 1, 75, 1, 1)], "structure_id string, res_idx int, dna_idx int, base_label int, backbone_label int")
    got = []
    for chains in (A.structure_chains(pos, A.wanted_classes(samples, scoring), 16), A.structure_chains(pos, A.needed_halo(scoring), 16)):
        found = A.align_contact_constrained(A.contact_candidates(samples, chains, scoring, pos, contacts), chains)
        best = A.align_sequence_only(A.sample_chains(samples, chains, scoring), scoring)
        got.append([sorted((r.sample_id, list(r.slot_to_dna_index), r.chain, r.start) for r in df.collect()) for df in (found, best)])
    assert got[0] == got[1] and len(got[0][0]) == len(got[0][1]) == 6
