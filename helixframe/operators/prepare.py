"""Batch preparation: from manifest rows to sample and failure tables.

A faulty sample becomes a row with a reason; it never stops the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage
from helixframe.functions.constants import FAILURE_RULES, MANIFEST_COLUMNS
from helixframe.functions.pwm import ACGT
from helixframe.operators import align as A
from helixframe.operators import contacts as C
from helixframe.operators import geometry as G
from helixframe.operators import manifest as N
from helixframe.operators import structure as S
from helixframe.operators.motif import normalize_pwm
from helixframe.operators.ordering import first_per_key
from helixframe.sources import store

COUNTS = ["A_base_pos", "A_backbone_pos", "A_contact_pos", "site_pos"]


def counts_text() -> Column:
    return F.format_string(
        "A_base_pos=%d A_backbone_pos=%d A_contact_pos=%d site_pos=%d", *[F.col(c) for c in COUNTS])


def route_status(results: DataFrame, min_base: int = 0, min_contact: int = 1, min_site: int = 1) -> DataFrame:
    """``status`` ok / skip / fail and ``reason`` from ``error`` and the counts."""
    ok = C.passes(min_base, min_contact, min_site)
    return results.withColumn(
        "status", F.when(F.col("error").isNotNull(), "fail").when(ok, "ok").otherwise("skip"),
    ).withColumn(
        "reason", F.when(F.col("status") == "fail", F.col("error"))
        .when(F.col("status") == "skip", F.concat(F.lit("filtered_low_contact "), counts_text())))


def drop_filtered(stored: DataFrame, status: DataFrame) -> DataFrame:
    """Stored samples without those that the label filter rejected."""
    return stored.join(status.where("status = 'skip'").select("sample_id"), "sample_id", "left_anti")


def sample_summary_line(samples: DataFrame, folder: str) -> DataFrame:
    """One readable line per prepared sample."""
    rc = F.when(F.col("alignment_reverse_complement"), "True").otherwise("False")
    line = F.concat(
        F.format_string(f"wrote {folder}/%s.npz N=%d M=%d E=%d ", F.col("sample_id").cast("string"), "n_res", "m", "n_edges"),
        counts_text(),
        F.format_string(
            " alignment=%s chain=%s start=%d rc=%s score_mode=%s contact_candidates=%d/%d",
            "alignment_mode", "alignment_chain", "alignment_start", rc, "alignment_score_mode",
            "alignment_contact_candidate_count", "alignment_candidate_count"))
    return samples.select("sample_id", line.alias("line"))


def classify_failures(failures: DataFrame, rules=FAILURE_RULES) -> DataFrame:
    """``label``: first rule one of whose substrings occurs in ``reason``."""
    label = None
    for name, needles in rules:
        hit = None
        for n in needles:
            one = F.col("reason").contains(n)
            hit = one if hit is None else hit | one
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return failures.withColumn("label", label.otherwise("other"))


def failure_summary(classified: DataFrame, examples: int = 5) -> DataFrame:
    """split, label, count and the first ``examples`` entries joined by ';'.

    The examples are cut to a few rows per group before they are collected.
    """
    keys = ["split", "label"]
    counts = classified.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    few = first_per_key(classified.select(*keys, "ord", "entry"), keys, [F.col("ord")], examples)
    shown = few.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ord", "entry"))).getField("entry"), ";").alias("examples"))
    return counts.join(shown, keys)


def failure_pivot(outcomes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """split x class table with successes, failures and a global row.

    ``outcomes``: split, reason (NULL = success).
    """
    labels = labels or [name for name, _ in FAILURE_RULES] + ["other"]
    c = classify_failures(outcomes).withColumn("label", F.when(F.col("reason").isNotNull(), F.col("label")))
    per = c.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    wide = per.rollup("split").agg(
        F.grouping("split").alias("_all"),
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("success"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("failure"),
        *[F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0)).alias(name) for name in labels])
    return wide.withColumn("split", F.when(F.col("_all") == 1, "global").otherwise(F.col("split"))).drop("_all")


#: Edges of a row in the store.
EDGE_BLOCK = 1 << 13


@dataclass
class Prepared:
    """Status rows, and what labels and arrays are made of (keyed by selection).  ``contacts``: those of given nucleotides
    (structure_id, dna_idx); all of a dense structure are many more than its residues.  ``edges``: all, or those of given
    residues with ``n_res``."""

    status: DataFrame
    contacts: Callable[[DataFrame], DataFrame]
    missing: DataFrame
    protein: DataFrame
    edges: DataFrame | Callable[[DataFrame], DataFrame]
    motifs: DataFrame

    def labels(self, status: DataFrame | None = None) -> DataFrame:
        """One row for each sample that passed: its slots in order, each with its nucleotide,
        masks and the residues in base and backbone contact.  ``status``: the rows as
        stored, so that the preparation does not run again."""
        ok = (self.status if status is None else status).where("status = 'ok'")
        return self._slots(ok).join(ok.select("sample_id", *[c for c in ("split",) if c in ok.columns]), "sample_id")

    def _slots(self, placed: DataFrame) -> DataFrame:
        slots = C.slot_rows(placed.select("sample_id", F.col("selection").alias("structure_id"), "slot_to_dna_index"))
        rows = C.slot_labels(slots, self.contacts(slots), self.missing)
        slot = F.struct("slot", "dna_idx", "pwm_mask", "base_mask", "base_res", "backbone_res")
        return rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(slot)).alias("slots"))

    def packed(self, status: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """A row with all arrays for each sample without error, whatever its counts: ``residues`` (number, id, letter,
        point and, with ``vectors``, vector), ``edges`` (ends, distance, features), ``pwm``, ``slots`` and ``site_res``."""
        own, shared = self.parts(status, vectors)
        return own.join(store.whole_lists(shared, ["selection"]).withColumnRenamed("selection", "graph"), "graph").drop("graph")

    def parts(self, status: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """``packed`` as it is stored: what each sample has of its own with the ``graph`` it shares, and the ``residues`` and
        ``edges`` of each graph in blocks.

        A graph is made of the protein residues alone: selections that differ in DNA chains have the same, named by the first of
        them. Its edges grow with the square of a dense structure, so a row holds a block of residues with the edges that begin
        there, ``EDGE_BLOCK`` at most unless one residue has more. Residues and edges are rows of one table, in which each kind has
        a column of its own, so one shuffle packs both; it deals blocks to all shuffle partitions, and features are made after it.
        ``vectors``: structure_id (the selection), sel_idx, vector; a residue without one has NULL."""
        placed = (self.status if status is None else status).where("error IS NULL").drop("status", "reason", "error")
        alike = ["structure_id", "protein_chains"]
        if vectors is None and set(alike) <= set(placed.columns):
            first = placed.groupBy(*alike).agg(F.min("selection").alias("graph"))
            placed = placed.join(first, alike, "left").withColumn("graph", F.coalesce("graph", "selection"))
        else:
            placed = placed.withColumn("graph", F.col("selection"))
        wanted = placed.select(F.col("graph").alias("structure_id")).distinct()
        protein = self.protein.join(wanted, "structure_id", "left_semi")
        sizes = G.graph_sizes(protein)
        edges = self.edges(protein) if callable(self.edges) else self.edges.join(wanted, "structure_id", "left_semi").join(sizes, "structure_id")
        protein = protein.join(sizes, "structure_id")
        if vectors is not None:
            protein = protein.join(vectors.select("structure_id", "sel_idx", "vector"), ["structure_id", "sel_idx"], "left")
        fields = [F.col("sel_idx").alias("res_idx"), S.residue_id().alias("residue_id"), S.one_letter().alias("aa"), "x", "y", "z"]
        block = lambda c: F.floor(F.col(c) / F.greatest(F.floor(F.lit(EDGE_BLOCK) / F.col("n_res")), F.lit(1))).cast("int").alias("block")
        residues = protein.select("structure_id", block("sel_idx"), F.struct(*fields, *(["vector"] if vectors is not None else [])).alias("residue"))
        edges = edges.select("structure_id", block("src"), "src", "dst", "dist", "n_res")
        both = residues.unionByName(edges, allowMissingColumns=True)
        # One more than the joins above: an equal number would be taken for theirs, which are put together by size.
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
        dealt = G.edge_features(both.repartition(n, "structure_id", "block"))
        edge = F.when(F.col("src").isNotNull(), F.struct("src", "dst", "dist", "edge_attr"))
        shared = dealt.groupBy(F.col("structure_id").alias("selection"), "block").agg(
            F.array_sort(F.collect_list("residue")).alias("residues"), F.array_sort(F.collect_list(edge)).alias("edges"))
        used = self.motifs.join(placed.select("motif_id").distinct(), "motif_id", "left_semi")
        pwm = normalize_pwm(used).groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", *ACGT))).alias("pwm"))
        out = placed.join(self._slots(placed), "sample_id").join(pwm, "motif_id")
        site = F.flatten(F.transform("slots", lambda x: F.concat(x.base_res, x.backbone_res)))
        return out.withColumn("site_res", F.array_sort(F.array_distinct(site))), shared


def prepare_samples(samples: DataFrame, atoms: DataFrame, motifs: DataFrame, *args, **kwargs) -> DataFrame:
    """The status rows of ``prepare_batch``."""
    return prepare_batch(samples, atoms, motifs, *args, **kwargs).status


#: Optional columns of samples that choose how a sample is placed.
POLICY = {"policy": "string", "manual_index": "string", "manual_start": "int"}


def _manual(samples: DataFrame, scoring: DataFrame, sizes: DataFrame, contacts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Explicit placements as ``align_contact_constrained`` has its own, with the counts of their slots."""
    named = samples.select("sample_id", F.col("selection").alias("structure_id"), "motif_id", "manual_index", "manual_start")
    given = A.manual_slots(named.join(scoring.select("motif_id", "m"), "motif_id"))
    n_dna = sizes.select(F.col("selection").alias("structure_id"), "n_dna")
    checked = given.join(n_dna, "structure_id").withColumn("error", F.coalesce("error", A.slot_error(F.col("slot_to_dna_index"), F.col("n_dna"))))
    good = checked.where("error IS NULL").select("sample_id", "structure_id", "slot_to_dna_index")
    slots = C.slot_rows(good)
    counts = C.once_per_placement(slots, lambda one: C.contact_counts(C.sparse_labels(one, contacts(slots))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return checked.join(counts, "sample_id", "left").select(
        "sample_id", F.lit("").alias("chain"), "start", F.lit(False).alias("reverse_complement"), F.lit(None).cast("double").alias("score"),
        F.lit("").alias("aligned_sequence"), F.when(F.col("error").isNull(), F.col("slot_to_dna_index")).alias("slot_to_dna_index"),
        F.lit(None).cast("boolean").alias("is_full"), "m", F.lit(0).cast("bigint").alias("candidate_count"),
        F.lit(0).cast("bigint").alias("contact_candidate_count"),
        *[zero(c).alias(f"{x}_pos") for x, c in zip(("base", "backbone", "contact", "site"), COUNTS, strict=True)],
        "error", F.col("alignment_mode").alias("manual_mode"))


def prepare_batch(
    samples: DataFrame, atoms: DataFrame, motifs: DataFrame, mode: str = "ic_log_likelihood",
    min_base: int = 0, min_contact: int = 1, min_site: int = 1, placed: tuple[int, int, int] | None = None,
) -> Prepared:
    """Status of every sample with its placement, sizes and label counts.

    ``min_*``: what a sample must have not to be skipped; ``placed``: base, contact and site minimums of a window
    chosen by its contacts (the same unless given).

    ``samples``: sample_id, structure_id, motif_id, protein_chains, dna_chains
    (texts; blank = all); other manifest columns are carried through.  Samples with the same structure and chain lists share one
    *selection* of residue indices.

    How a sample is placed is its own: an index list (``manual_index``) or first nucleotide (``manual_start``) if it
    has one, else the best window that passes the contact minimums, or the best of all if ``policy`` is
    ``sequence_only``.  All three columns may be absent.  The automatic policies share windows, scores and counts.
    """
    s = samples.withColumn("selection", F.concat_ws("|", "structure_id", "protein_chains", "dna_chains"))
    has_manual = bool({"manual_index", "manual_start"} & set(s.columns))
    for c, kind in POLICY.items():
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast(kind))
    by_hand = (F.trim(F.coalesce("manual_index", F.lit(""))) != "") | F.col("manual_start").isNotNull()
    # Geometry once per structure; chain lists only choose from its residues.
    every = cut_lineage(S.residue_profile(atoms))
    profile = every.where("kind <> 'other'")
    picks = s.select("selection", "structure_id", S.parse_chain_list("protein_chains").alias("p"),
                     S.parse_chain_list("dna_chains").alias("d")).distinct()
    allowed = F.when(F.col("kind") == "protein", F.col("p")).otherwise(F.col("d"))
    listed = profile.select(*S.RESIDUE_KEY, "res_ord", "kind", "n_heavy", "n_base", "n_backbone", "x", "y", "z").join(picks, "structure_id").where(
        allowed.isNull() | F.array_contains(allowed, F.col("chain"))).drop("p", "d")
    chosen = listed.withColumnRenamed("structure_id", "source").withColumnRenamed("selection", "structure_id")
    residues = cut_lineage(S.index_kinds(chosen))
    protein, dna = residues.where("kind = 'protein'"), residues.where("kind = 'dna'")
    positions = cut_lineage(C.chain_positions(dna))
    scoring = cut_lineage(A.scoring_table(motifs, mode))
    keyed = s.select("sample_id", F.col("selection").alias("structure_id"), "motif_id")
    chains = cut_lineage(A.structure_chains(positions, A.wanted_classes(keyed, scoring)))
    # Residues of whole structures, whatever lists choose them; named by their key, as their atoms are.
    whole = cut_lineage(S.index_kinds(profile.select(*S.RESIDUE_KEY, "res_ord", "kind"))).withColumn("key", F.struct(*S.RESIDUE_KEY[1:]))
    named = lambda kind: whole.where(F.col("kind") == kind).select("structure_id", F.col("key").alias("res_ord"), "sel_idx", "chain")
    tagged = S.keyed_atoms(atoms)
    p_whole = named("protein").withColumnRenamed("chain", "p_chain")
    d_whole = named("dna").join(C.chain_positions(whole.where("kind = 'dna'")).select("structure_id", F.col("dna_idx").alias("sel_idx"), "pos"), ["structure_id", "sel_idx"])
    every_contact = C.contact_labels(C.residue_distances(tagged, p_whole, d_whole, of_protein=("p_chain",), of_dna=("chain", "pos")))
    # Sums by chain of the residue; a selection adds up those of its chains.  A chain is chosen whole, so positions on it stay.
    per_chain = cut_lineage(A.contact_events(every_contact, positions, ("p_chain",)))
    chain_of = lambda names, chain: F.col(names).isNull() | F.array_contains(names, F.col(chain))
    events = cut_lineage(per_chain.join(picks, "structure_id").where(chain_of("p", "p_chain") & chain_of("d", "chain")).groupBy(
        F.col("selection").alias("structure_id"), "chain", "pos", "gap").agg(*[F.sum(c).alias(c) for c in "bkcs"]))

    def contacts(used: DataFrame) -> DataFrame:
        """Contacts of the nucleotides named by structure_id (the selection) and dna_idx."""
        of = lambda side, ord_name: side.select("structure_id", "source", F.struct(*S.RESIDUE_KEY[1:]).alias("key"), F.col("sel_idx").alias(ord_name))
        at = whole.select(F.col("structure_id").alias("source"), "key", F.col("sel_idx").alias("_whole"))
        wanted = of(dna, "dna_idx").join(used.select("structure_id", "dna_idx").distinct(), ["structure_id", "dna_idx"], "left_semi").join(at, ["source", "key"]).drop("key")
        some = wanted.select(F.col("source").alias("structure_id"), F.col("_whole").alias("sel_idx")).distinct()
        close = C.contact_labels(C.residue_distances(tagged, p_whole, named("dna").join(some, ["structure_id", "sel_idx"], "left_semi")))
        close = close.select(F.col("structure_id").alias("source"), F.col("res_idx").alias("_residue"), F.col("dna_idx").alias("_whole"), "base_label", "backbone_label")
        own = of(protein, "res_idx").join(at.withColumnRenamed("_whole", "_residue"), ["source", "key"]).drop("key")
        return close.join(wanted, ["source", "_whole"]).join(own, ["source", "structure_id", "_residue"]).select(
            "structure_id", "res_idx", "dna_idx", "base_label", "backbone_label")

    bare = dna.where("n_backbone = 0").select("structure_id", F.col("sel_idx").alias("dna_idx")).join(
        positions.drop("letter"), ["structure_id", "dna_idx"])
    # Edges are counted per pair of chains, then summed over the allowed pairs.
    pts = profile.where("kind = 'protein'")
    graph = G.residue_graph_edges(pts.select("structure_id", F.col("res_ord").alias("res_idx"), "chain", "x", "y", "z"), ends=["chain"])
    by_chain = graph.groupBy("structure_id", "src_chain", "dst_chain").agg(F.count(F.lit(1)).alias("n"))
    edges = by_chain.join(picks.drop("d"), "structure_id").where(chain_of("p", "src_chain") & chain_of("p", "dst_chain")).groupBy(
        "selection").agg(F.sum("n").alias("n_edges"))

    sizes = residues.groupBy(F.col("structure_id").alias("selection")).agg(
        F.count_if(F.col("kind") == "protein").alias("n_res"), F.count_if(F.col("kind") == "dna").alias("n_dna"))
    policy = F.coalesce("policy", F.lit("require_contact"))
    keyed = s.where(~by_hand).select("sample_id", F.col("selection").alias("structure_id"), "motif_id", policy.alias("policy"))
    free = F.col("policy") == "sequence_only"
    cands = A.contact_candidates(keyed, chains, scoring, positions, events, free=free)
    aligned = A.align_contact_constrained(cands, chains, *(placed or (min_base, min_contact, min_site)))
    broken = A.bad_residue_error(keyed.where(~free), chains, scoring, bare)
    if set(POLICY) & set(samples.columns):
        # Only the residues in the slots matter where a placement is not chosen by its contacts.
        own = aligned.join(keyed.where(free).select("sample_id"), "sample_id", "left_semi").select("sample_id", "structure_id", "slot_to_dna_index")
        aligned = aligned.withColumn("manual_mode", F.lit(None).cast("string"))
        if has_manual:
            manual = _manual(s.where(by_hand), scoring, sizes, contacts)
            own = own.unionByName(manual.where("error IS NULL").join(s.select("sample_id", F.col("selection").alias("structure_id")), "sample_id").select(*own.columns))
            aligned = aligned.select(*manual.columns).unionByName(manual)
        broken = broken.unionByName(A.bad_slot_error(own, bare.select("structure_id", "dna_idx", "residue_id")))
    else:
        aligned = aligned.withColumn("manual_mode", F.lit(None).cast("string"))
    broken = broken.withColumnRenamed("error", "atom_error")
    # A protein residue of hydrogens only has no distances to anything.
    empty = protein.where("n_heavy = 0").groupBy(F.col("structure_id").alias("selection")).agg(
        F.min_by(S.residue_id(), F.col("sel_idx")).alias("_rid")).select("selection", F.concat(
            F.lit("Residue "), "_rid", F.lit(" has no heavy atoms.")).alias("heavy_error"))
    # An atom line that cannot be read fails every sample on its structure.
    known = every.groupBy("structure_id").agg(F.min("parse_error").alias("parse_error")).withColumn("_has", F.lit(True))
    known_motif = motifs.select("motif_id").distinct().withColumn("_motif", F.lit(True))

    j = (
        s.join(known, "structure_id", "left").join(known_motif, "motif_id", "left")
        .join(sizes, "selection", "left")
        .join(edges, "selection", "left")
        .join(empty, "selection", "left")
        .join(aligned.drop("structure_id").withColumnRenamed("error", "align_error"), "sample_id", "left")
        .join(broken, "sample_id", "left")
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    error = (
        F.when(F.col("_has").isNull(), F.concat(F.lit("structure file not found: "), "structure_id"))
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.col("_motif").isNull(), F.concat(F.lit("motif file not found: "), F.col("motif_id").cast("string")))
        .when(none("n_res"), "No protein residues found. Check --protein-chains.")
        .when(none("n_dna"), "No DNA residues found. Check --dna-chains.")
        .otherwise(F.coalesce(F.when(by_hand, F.col("align_error")), "heavy_error", "atom_error", "align_error"))
    )
    prefix = F.when(F.col("is_full"), "").otherwise("partial_")
    automatic = F.concat(prefix, F.when(policy == "sequence_only", "auto_pwm_dna").otherwise("contact_constrained_pwm_dna"))
    tried = lambda c: F.when(policy == "sequence_only", F.lit(0).cast("bigint")).otherwise(F.col(c))
    done = j.select(
        "sample_id", "structure_id", "motif_id", "protein_chains", "dna_chains",
        *[c for c in MANIFEST_COLUMNS if c in s.columns and c not in ("sample_id", "structure_id", "motif_id", "protein_chains", "dna_chains")],
        "selection", error.alias("error"),
        "n_res", "m", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        *[F.col(f"{c}_pos").alias(out) for c, out in zip(("base", "backbone", "contact", "site"), COUNTS)],
        "slot_to_dna_index", F.coalesce("manual_mode", automatic).alias("alignment_mode"),
        F.when(F.col("manual_mode").isNotNull(), "manual").otherwise(mode).alias("alignment_score_mode"), F.col("chain").alias("alignment_chain"),
        F.col("start").alias("alignment_start"), F.col("reverse_complement").alias("alignment_reverse_complement"),
        F.col("score").alias("alignment_score"), F.col("aligned_sequence").alias("alignment_sequence"),
        tried("candidate_count").alias("alignment_candidate_count"),
        tried("contact_candidate_count").alias("alignment_contact_candidate_count"))
    no_base = dna.where("n_base = 0").select("structure_id", F.col("sel_idx").alias("dna_idx"), F.lit("base").alias("part"))
    # The graph of a selection: edges come with the indices of their ends, none is joined to residues.
    own_edges = lambda chosen: G.sized_edges(chosen.select("structure_id", F.col("sel_idx").alias("res_idx"), *G.AXES))
    return Prepared(route_status(done, min_base, min_contact, min_site), contacts, no_base, protein, own_edges, motifs)


def prepare_manifest(
    manifest: DataFrame, atoms: DataFrame, motifs: DataFrame, root: str, overwrite: bool = False, drop_filtered: bool = False,
    vectors: DataFrame | None = None, mode: str = "ic_log_likelihood", min_base: int = 0, min_contact: int = 1, min_site: int = 1,
    placed: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Prepare what is not stored below ``root`` yet, and the status of every row of the manifest.

    ``manifest``: the samples of ``prepare_batch``; a row with an ``input_error`` (``require_inputs``) fails without
    being prepared, stored or not.  Stored samples are not computed again (unless ``overwrite``): their counts come
    from the store and are held against the minimums anew, so that a second run with others moves samples between
    success and failure.  Samples with an error are not stored and are tried again by the next run.  What is computed
    is stored whatever its counts, as one run that counts only once it is complete; with ``drop_filtered`` those below
    the minimums are removed after.  Repeated sample ids are one sample; the first in ``ord`` order is meant."""
    spark = manifest.sparkSession
    root = root.rstrip("/")
    order = "ord" if "ord" in manifest.columns else "structure_id"
    rows = first_per_key(manifest, ["sample_id"], [F.col(order)], 1)
    fault = F.col("input_error") if "input_error" in rows.columns else F.lit(None).cast("string")
    rows = cut_lineage(rows.withColumn("_fault", fault))
    light = [*COUNTS, "n_res", "m", "n_edges", *A.META]
    have = store.read_samples(spark, root, light)
    todo = rows.where("_fault IS NULL").drop("_fault", "input_error")
    todo = cut_lineage(todo if have is None else N.pending_samples(todo, have, overwrite))
    failed = None
    if not todo.isEmpty():
        own = atoms.join(todo.select("structure_id").distinct(), "structure_id", "left_semi")
        batch = prepare_batch(todo, own, motifs, mode, min_base, min_contact, min_site, placed)
        status = cut_lineage(batch.status)
        failed = status.where("error IS NOT NULL").select("sample_id", "error")
        store.write_run(*batch.parts(status, vectors), root=root)
        have = store.read_samples(spark, root, light)
    known = have.select("sample_id", "run", "processed_path", *light) if have is not None else todo.select("sample_id", *[
        F.lit(None).cast(t).alias(c) for c, t in [("run", "string"), ("processed_path", "string"), *[(c, "bigint") for c in light]]])
    out = rows.drop("input_error").join(known, "sample_id", "left")
    out = out.join(failed, "sample_id", "left") if failed is not None else out.withColumn("error", F.lit(None).cast("string"))
    out = out.withColumn("error", F.coalesce("_fault", "error")).drop("_fault")
    final = cut_lineage(route_status(out, min_base, min_contact, min_site))
    if drop_filtered:
        store.drop_samples(final.where("status = 'skip'"), root)
        final = final.withColumn("processed_path", F.when(F.col("status") != "skip", F.col("processed_path")))
    return final
