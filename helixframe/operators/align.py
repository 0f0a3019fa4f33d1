"""Placing motifs on sequences.

A *chain row* is ``sample_id, chain_ord, chain, chain_len, seg_start, core_len,
sequence, motif_id`` and either ``indices`` (index of every letter) or ``offset``
(index of the chain's first letter).  A chain longer than one segment is several
rows: ``sequence`` then holds ``core_len`` letters plus a halo from the next
segment, so that every window lies in exactly one row and no row grows with the
chain.  Scores are Σ num / Σ den over the covered motif rows; num and den are packed
per motif, so scoring is a higher-order function on arrays and needs no shuffle.

Samples on structures share chain rows, and there are as many candidates as samples times windows.  They are never
rows: samples of a structure whose motifs have the same length travel in *blocks* beside a segment and the contact
counts of its windows, and a block gives a row for each of its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage
from helixframe.functions.constants import EPS
from helixframe.functions.pwm import ACGT, normalized, row_ic, settled, total
from helixframe.functions.window_scores import BLOCK_ARGS, best_candidate, candidate_scores, constrained_best

#: Letters of a segment; bounds what one row's scores take.
SEGMENT = 1024
#: Motif rows of a block of samples (one sample at least), and blocks that share a copy of a structure's segments.
BLOCK, SHARE = 512, 8
SCORE_MODES = ("log_likelihood", "ic_log_likelihood", "ic_pcc")


# ------------------------------------------------------------------- inputs
def needed_halo(scoring: DataFrame) -> int:
    """Letters a segment needs beyond its own: one less than the longest motif."""
    return max(0, (scoring.agg(F.max("m")).first()[0] or 1) - 1)


def length_class(m: Column) -> Column:
    """Power of two that a motif's length does not exceed (its exponent)."""
    return F.ceil(F.log2(F.greatest(m, F.lit(1)))).cast("int")


def segment_text_chains(chains: DataFrame, halo: int | DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Cut ``sequence`` of (sample_id, chain_ord, chain, sequence, offset, motif_id)
    rows into segments with a halo.

    ``halo``: letters for all rows, or the scoring table: then each row gets what its own
    motif needs, and segments as long as its length class, so that a long motif makes
    only its own rows longer."""
    length = F.length("sequence")
    if isinstance(halo, DataFrame):
        own = halo.select("motif_id", (F.col("m") - 1).alias("_halo"), F.greatest(F.lit(segment), F.call_function("shiftleft", F.lit(1), length_class(F.col("m")))).alias("_seg"))
        rows = chains.join(own, "motif_id")
    else:
        rows = chains.withColumn("_halo", F.lit(halo)).withColumn("_seg", F.lit(segment))
    return (
        rows.withColumn("chain_len", length).where(length > 0)
        .withColumn("seg_start", F.explode(F.sequence(F.lit(0), F.col("chain_len") - 1, F.col("_seg"))))
        .withColumn("core_len", F.least(F.col("_seg"), F.col("chain_len") - F.col("seg_start")))
        .withColumn("sequence", F.expr("substring(sequence, seg_start + 1, _seg + _halo)")).drop("_seg", "_halo")
    )


def wanted_classes(samples: DataFrame, scoring: DataFrame) -> DataFrame:
    """structure_id, cls: length classes of the motifs that are placed on each structure."""
    return samples.select("structure_id", "motif_id").join(scoring.select("motif_id", "cls"), "motif_id").select("structure_id", "cls").distinct()


def structure_chains(positions: DataFrame, halo: int | DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Chain rows (without sample and motif) from ``contacts.chain_positions``.

    ``halo``: letters for all, or ``wanted_classes``: then a chain is cut once for each class
    that is asked for on its structure (``cls``), into segments and halos of that length, so
    that a letter is in two rows of a class at most."""
    keys = ["structure_id", "chain"]
    chains = positions.groupBy(*keys).agg(
        F.min("dna_idx").alias("chain_ord"), F.count(F.lit(1)).cast("int").alias("chain_len"))
    if isinstance(halo, DataFrame):
        size = F.call_function("shiftleft", F.lit(1), F.col("cls"))
        cut, by = positions.join(halo.withColumns({"_halo": size - 1, "_seg": F.greatest(F.lit(segment), size)}), "structure_id"), [*keys, "cls"]
    else:
        cut, by = positions.withColumns({"_halo": F.lit(halo), "_seg": F.lit(segment)}), keys
    block = F.floor(F.col("pos") / F.col("_seg")).cast("int")
    # A letter lies in its own segment and in the halo of earlier ones.
    earliest = F.greatest(F.lit(0), F.ceil((F.col("pos") + 1 - F.col("_seg") - F.col("_halo")) / F.col("_seg")).cast("int"))
    rows = cut.withColumn("own", block).withColumn("seg", F.explode(F.sequence(earliest, block))).groupBy(*by, "_seg", "seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "letter", "dna_idx"))).alias("_l"),
        F.count_if(F.col("own") == F.col("seg")).cast("int").alias("core_len"))
    return rows.where(F.col("core_len") > 0).join(chains, keys).select(
        *by, "chain_ord", "chain_len", (F.col("seg") * F.col("_seg")).alias("seg_start"), "core_len",
        F.array_join(F.col("_l.letter"), "").alias("sequence"), F.col("_l.dna_idx").alias("indices"))


def sample_chains(samples: DataFrame, chains: DataFrame, scoring: DataFrame, free: Column | None = None) -> DataFrame:
    """Samples, in blocks, beside the segments of their structure that they may be placed on, in the class of their motif;
    where a chain is as long as the motif, only such chains.  ``free``: on samples; those that need no contacts."""
    return _beside(*_blocks(samples, chains, scoring, free))


def _blocks(samples: DataFrame, chains: DataFrame, scoring: DataFrame, free: Column | None) -> tuple[DataFrame, DataFrame]:
    """(blocks of samples, segments): structure_id, m, share and a block's samples with their motifs; the segments of a
    structure for each length ``m`` that is asked for on it, and how many ``shares`` of blocks are to be held against them."""
    cut = [c for c in ("cls",) if c in chains.columns]
    keyed = samples.select("sample_id", "structure_id", "motif_id", (F.lit(False) if free is None else F.coalesce(free, F.lit(False))).alias("free")).join(scoring, "motif_id")
    n_blocks = F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.greatest("m", F.lit(1))))).cast("bigint")
    shapes = keyed.groupBy("structure_id", "m", "cls").agg(n_blocks.alias("blocks"))
    part = F.pmod(F.xxhash64("sample_id", "motif_id"), "blocks")
    one = F.struct("sample_id", "num", "den", "lp", "free")
    blocks = keyed.join(shapes.drop("cls"), ["structure_id", "m"]).groupBy(
        "structure_id", "m", F.floor(part / SHARE).alias("share"), part.alias("block")).agg(F.collect_list(one).alias("_b")).select(
        "structure_id", "m", "share", F.col("_b.sample_id").alias("ids"), F.flatten("_b.num").alias("num"), F.flatten("_b.den").alias("den"),
        F.flatten("_b.lp").alias("lp"), F.transform("_b", lambda b: F.size(b["lp"])).alias("n_lp"), F.col("_b.free").alias("free"))
    longest = chains.groupBy("structure_id").agg(F.max("chain_len").alias("longest"))
    wanted = shapes.select("structure_id", "m", *cut, F.ceil(F.col("blocks") / SHARE).alias("shares"))
    rows = wanted.join(longest, "structure_id").join(chains, ["structure_id", *cut]).where(_GATE)
    return blocks, _placements(rows).drop("longest")


def _beside(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks beside the segments of their structure; these are copied once for every ``SHARE`` blocks, so that a structure with
    many samples is spread."""
    copies = segments.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares").cast("bigint") - 1))).drop("shares")
    return blocks.join(copies, ["structure_id", "m", "share"])


def scoring_table(motifs: DataFrame, mode: str = "ic_log_likelihood", key: str = "motif_id") -> DataFrame:
    """Per motif: ``num`` (4M values, row-major), ``den`` (M), ``lp`` (4M), ``m`` and its class ``cls``."""
    if mode not in SCORE_MODES:
        raise ValueError(f"score mode must be one of {', '.join(SCORE_MODES)}")
    rows = settled(motifs, [key, "pos"], dict(zip(ACGT, normalized([F.col(b) for b in ACGT]), strict=True)))
    p = [F.col(b) for b in ACGT]
    rows = settled(rows, [key, "pos", *ACGT], {"ic": row_ic(p), **{f"l{b}": F.ln(c + EPS) for b, c in zip(ACGT, p, strict=True)}})
    ic, lp = F.col("ic"), [F.col(f"l{b}") for b in ACGT]
    if mode == "log_likelihood":
        num, den = lp, F.lit(1.0)
    elif mode == "ic_log_likelihood":
        num, den = [ic * x for x in lp], ic
    else:
        mean = total(p) / 4.0
        norm = F.sqrt(F.lit(0.75) * total([(c - mean) * (c - mean) for c in p]))
        num = [F.when(norm > EPS, ic * (c - mean) / norm).otherwise(0.0) for c in p]
        den = F.lit(1.0)
    packed = rows.select(key, "pos", F.array(*num).alias("n"), den.alias("d"), F.array(*lp).alias("l")) \
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "d", "l"))).alias("_r"))
    return packed.select(
        key, F.size("_r").alias("m"), length_class(F.size("_r")).alias("cls"), F.flatten(F.col("_r.n")).alias("num"),
        F.col("_r.d").alias("den"),
        # The plain log terms are needed only where a window may hold no information.
        F.when(F.exists(F.col("_r.d"), lambda d: d <= EPS), F.flatten(F.col("_r.l")))
        .otherwise(F.array().cast("array<double>")).alias("lp"))


# ------------------------------------------------------------------ placements
_KERNEL_ARGS = ["sequence", "num", "den", "lp", "is_full", "vis", "n_place"]
# Start on the oriented strand of placement ``i`` of a chain row.
_START = "if(is_full and reverse_complement, chain_len - m - seg_start - i, if(is_full, seg_start + i, i))"


def place(chain_rows: DataFrame, scoring: DataFrame) -> DataFrame:
    """Join chains to motifs and count the placements ``n_place`` of each row.

    A chain shorter than the motif is placed whole inside it (``is_full`` false); with
    ``needed_halo`` its first segment holds all of it.
    """
    return _placements(chain_rows.join(scoring.drop("cls"), "motif_id"))


def _placements(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("is_full", F.col("chain_len") >= F.col("m"))
        .withColumn("vis", F.least("chain_len", "m").cast("int"))
        .withColumn("n_place", F.expr(
            "cast(if(is_full, least(core_len, length(sequence) - m + 1), m - chain_len + 1) as int)"))
        .where((F.col("n_place") > 0) & (F.col("is_full") | (F.col("seg_start") == 0)))
    )


def describe(cands: DataFrame) -> DataFrame:
    """Add ``aligned_sequence`` and ``slot_to_dna_index`` to placements that carry
    their chain row, ``i`` and ``reverse_complement``."""
    at = "(coff + if(reverse_complement, vis - 1 - (k - woff), k - woff))"
    at = f"indices[{at}]" if "indices" in cands.columns else f"(offset + seg_start + {at})"
    d = cands.withColumn("coff", F.expr("if(is_full, i, 0)")).withColumn("woff", F.expr("if(is_full, 0, i)"))
    seen = F.expr("substring(sequence, coff + 1, vis)")
    oriented = F.when(F.col("reverse_complement"), F.reverse(F.translate(seen, "ACGT", "TGCA"))).otherwise(seen)
    return d.withColumn("aligned_sequence", F.concat(
        F.repeat(F.lit("-"), F.col("woff")), oriented,
        F.repeat(F.lit("-"), F.col("m") - F.col("woff") - F.col("vis")),
    )).withColumn("slot_to_dna_index", F.expr(
        f"transform(sequence(0, m - 1), k -> if(k >= woff and k < woff + vis, cast({at} as bigint), -1L))")
    ).drop("coff", "woff")


def score_candidates(placed: DataFrame) -> DataFrame:
    """One row per candidate: ``i``, ``reverse_complement``, ``start``, ``raw``."""
    return (
        placed.withColumn("_s", candidate_scores(*_KERNEL_ARGS)).drop("num", "den", "lp")
        .select("*", F.posexplode("_s").alias("_k", "raw")).drop("_s")
        .withColumn("reverse_complement", F.col("_k") >= F.col("n_place"))
        .withColumn("i", F.col("_k") % F.col("n_place"))
        .withColumn("start", F.expr(_START)).drop("_k")
    )


def enumerate_windows(chain_rows: DataFrame, scoring: DataFrame, kind: str = "full") -> DataFrame:
    """All placements, unscored, one row each.  ``kind``: full, partial or all."""
    placed = place(chain_rows, scoring).drop("num", "den", "lp")
    if kind != "all":
        placed = placed.where(F.col("is_full") == F.lit(kind == "full"))
    both = (
        placed.withColumn("reverse_complement", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("i", F.explode(F.expr("sequence(0, n_place - 1)")))
        .withColumn("start", F.expr(_START))
    )
    return describe(both)


# Larger sorts first: full before partial, then the score rounded to 1e-9 so that
# equal windows tie exactly, then earlier chain, forward strand, smaller start.
_ORDER = "struct(is_full, round(raw, 9), -chain_ord, not reverse_complement, -start)"


def align_sequence_only(chain_rows: DataFrame, scoring: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Best placement per sample; partial ones count only when no chain fits.

    The kernel reduces every chain row to its own best, and ``is_full`` leads the
    comparison, so the gate needs no second pass.  ``chain_rows`` may be those of
    ``sample_chains``; ``chains`` are then the chain rows that they came from.
    """
    if "ids" in chain_rows.columns:
        row = _segment_key(chain_rows)
        letters = (chain_rows.dropDuplicates(row) if chains is None else chains).select(*row, "sequence", "indices")
        top = _best_of_blocks(chain_rows.withColumn("free", F.transform("free", lambda x: F.lit(True))), 0, 0, 0)
        found = top.select("sample_id", "structure_id", "r.*").join(letters, row, "left")
        return describe(found).drop("sequence", "indices").withColumnRenamed("raw", "score")
    per_row = place(chain_rows, scoring).withColumn("_b", best_candidate(*_KERNEL_ARGS)).drop("num", "den", "lp")
    per_row = per_row.withColumn("raw", F.col("_b.raw")).withColumn("i", F.col("_b.i")).withColumn(
        "reverse_complement", F.col("_b.reverse")).withColumn("start", F.expr(_START)).drop("_b")
    keep = [c for c in per_row.columns if c != "sample_id"]
    top = per_row.groupBy("sample_id").agg(F.max_by(F.struct(*keep), F.expr(_ORDER)).alias("r"))
    return describe(top.select("sample_id", "r.*")).withColumnRenamed("raw", "score")


# -------------------------------------------------------- contact-constrained
def contact_events(contacts: DataFrame, positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Contacts summed by position, chain and ``by`` (columns of the residue): their numbers ``b``, ``k``, ``c``, and ``s``
    residues whose last contact on the chain lies ``gap`` positions before (NULL: none).  All that windows need of contacts,
    which can be many more than positions."""
    at = contacts
    if "pos" not in contacts.columns:
        at = contacts.join(positions.select("structure_id", "chain", "pos", "dna_idx"), ["structure_id", "dna_idx"])
    place = ["structure_id", "chain"]
    any_label = F.greatest("base_label", "backbone_label")
    earlier = F.lag("pos").over(Window.partitionBy(*place, "res_idx").orderBy("pos"))
    return at.where(any_label > 0).select(
        *place, *by, "pos", (F.col("pos") - earlier).alias("gap"), "base_label", "backbone_label", any_label.alias("_any")).groupBy(*place, *by, "pos", "gap").agg(
        F.sum("base_label").alias("b"), F.sum("backbone_label").alias("k"), F.sum("_any").alias("c"), F.count(F.lit(1)).alias("s"))


def window_contacts(windows: DataFrame, positions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contact counts of chain windows.

    ``windows``: structure_id, chain, vis, fstart; ``positions``: structure_id,
    chain, pos, dna_idx; ``contacts``: structure_id, res_idx, dna_idx, base_label,
    backbone_label (``positions`` are not needed if it has ``chain`` and ``pos``), or ``contact_events``.  Contacts are
    summed by position before they meet any window.  A residue counts once in a
    window: where it touches a position and none of the window before it, that is
    for the starts after its last contact on the chain.
    """
    place = ["structure_id", "chain"]
    # Positions with few gaps each, made of all contacts and read twice.
    events = contacts if "gap" in contacts.columns else cut_lineage(contact_events(contacts, positions))
    sizes = windows.groupBy(*place, "vis").agg(F.min("fstart").alias("_lo"), F.max("fstart").alias("_hi"))
    summed = events.groupBy(*place, "pos").agg(*[F.sum(c).alias(c) for c in "bkc"])
    zero = F.lit(0).cast("bigint")
    reach = F.least(F.coalesce("gap", "vis"), F.col("vis")).alias("reach")
    new = events.select(*place, "pos", "gap", "s")
    sites = new.join(sizes, place).groupBy(*place, "vis", "_lo", "_hi", "pos", reach).agg(F.sum("s").alias("s")).withColumns({c: zero for c in "bkc"})
    reached = summed.join(sizes, place).withColumns({"reach": F.col("vis"), "s": zero}).unionByName(sites)
    first, last = F.greatest(F.col("_lo"), F.col("pos") - F.col("reach") + 1), F.least("_hi", "pos")
    counted = reached.where(first <= last).withColumn("fstart", F.explode(F.sequence(first, last))).groupBy(*_WINDOW).agg(
        F.sum("b").alias("base_pos"), F.sum("k").alias("backbone_pos"), F.sum("c").alias("contact_pos"), F.sum("s").alias("site_pos"))
    return counted.where("contact_pos > 0").join(windows.select(*_WINDOW).distinct(), _WINDOW, "left_semi")


def _eligible(samples: DataFrame, chains: DataFrame) -> DataFrame:
    """Sample rows beside the length of the structure's longest chain, which
    decides between full and partial placement."""
    longest = chains.groupBy("structure_id").agg(F.max("chain_len").alias("longest"))
    return samples.join(longest, "structure_id")


_GATE = "(chain_len >= m) = (longest >= m)"
_WINDOW = ["structure_id", "chain", "vis", "fstart"]


def contact_candidates(
    samples: DataFrame, chains: DataFrame, scoring: DataFrame, positions: DataFrame,
    contacts: DataFrame, bad: DataFrame | None = None, skip_bad: bool = False,
    free: Column | None = None,
) -> DataFrame:
    """Every eligible candidate of every sample with its contact counts: blocks of samples beside the segments of their
    structure, which hold the counts of their windows (``w_i``: placements with contacts).

    ``samples``: sample_id, structure_id, motif_id; ``contacts``: as ``window_contacts`` takes them; ``bad``: structure_id, chain,
    pos of residues with missing atoms.  With ``skip_bad`` the candidates that
    touch one are dropped.  ``free``: on samples; those that need no contacts.
    """
    blocks, rows = _blocks(samples, chains, scoring, free)
    # Small beside the atoms, and read by every later step.
    rows = cut_lineage(rows)
    key = ["structure_id", "m", "chain", "seg_start"]
    # A chain inside its motif is one window, whatever the placement.
    each = F.explode(F.expr("sequence(0, if(is_full, n_place - 1, 0))"))
    places = rows.select(*key, "vis", "is_full", each.alias("i")).withColumn("fstart", F.expr("if(is_full, seg_start + i, 0)")).drop("is_full")
    # Samples with the same structure and motif length share their windows.
    counted = window_contacts(places.select(*_WINDOW).distinct(), positions, contacts)
    counts = ["base_pos", "backbone_pos", "contact_pos", "site_pos"]
    packed = places.join(counted, _WINDOW).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", *counts))).alias("_w"))
    lists = packed.select(*key, *[F.col(f"_w.{c}").alias(f"w_{c}") for c in ("i", *counts)])
    rows = rows.join(lists, key, "left")
    if skip_bad and bad is not None:
        spots = bad.select("structure_id", "chain", "pos").distinct()
        # A bad residue spoils the starts whose window covers it: an equi-join.
        sizes = places.select("structure_id", "chain", "vis").distinct()
        hit = spots.join(sizes, ["structure_id", "chain"]).withColumn(
            "fstart", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("vis") + 1).cast("int"), F.col("pos").cast("int")))).select(*_WINDOW).distinct()
        spoilt = places.join(hit, _WINDOW).groupBy(*key).agg(F.collect_list("i").alias("w_bad"))
        rows = rows.join(spoilt, key, "left")
    else:
        rows = rows.withColumn("w_bad", F.lit(None).cast("array<int>"))
    return _beside(blocks, cut_lineage(rows))


def _segment_key(rows: DataFrame) -> list[str]:
    return ["structure_id", "chain", *[c for c in ("cls",) if c in rows.columns], "seg_start"]


def _best_of_blocks(candidates: DataFrame, min_base: int, min_contact: int, min_site: int) -> DataFrame:
    """sample_id, structure_id, numbers of candidates and of those that pass, the best of these (``r``) and of all (``s``)."""
    none = F.lit(None).cast("array<bigint>")
    rows = candidates.withColumns({c: none for c in BLOCK_ARGS if c not in candidates.columns})
    own = ["structure_id", "m", "chain", "chain_ord", "chain_len", *_segment_key(rows)[2:], "is_full", "vis"]
    each = rows.select(*own, F.explode(F.arrays_zip(F.col("ids").alias("id"), constrained_best(min_base, min_contact, min_site, *BLOCK_ARGS).alias("_c"))).alias("_x"))
    each = each.select(*own, F.col("_x.id").alias("sample_id"), "_x._c.*").where("n > 0")
    start = "if(is_full and {rc}, chain_len - m - seg_start - {i}, if(is_full, seg_start + {i}, {i}))"
    order = "struct(is_full, round({raw}, 9), -chain_ord, not {rc}, -{start})"
    each = each.withColumn("start", F.expr(start.format(rc="reverse_complement", i="i"))).withColumn("any_start", F.expr(start.format(rc="any_reverse", i="any_i")))
    detail = F.struct("chain", *_segment_key(rows)[2:], "i", "start", "reverse_complement", "raw", "is_full", "m", "vis",
                      "base_pos", "backbone_pos", "contact_pos", "site_pos")
    found = F.col("n_ok") > 0
    return each.groupBy("sample_id", "structure_id").agg(
        F.sum("n").alias("candidate_count"), F.sum("n_ok").alias("contact_candidate_count"),
        F.max_by(F.when(found, detail), F.when(found, F.expr(order.format(raw="raw", rc="reverse_complement", start="start")))).alias("r"),
        F.max_by(F.struct("chain", F.col("any_start").alias("start"), F.col("any_reverse").alias("reverse_complement"), F.col("any_raw").alias("raw")),
                 F.expr(order.format(raw="any_raw", rc="any_reverse", start="any_start"))).alias("s"))


def align_contact_constrained(
    candidates: DataFrame, chains: DataFrame, min_base: int = 0, min_contact: int = 1, min_site: int = 1,
) -> DataFrame:
    """Best candidate that passes the contact minimums, or the failure text.  A sample that is free of them
    (``contact_candidates``) takes its best candidate as it is."""
    top = _best_of_blocks(candidates.drop("indices"), min_base, min_contact, min_site)
    text = F.format_string(
        "No PWM-DNA alignment candidate passed contact constraints. candidate_count=%d "
        f"min_contact_pairs={min_contact} min_site_residues={min_site} min_base_pairs={min_base} "
        "best_sequence_only=chain:%s start:%d rc:%s score:%.6f",
        F.col("candidate_count"), F.col("s.chain"), F.col("s.start"),
        F.when(F.col("s.reverse_complement"), "True").otherwise("False"), F.col("s.raw"))
    picked = top.select(
        "sample_id", "structure_id", "candidate_count", "contact_candidate_count", "r.*",
        F.when(F.col("contact_candidate_count") == 0, text).alias("error"))
    # Only the winners go back to their chain rows for the letters and indices.
    row = _segment_key(chains)
    letters = chains.select(*row, "sequence", "indices")
    return describe(picked.join(letters, row, "left")).drop("sequence", "indices", *row[2:-1]).withColumnRenamed("raw", "score")


def bad_residue_error(samples: DataFrame, chains: DataFrame, scoring: DataFrame, bad_backbone: DataFrame) -> DataFrame:
    """Samples whose eligible chains hold a residue without backbone atoms:
    sample_id, error naming the first one in candidate order.

    ``bad_backbone``: structure_id, chain, pos, residue_id.
    """
    whole = chains.select("structure_id", "chain", "chain_ord", "chain_len").distinct()
    # Only the first such residue of a chain can be named.
    bad_backbone = bad_backbone.groupBy("structure_id", "chain").agg(
        F.min_by("residue_id", "pos").alias("residue_id"))
    hit = (
        _eligible(samples, chains).join(scoring.select("motif_id", "m"), "motif_id")
        .join(bad_backbone.join(whole, ["structure_id", "chain"]), "structure_id")
        .where(_GATE)
    )
    first = hit.groupBy("sample_id").agg(F.min_by("residue_id", "chain_ord").alias("rid"))
    return first.select("sample_id", F.concat(
        F.lit("DNA residue "), F.col("rid"), F.lit(" has no backbone heavy atoms.")).alias("error"))


def bad_slot_error(placements: DataFrame, bad_backbone: DataFrame) -> DataFrame:
    """Samples with a slot on a residue without backbone atoms: sample_id, error naming the first one.

    ``placements``: sample_id, structure_id, slot_to_dna_index; ``bad_backbone``: structure_id, dna_idx, residue_id."""
    slots = placements.select("sample_id", "structure_id", F.posexplode("slot_to_dna_index").alias("slot", "dna_idx"))
    first = slots.join(bad_backbone, ["structure_id", "dna_idx"]).groupBy("sample_id").agg(F.min_by("residue_id", "slot").alias("rid"))
    return first.select("sample_id", F.concat(F.lit("DNA residue "), F.col("rid"), F.lit(" has no backbone heavy atoms.")).alias("error"))


# ------------------------------------------------------------- other policies
def manual_slots(samples: DataFrame) -> DataFrame:
    """Explicit placements.  ``samples``: sample_id, m, manual_index (text),
    manual_start (INT) -> slot_to_dna_index, alignment_mode, start, error."""
    text = F.trim(F.coalesce("manual_index", F.lit("")))
    given = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint"))
    by_start = F.when(F.col("manual_start").isNotNull() & (F.col("m") > 0), F.sequence(
        F.col("manual_start").cast("bigint"), F.col("manual_start").cast("bigint") + F.col("m") - 1))
    has_text = text != ""
    return samples.select(
        "*",
        F.when(has_text, given).otherwise(by_start).alias("slot_to_dna_index"),
        F.when(has_text, "manual_slot_to_dna_index")
        .when(F.col("manual_start").isNotNull(), "manual_dna_start_index").alias("alignment_mode"),
        F.when(has_text, F.lit(-1)).otherwise(F.col("manual_start")).alias("start"),
        F.when(has_text & F.exists(given, lambda x: x.isNull()), F.lit("index list holds a value that is no integer"))
        .when(has_text & (F.size(given) != F.col("m")), F.format_string(
            "--slot-to-dna-index length %d != PWM length %d.", F.size(given), F.col("m"))).alias("error"),
    )


def slot_error(slots: Column, n_dna: Column) -> Column:
    """NULL when the slot list is usable."""
    seen = F.filter(slots, lambda x: x >= 0)
    return (
        F.when(F.size(slots) <= 0, "slot_to_dna_index is empty.")
        .when(F.size(seen) == 0, "slot_to_dna_index has no visible DNA residues.")
        .when(F.array_max(seen) >= n_dna, F.concat(
            F.lit("slot_to_dna_index out of range for selected DNA residues: 0.."),
            (n_dna - 1).cast("string"), F.lit("."))))


def validate_slots(placements: DataFrame) -> DataFrame:
    """``placements``: slot_to_dna_index, n_dna -> adds ``slot_error``."""
    return placements.withColumn("slot_error", slot_error(F.col("slot_to_dna_index"), F.col("n_dna")))


META = ["alignment_mode", "alignment_score_mode", "alignment_chain", "alignment_start",
        "alignment_reverse_complement", "alignment_score", "alignment_sequence",
        "alignment_candidate_count", "alignment_contact_candidate_count"]


def _meta(mode: Column, score_mode: Column, chain: Column, start: Column, rc: Column, score: Column,
          seq: Column, n: Column, n_ok: Column) -> list[Column]:
    return [mode.alias(META[0]), score_mode.alias(META[1]), chain.alias(META[2]), start.cast("bigint").alias(META[3]),
            rc.alias(META[4]), score.cast("double").alias(META[5]), seq.alias(META[6]),
            n.cast("bigint").alias(META[7]), n_ok.cast("bigint").alias(META[8])]


def metadata_sequence(aligned: DataFrame, score_mode: str) -> DataFrame:
    mode = F.when(F.col("is_full"), "auto_pwm_dna").otherwise("partial_auto_pwm_dna")
    zero = F.lit(0)
    return aligned.select("sample_id", "slot_to_dna_index", *_meta(
        mode, F.lit(score_mode), F.col("chain"), F.col("start"), F.col("reverse_complement"), F.col("score"),
        F.col("aligned_sequence"), zero, zero))


def metadata_contact(aligned: DataFrame, score_mode: str) -> DataFrame:
    ok = aligned.where(F.col("error").isNull())
    mode = F.when(F.col("is_full"), "contact_constrained_pwm_dna").otherwise("partial_contact_constrained_pwm_dna")
    return ok.select("sample_id", "slot_to_dna_index", *_meta(
        mode, F.lit(score_mode), F.col("chain"), F.col("start"), F.col("reverse_complement"), F.col("score"),
        F.col("aligned_sequence"), F.col("candidate_count"), F.col("contact_candidate_count")))


def metadata_manual(manual: DataFrame) -> DataFrame:
    """Explicit placements; a faulty one stays, without slots, so that no automatic
    placement takes its place (``manual_errors`` has the reasons)."""
    ok = manual.where(F.col("alignment_mode").isNotNull()).withColumn(
        "slot_to_dna_index", F.when(F.col("error").isNull(), F.col("slot_to_dna_index")))
    zero = F.lit(0)
    return ok.select("sample_id", "slot_to_dna_index", *_meta(
        F.col("alignment_mode"), F.lit("manual"), F.lit(""), F.col("start"), F.lit(False), F.lit(None),
        F.lit(""), zero, zero))


def manual_errors(manual: DataFrame) -> DataFrame:
    """sample_id, error of faulty explicit placements."""
    return manual.where("error IS NOT NULL").select("sample_id", "error")


def alignment_policy(
    samples: DataFrame, manual: DataFrame, sequence_only: DataFrame, contact: DataFrame
) -> DataFrame:
    """Manual list or start first, also when it is faulty, then the sample's ``policy``.

    ``samples``: sample_id, policy; the other inputs are ``metadata_*`` tables.
    """
    chosen = samples.join(manual.select("sample_id"), "sample_id", "left_anti")
    by_seq = sequence_only.join(chosen.where("policy = 'sequence_only'").select("sample_id"), "sample_id", "left_semi")
    by_contact = contact.join(chosen.where("policy <> 'sequence_only'").select("sample_id"), "sample_id", "left_semi")
    return manual.join(samples.select("sample_id"), "sample_id", "left_semi").unionByName(by_seq).unionByName(by_contact)
