"""Selection and projection on atom tables.

An atom table has ``structure_id, atom_ord, record, name, resname, chain, resseq,
icode, x, y, z, element``.  A residue is the four-part key (chain, resseq, icode,
resname) inside a structure; its order is the ordinal of its first atom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.constants import (
    AMINO_ACIDS,
    AMINO_ORDER,
    BACKBONE_ATOMS,
    DNA_RESIDUES,
    EMBEDDING_WIDTH,
    lookup,
)
from helixframe.operators.ordering import dense_index

RESIDUE_KEY = ["structure_id", "chain", "resseq", "icode", "resname"]


# ------------------------------------------------------------ column predicates
def is_heavy() -> Column:
    return (F.upper("element") != "H") & ~F.upper("name").startswith("H")


def is_backbone() -> Column:
    return F.upper(F.trim("name")).isin(BACKBONE_ATOMS)


def residue_kind(resname: str = "resname") -> Column:
    r = F.col(resname)
    return (
        F.when(r.isin(list(AMINO_ACIDS)), "protein")
        .when(r.isin(list(DNA_RESIDUES)), "dna")
        .otherwise("other")
    )


def one_letter(resname: str = "resname") -> Column:
    return F.coalesce(lookup(AMINO_ACIDS, F.col(resname)), lookup(DNA_RESIDUES, F.col(resname)))


def parse_chain_list(text: str) -> Column:
    """``'A, B'`` -> ['A','B']; a blank item is chain ``_``; blank text -> NULL."""
    t = F.col(text)
    items = F.transform(F.split(t, ","), lambda x: F.when(F.trim(x) == "", "_").otherwise(F.trim(x)))
    return F.when(t.isNotNull() & (F.trim(t) != ""), F.array_distinct(items))


def residue_id() -> Column:
    return F.concat("chain", F.lit(":"), F.col("resseq").cast("string"), "icode")


# ------------------------------------------------------------------- operators
def infer_element(atoms: DataFrame) -> DataFrame:
    """Fill a blank element from the atom name."""
    name = F.trim("name")
    guess = F.when(name.rlike("^[0-9]."), F.substring(name, 2, 1)).otherwise(F.substring(name, 1, 1))
    blank = F.trim(F.coalesce("element", F.lit(""))) == ""
    return atoms.withColumn(
        "element", F.when(blank, F.upper(guess)).otherwise(F.upper(F.trim("element"))))


def residue_table(atoms: DataFrame) -> DataFrame:
    """One row per residue: key, ``res_ord``, ``n_atoms``, ``kind``."""
    return atoms.groupBy(*RESIDUE_KEY).agg(
        F.min("atom_ord").alias("res_ord"), F.count(F.lit(1)).alias("n_atoms"),
    ).withColumn("kind", residue_kind())


def group_residues(atoms: DataFrame) -> DataFrame:
    """Residues with their dense index ``res_idx`` in order of first appearance."""
    return dense_index(residue_table(atoms), ["structure_id"], "res_ord", "res_idx")


def index_kinds(residues: DataFrame) -> DataFrame:
    """Protein and DNA residues with ``sel_idx`` counted apart: one pass for both
    selections when there is no chain restriction."""
    return dense_index(residues.where(F.col("kind") != "other"), ["structure_id", "kind"], "res_ord", "sel_idx")


def classify_residues(residues: DataFrame) -> DataFrame:
    return residues.withColumn("kind", residue_kind())


def select_residues(
    residues: DataFrame, kind: str, chains: DataFrame | None = None
) -> DataFrame:
    """Residues of one kind, re-indexed (``sel_idx``) in file order.

    ``chains``: optional (structure_id, chains ARRAY); NULL or no row = all.
    """
    picked = residues.where(residue_kind() == kind)
    if chains is not None:
        picked = picked.join(chains, "structure_id", "left").where(
            F.col("chains").isNull() | F.array_contains("chains", F.col("chain"))
        ).drop("chains")
    return dense_index(picked, ["structure_id"], "res_ord", "sel_idx")


def _sequences(selected: DataFrame, keys: list[str]) -> DataFrame:
    """One-letter string and the index of every letter, one row per key."""
    return selected.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("sel_idx", one_letter().alias("letter")))).alias("_l")).select(
        *keys, F.array_join(F.col("_l.letter"), "").alias("sequence"), F.col("_l.sel_idx").alias("indices"))


def residue_sequence(selected: DataFrame) -> DataFrame:
    """One-letter sequence of the selected residues of each structure."""
    return _sequences(selected, ["structure_id"])


def dna_chain_sequences(selected_dna: DataFrame) -> DataFrame:
    """Per DNA chain: base string, indices of its residues, chain order."""
    return _sequences(selected_dna, ["structure_id", "chain"]).withColumn("chain_ord", F.get("indices", F.lit(0)))


def heavy_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where(is_heavy())


def split_base_backbone(atoms: DataFrame) -> DataFrame:
    """DNA heavy atoms with ``part`` = base or backbone."""
    return atoms.where(is_heavy() & (residue_kind() == "dna")).withColumn(
        "part", F.when(is_backbone(), "backbone").otherwise("base"))


def ca_or_centroid(atoms: DataFrame) -> DataFrame:
    """One point per residue: its first CA, else the mean of its heavy atoms."""
    ca = F.col("name") == "CA"
    axes = ["x", "y", "z"]
    agg = [F.min("atom_ord").alias("res_ord")]
    for a in axes:
        agg.append(F.expr(f"min_by({a}, atom_ord) FILTER (WHERE name = 'CA')").alias(f"ca_{a}"))
        agg.append(F.avg(F.when(is_heavy(), F.col(a))).alias(f"mean_{a}"))
    agg.append(F.max(ca).alias("has_ca"))
    return atoms.groupBy(*RESIDUE_KEY).agg(*agg).select(
        *RESIDUE_KEY, "res_ord", "has_ca",
        *[F.coalesce(f"ca_{a}", f"mean_{a}").alias(a) for a in axes])


def residue_profile(atoms: DataFrame) -> DataFrame:
    """Everything the batch needs about residues from one pass over the atoms: the
    key, ``res_ord``, ``kind``, heavy atom counts, the representative point and the first ``parse_error``."""
    unread = F.col("parse_error") if "parse_error" in atoms.columns else F.lit(None).cast("string")
    agg = [
        F.min(unread).alias("parse_error"),
        F.min("atom_ord").alias("res_ord"),
        F.count_if(is_heavy()).alias("n_heavy"),
        F.count_if(is_heavy() & ~is_backbone()).alias("n_base"),
        F.count_if(is_heavy() & is_backbone()).alias("n_backbone"),
    ]
    for a in ("x", "y", "z"):
        agg.append(F.expr(f"min_by({a}, atom_ord) FILTER (WHERE name = 'CA')").alias(f"ca_{a}"))
        agg.append(F.avg(F.when(is_heavy(), F.col(a))).alias(f"mean_{a}"))
    return atoms.groupBy(*RESIDUE_KEY).agg(*agg).select(
        *RESIDUE_KEY, "res_ord", residue_kind().alias("kind"), "n_heavy", "n_base", "n_backbone", "parse_error",
        *[F.coalesce(f"ca_{a}", f"mean_{a}").alias(a) for a in ("x", "y", "z")])


def missing_atom_audit(atoms: DataFrame) -> DataFrame:
    """Residues without heavy atoms, and DNA residues without base or backbone."""
    kind = residue_kind()
    counts = atoms.where(kind != "other").groupBy(*RESIDUE_KEY, kind.alias("kind")).agg(
        F.min("atom_ord").alias("res_ord"),
        F.count_if(is_heavy()).alias("n_heavy"),
        F.count_if(is_heavy() & ~is_backbone()).alias("n_base"),
        F.count_if(is_heavy() & is_backbone()).alias("n_backbone"),
    )
    dna = F.col("kind") == "dna"
    return counts.withColumn(
        "missing",
        F.when(F.col("n_heavy") == 0, "heavy")
        .when(dna & (F.col("n_base") == 0), "base")
        .when(dna & (F.col("n_backbone") == 0), "backbone"),
    ).where(F.col("missing").isNotNull())


def monomer_guard(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """Structure ids accepted as protein-only input: no DNA residue in them."""
    with_dna = atoms.where(residue_kind() == "dna").select("structure_id").distinct()
    return structures.join(with_dna, "structure_id", "left_anti")


def encode_residues(selected_protein: DataFrame) -> DataFrame:
    """``aa_idx`` in the fixed alphabet order and its one-hot vector."""
    idx = F.instr(F.lit(AMINO_ORDER), one_letter()) - 1
    hot = F.transform(F.sequence(F.lit(0), F.lit(19)),
                      lambda k: F.when(k == F.col("aa_idx"), 1).otherwise(0))
    return selected_protein.withColumn("aa_idx", idx.cast("int")).withColumn("one_hot", hot)


def join_embeddings(
    selected: DataFrame, vectors: DataFrame, width: int = EMBEDDING_WIDTH
) -> DataFrame:
    """Attach ``vector`` by (structure_id, sel_idx) with an error column.

    ``vec_error``: NULL when the residue has exactly one vector of ``width``.
    """
    got = vectors.groupBy("structure_id", "sel_idx").agg(
        F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("_n"))
    out = selected.join(got, ["structure_id", "sel_idx"], "left")
    return out.withColumn(
        "vec_error",
        F.when(F.col("vector").isNull(), "missing vector")
        .when(F.col("_n") != 1, F.format_string("%d vectors", "_n"))
        .when(F.size("vector") != width, F.format_string("width %d", F.size("vector"))),
    ).drop("_n")


def keyed_atoms(atoms: DataFrame) -> DataFrame:
    """Heavy atoms of protein and DNA with ``kind``, ``part`` and, as ``res_ord``, their residue's key, which needs no shuffle."""
    kind = residue_kind()
    return atoms.where(is_heavy() & (kind != "other")).select(
        "structure_id", F.struct(*RESIDUE_KEY[1:]).alias("res_ord"), "x", "y", "z", kind.alias("kind"),
        F.when(kind == "dna", F.when(is_backbone(), "backbone").otherwise("base")).alias("part"))


def tag_atoms(atoms: DataFrame) -> DataFrame:
    """Every atom with ``res_ord``, ``kind`` and ``part`` (heavy atoms only)."""
    w = Window.partitionBy(*RESIDUE_KEY)
    return (
        atoms.withColumn("res_ord", F.min("atom_ord").over(w))
        .where(is_heavy())
        .withColumn("kind", residue_kind())
        .withColumn("part", F.when(F.col("kind") == "dna", F.when(is_backbone(), "backbone").otherwise("base")))
    )
