"""Structure files as atom tables.

Parsers take line or text tables with a ``structure_id``, so that they run on files
and on text already in a DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.structure import infer_element
from helixframe.sources.text import number_lines, read_whole

ATOM_COLUMNS = ["structure_id", "atom_ord", "record", "name", "resname", "chain", "resseq", "icode", "x", "y", "z", "element"]


def _cut(start: int, end: int) -> Column:
    """Columns start..end of the line, 1-based and inclusive."""
    return F.substring("value", start, end - start + 1)


def scan_pdb_atoms(lines: DataFrame) -> DataFrame:
    """structure_id, line_no, value -> atoms.  All models are kept; alternate
    locations other than blank and A are dropped; a blank chain is ``_``.

    ``parse_error`` marks atom lines whose numbers cannot be read.
    """
    keep = lines.where(_cut(1, 6).isin("ATOM  ", "HETATM") & F.trim(_cut(17, 17)).isin("", "A"))
    number = lambda a, b, t: F.trim(_cut(a, b)).try_cast(t)
    chain = F.trim(_cut(22, 22))
    atoms = keep.select(
        "structure_id", F.col("line_no").cast("bigint").alias("atom_ord"), F.trim(_cut(1, 6)).alias("record"),
        F.trim(_cut(13, 16)).alias("name"), F.upper(F.trim(_cut(18, 20))).alias("resname"),
        F.when(chain == "", "_").otherwise(chain).alias("chain"), number(23, 26, "int").alias("resseq"),
        F.trim(_cut(27, 27)).alias("icode"), number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"),
        number(47, 54, "double").alias("z"),
        F.when(F.length("value") >= 78, F.upper(F.trim(_cut(77, 78)))).otherwise("").alias("element"))
    bad = F.greatest(*[F.col(c).isNull() for c in ("resseq", "x", "y", "z")])
    return infer_element(atoms).withColumn("parse_error", F.when(bad, "unreadable atom line"))


# A token, with quoted parts that may hold blanks; outside quotes, # starts a comment.
# Possessive repeats throughout: others take a stack frame for each round, and a long token would end the JVM.
_TOKEN = r"""((?:"[^"\n]*+"|'[^'\n]*+'|[^\s"'#]++)++)|#[^\n]*+"""
_QUOTED = r""""([^"]*)"|'([^']*)'"""
_TEXT_BLOCK = r"(?ms)^;.*?(?:\n;[^\n]*|\z)"
# What ends the rows of a loop: a tag or a data block at the start of a line.
_LOOP_END = r"(?m)^[ \t]*+(?:_|data_)"

SITE_TAGS = [
    "group_PDB", "label_alt_id", "auth_atom_id", "label_atom_id", "auth_comp_id", "label_comp_id", "auth_asym_id",
    "label_asym_id", "auth_seq_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "type_symbol",
]


def _tokens(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), lambda t: t != "")
    quoted = lambda t: t.contains('"') | t.contains("'")
    return F.transform(found, lambda t: F.when(quoted(t), F.regexp_replace(t, _QUOTED, "$1$2")).otherwise(t))


def scan_mmcif_atoms(texts: DataFrame) -> DataFrame:
    """structure_id, text -> atoms from the ``_atom_site`` loops.

    A file is one text value, hence bounded, and is cut where it lies: into loops, a loop
    into its tags and its tokens, the tokens into rows of as many as there are tags, so a
    row may span or share lines.  A loop goes on to the next ``loop_``, ``data_`` or single
    tag; multi-line text blocks become one token.  ``atom_ord`` is the loop's number in
    the upper bits and the row number in the lower 32.
    """
    text = F.regexp_replace("text", _TEXT_BLOCK, '"text block"')
    loops = texts.select("structure_id", F.posexplode(F.split(text, r"(?m)^[ \t]*+loop_(?=\s)")).alias("section", "loop")).where(
        (F.col("section") > 0) & F.col("loop").rlike(r"^(?:\s++|#[^\n]*+\n)*+_atom_site\."))
    # The header is all that comes before the first line that begins otherwise.
    body_at = F.regexp_instr("loop", F.lit(r"(?m)^[ \t]*+[^_\s#]"))
    cut = loops.select("structure_id", "section", *[
        F.when(body_at > 0, part).otherwise(rest).alias(name) for name, part, rest in (
            ("head", F.substring("loop", F.lit(1), body_at - 1), F.col("loop")),
            ("body", F.substring(F.col("loop"), body_at, F.length("loop")), F.lit("")))])
    parts = cut.select("structure_id", "section", _tokens(F.col("head")).alias("tags"), _tokens(F.get(F.split("body", _LOOP_END, 2), F.lit(0))).alias("tokens"))
    site = parts.where(F.forall("tags", lambda x: x.startswith("_atom_site.")) & (F.size("tokens") >= F.size("tags")))
    width = F.size("tags")
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / width).cast("int") - 1), lambda i: F.slice(F.col("tokens"), i * width + 1, width))
    return _site_atoms(site.select("structure_id", "section", "tags", F.posexplode_outer(rows).alias("n", "row")).select(
        "structure_id", (F.col("section") * F.lit(1 << 32) + F.col("n")).alias("atom_ord"), "tags", "row"))


def _site_atoms(rows: DataFrame) -> DataFrame:
    # Tag values first, as plain columns; an absent tag has position 0 and so NULL.
    located = rows.select("structure_id", "atom_ord", *[
        F.get("row", F.array_position("tags", f"_atom_site.{t}").cast("int") - 1).alias(t) for t in SITE_TAGS])
    cleaned = located.select("structure_id", "atom_ord", *[
        F.when(~F.col(t).isin(".", "?", ""), F.col(t)).alias(t) for t in SITE_TAGS])

    def value(tag: str) -> Column:
        return F.coalesce(tag, F.lit(""))

    def first(*names: str) -> Column:
        return F.coalesce(*names, F.lit(""))

    group = F.upper(value("group_PDB"))
    chain = first("auth_asym_id", "label_asym_id")
    seq = first("auth_seq_id", "label_seq_id").try_cast("double")
    out = cleaned.where(group.isin("ATOM", "HETATM") & value("label_alt_id").isin("", "A")).select(
        "structure_id", F.col("atom_ord").cast("bigint").alias("atom_ord"), group.alias("record"),
        first("auth_atom_id", "label_atom_id").alias("name"), F.upper(first("auth_comp_id", "label_comp_id")).alias("resname"),
        F.when(chain == "", "_").otherwise(chain).alias("chain"), seq.try_cast("int").alias("resseq"),
        value("pdbx_PDB_ins_code").alias("icode"), value("Cartn_x").try_cast("double").alias("x"),
        value("Cartn_y").try_cast("double").alias("y"), value("Cartn_z").try_cast("double").alias("z"),
        F.upper(value("type_symbol")).alias("element"))
    usable = out.where("resseq IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return infer_element(usable)


def scan_structure_texts(texts: DataFrame) -> DataFrame:
    """structure_id, path, text: parser chosen by the suffix of ``path``."""
    cif = F.lower("path").rlike(r"\.(cif|mmcif)$")
    a = scan_mmcif_atoms(texts.where(cif).select("structure_id", "text"))
    b = scan_pdb_atoms(number_lines(texts.where(~cif).select("structure_id", "text")))
    return a.withColumn("parse_error", F.lit(None).cast("string")).unionByName(b)


def read_structures(spark: SparkSession, *paths: str) -> DataFrame:
    """Atom table of structure files; structure_id = file stem."""
    whole = read_whole(spark, *paths)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return scan_structure_texts(whole.withColumn("structure_id", stem))
