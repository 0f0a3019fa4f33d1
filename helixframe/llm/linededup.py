"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are near if one edit of a character (insert, delete, replace) turns one into the other. Near lines agree
in a variant with one character deleted, or one is a variant of the other. Two facts keep the join small without
losing a pair: near lines share their first or their last half, so variants are emitted only for lines that share
a half with another line; and variants are made inside blocks of ``BLOCK`` characters, so a long line costs no
more a character than a short one. Groups of equal variants are folded to their earliest line by partial
aggregation, never to pairs. The edit distance is checked on the lines themselves.

A line is dropped if an equal or near line comes earlier, in the order of document id and place in the document.
Equal lines are found at every length; near ones among lines of ``MIN_CHARS`` code points or more. Blank lines (white
space alone) shorter than that are spacing and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, small_enough, stored, table, text_key

#: Code points of the shortest line with near lines (equal lines have no minimum), and of a block of variants.
MIN_CHARS, BLOCK = 40, 256


def _place() -> Column:
    """The order of lines: documents by id (without id last) and key, then the line's place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "at")


def _id(line: Column) -> list[Column]:
    """A line's 128-bit name."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")]


def _lines(rows: DataFrame, text: str = "text", least: int | None = None) -> DataFrame:
    """(doc_id, key, at, line) of lines that can be dropped."""
    split = rows.select("doc_id", "key", F.posexplode_outer(F.split(text, "\n")).alias("at", "line"))
    return split.where(F.length("line") >= least if least else (F.length("line") >= MIN_CHARS) | F.col("line").rlike(WORD))


def _halves(line: Column, n: Column) -> Column:
    """(last, h): names of a line's first and last halves, of its own half length and of that of a line shorter by one."""
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    named = lambda last, size, part: F.struct(F.lit(last).alias("last"), F.xxhash64(F.lit(last), size, part).alias("h"))
    every = [named(False, h, F.left(line, h)) for h in (half, less)] + [named(True, h, F.right(line, h)) for h in (half, less)]
    return F.array_distinct(F.array(*every))


def _variants(block: int) -> Column:
    """Deletion neighbourhood of ``line``, places ``lo`` to ``hi``: (kind, v) for each key.

    Kind 2: a character deleted, with its place. Kind 1: the same without the place. Kind 0: the line itself, as
    kind 1 of a line with one character more would give it. What stands before and after the block is hashed once."""
    line, n = F.col("line"), F.col("n")

    def of_block(b: Column) -> Column:
        return F.struct(
            b.alias("b"), F.substring(line, b * block + 1, F.lit(block)).alias("own"),
            F.xxhash64(F.left(line, b * block)).alias("head"), F.xxhash64(F.substring(line, (b + 1) * block + 1, n)).alias("tail"),
            F.xxhash64(F.substring(line, b * block + block, n)).alias("rest"))

    key = lambda kind, x, i, middle, after: F.struct(F.lit(kind).alias("kind"), F.xxhash64(i, x.b, x.head, middle, after).alias("v"))
    hashed = lambda part: F.xxhash64(part)
    no = F.lit(0)

    def keys(x: Column) -> Column:
        whole = key(0, x, no, hashed(F.left(x.own, F.lit(block - 1))), x.rest)
        first, last = F.greatest(F.lit(1), F.col("lo") - x.b * block), F.least(F.length(x.own), F.col("hi") - x.b * block)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        cut = F.transform(places, lambda i: F.struct(i.alias("i"), hashed(F.concat(F.left(x.own, i - 1), F.substring(x.own, i + 1, F.lit(block)))).alias("m")))
        both = F.flatten(F.transform(cut, lambda c: F.array(key(2, x, c.i, c.m, x.tail), key(1, x, no, c.m, x.tail))))
        return F.concat(F.array(whole), both)

    return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), of_block), keys))


def near_lines(rows: DataFrame, block: int = BLOCK, least: int | None = None) -> DataFrame:
    """(a, b, first): for each distinct line that may lose an occurrence, the earliest place of an equal or near line.

    ``rows`` has doc_id, key and text; ``least`` as in ``dedup_lines``."""
    lines = _lines(rows, least=least).withColumn("n", F.length("line"))
    long = F.col("n") >= (least or MIN_CHARS)
    tag = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("x"), b.alias("y"))
    a, b = _id(F.col("line"))
    both = lines.select("doc_id", "key", "at", a, b, F.when(long, _halves(F.col("line"), F.col("n"))).alias("hs"))
    every = F.concat(F.array(tag(0, F.col("a"), F.col("b"))), F.coalesce(F.transform("hs", lambda s: tag(1, s.h, F.lit(0).cast("bigint"))), F.array().cast("array<struct<kind int, x bigint, y bigint>>")))
    spread = both.select(_place().alias("place"), "a", F.explode_outer(every).alias("tag")).select("tag.*", "a", F.when(F.col("tag.kind") == 0, F.col("place")).alias("place"))
    groups = spread.groupBy("kind", "x", "y").agg(F.min("place").alias("first"), F.count("*").alias("times"), F.min("a").alias("least"), F.max("a").alias("most"))
    groups = stored(groups.where("times > 1 AND (kind = 0 OR least <> most)"))
    equal = groups.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "first")
    shared = small_enough(stored(groups.where("kind = 1").select(F.col("x").alias("h"))))
    some = lines.where(long).select("doc_id", "key", "at", "line", "n", F.explode_outer(_halves(F.col("line"), F.col("n"))).alias("half"))
    some = some.select("doc_id", "key", "at", "line", "n", "half.*").join(shared, "h", "left_semi")
    some = some.groupBy(*_id(F.col("line"))).agg(F.min(F.struct(_place().alias("place"), "line", "n")).alias("own"), F.bool_or("last").alias("last"), F.bool_or(~F.col("last")).alias("head"))
    # Lines that share only their first half differ behind it, those that share only their last half before it.
    half = F.floor((F.col("own.n") - 1) / 2).cast("int")
    some = some.select("a", "b", "own.*", F.when(F.col("last"), 1).otherwise(half).alias("lo"), F.when(F.col("head"), F.col("own.n")).otherwise(F.col("own.n") - half + 1).alias("hi"))
    some = stored(some)
    # Keys that different lines share, then all that is needed of those few.
    light = some.select("a", F.explode_outer(F.transform(_variants(block), lambda k: F.xxhash64(k.kind == 2, k.v))).alias("v"))
    meet = light.groupBy("v").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("v")
    meet = small_enough(stored(meet))
    keys = some.select("a", "b", "place", F.explode_outer(_variants(block)).alias("key"))
    keys = stored(keys.select("a", "b", "place", "key.kind", F.xxhash64(F.col("key.kind") == 2, F.col("key.v")).alias("v")).join(meet, "v", "left_semi").distinct())
    member = F.struct("place", "a", "b")
    # Kind 2: all that share the variant and the place of the deletion are near each other. Kinds 0 and 1: a line and
    # those with one character more are near; the longer ones among themselves need not be.
    folded = keys.groupBy("v").agg(F.min(F.when(F.col("kind") > 0, member)).alias("longer"), F.min(F.when(F.col("kind") == 0, member)).alias("shorter"))
    partner = F.when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = keys.join(folded, "v").withColumn("partner", partner).where("partner.place < place")
    pairs = pairs.select("a", "b", F.col("partner.a").alias("pa"), F.col("partner.b").alias("pb"), F.col("partner.place").alias("first")).distinct()
    text = some.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("line").alias("other"))
    close = pairs.join(some.select("a", "b", "line"), ["a", "b"]).join(text, ["pa", "pb"]).where(F.expr("levenshtein(line, other, 1) BETWEEN 0 AND 1"))
    return equal.unionByName(close.select("a", "b", "first")).groupBy("a", "b").agg(F.min("first").alias("first"))


def dedup_lines(docs: DataFrame, block: int = BLOCK, least: int | None = None) -> DataFrame:
    """(row, text, n_lines, n_dropped): the input row as a struct and its text less the dropped lines.

    A row for each input row. NULL text stays NULL with 0 lines, an empty text has one line that stays. Rows that
    share id and text are one document: they lose the same lines. An empty table gives an empty table; columns of
    any name pass inside ``row``. With ``least`` all lines shorter than that stay, and it is the minimum of near
    lines too; without it equal lines that are not blank have no minimum."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    known = stored(near_lines(rows.select("doc_id", "key", "text"), block, least))
    each = _lines(rows, least=least).select("doc_id", "key", "at", *_id(F.col("line"))).join(small_enough(known), ["a", "b"])
    lost = each.where(_place() > F.col("first")).groupBy("key").agg(F.collect_set("at").alias("lost"))
    out = rows.join(small_enough(stored(lost), items="lost"), "key", "left").withColumn("lines", F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"), lambda i: F.get("lines", i))
    new = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    return out.select("row", new.alias("text"), count("lines").alias("n_lines"), count("lost").alias("n_dropped"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines; n_chars is counted anew where lines went.

    A document of which nothing but white space is left goes; one that was so before stays."""
    size = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": size}
    left = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n\t", "  ")) != ""))
    return left.select(*(new.get(x, F.col("row")[x]).alias(x) for x in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


#: Equal lines of every length but short blank ones, and near lines by brute force over lines of nearly equal length
#: that share a half.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, line, length(line) AS n, length(line) >= 40 AS long, length(line) >= 40 OR regexp_matches(line, '[^\x20\x09-\x0D]') AS counts
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
u AS (SELECT line, n, long, min((doc_id, pos)) AS place FROM l WHERE counts GROUP BY ALL),
h AS (
  SELECT DISTINCT line, n, place, half FROM (
    SELECT *, 'f' || line[1:(n // 2)] AS half FROM u WHERE long UNION ALL SELECT *, 'f' || line[1:((n - 1) // 2)] FROM u WHERE long
    UNION ALL SELECT *, 'l' || right(line, n // 2) FROM u WHERE long UNION ALL SELECT *, 'l' || right(line, (n - 1) // 2) FROM u WHERE long)),
p AS (SELECT DISTINCT x.line, y.line AS other, y.place FROM h x JOIN h y ON x.half = y.half AND y.place < x.place AND abs(x.n - y.n) <= 1),
f AS (
  SELECT line, min(place) AS place FROM (
    SELECT line, place FROM u UNION ALL SELECT line, place FROM p WHERE levenshtein(line, other) <= 1) GROUP BY 1),
d AS (SELECT l.doc_id, l.pos, l.line, f.place IS NOT NULL AND (l.doc_id, l.pos) > f.place AS gone FROM l LEFT JOIN f ON l.line = f.line AND l.counts)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM d GROUP BY 1
"""
