"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Windows of item words (13, or a whole shorter item) are the sets to contain; their tokens are word shingles. All
occurrences of item shingles in the documents are found by one equi-join, which also gives each shingle's
frequency in the whole corpus. In the order of rarity a window that must be contained whole needs a prefix of one
token: its rarest shingle. Occurrences of that token are candidates; the token's place in the window fixes where
the window would begin, and the bounds of the document cut those that do not fit. What is left is compared word
for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, small_enough, stored, table, text_key

#: Words in a window, and in a shingle of it at most.
WINDOW, SHINGLE = 13, 5
#: Everything that is not a digit, a lower-case letter or beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of k consecutive words, by position."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *(F.get(words, i + j) for j in range(1, k))))
    return F.slice(hashes, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, size) of the distinct windows, and (wid, item_id) pairs. Items without words or id have none."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", item_words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(window), F.size("w"))
    each = items.withColumn("size", size).select("item_id", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    each = each.select("item_id", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("words")).distinct()
    known = stored(each.select("words", "size").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return known, stored(each.join(known, ["words", "size"]).select("wid", "item_id"))


def contained(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key (id and text), n_words, n_hit and items (sorted ids as strings).

    A word is hit if it lies inside any occurrence of an item window; each word counts once. NULL and empty texts
    have no words; items that are NULL, empty or without an id are never found; repeated rows give repeated rows;
    an item id that occurs on several rows counts once. Extra columns are not read."""
    known, owners = item_windows(benchmark, window)
    k = F.least(F.lit(shingle), F.col("size"))
    lengths = sorted(r[0] for r in known.select(k.alias("k")).distinct().collect())  # at most ``shingle`` values
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    parts = []
    for n in lengths:
        of = known.where(k == n).select("wid", "size", F.posexplode(_shingles(F.split("words", " "), n)).alias("offset", "h"))
        parts.append(of)
    if not parts:
        none = F.lit(0).cast("bigint")
        return rows.select("doc_id", "key", F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"), none.alias("n_hit"), F.array().cast("array<string>").alias("items"))
    tokens = parts[0]
    for of in parts[1:]:
        tokens = tokens.unionByName(of)
    tokens = stored(tokens)
    wanted = small_enough(stored(tokens.select("h").distinct()))
    held = rows.select("key", item_words(F.col("text")).alias("w"))
    found = None
    for n in lengths:  # outer: an inferred filter would compute all shingles a second time
        at = held.select("key", F.size("w").alias("n"), _shingles(F.col("w"), n).alias("hs")).select("key", "n", F.posexplode_outer("hs").alias("at", "h")).join(wanted, "h")
        found = at if found is None else found.unionByName(at)
    found = stored(found)
    # Rarity over the whole corpus; a window with a token that never occurs cannot occur.
    rarity = found.groupBy("h").agg(F.count("*").alias("df"))
    order = tokens.join(rarity, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = order.groupBy("wid", "size").agg(F.min(F.struct("df", "h", "offset")).alias("rarest")).where("rarest.df > 0")
    prefix = small_enough(stored(prefix.select("wid", "size", "rarest.h", "rarest.offset")))
    fits = found.join(prefix, "h").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0 AND start + size <= n")
    candidates = small_enough(stored(fits.groupBy("key").agg(F.collect_set(F.struct("start", "wid", "size")).alias("places"))), items="places")
    placed = rows.join(candidates, "key", "left").withColumn("w", item_words(F.col("text")))
    parts_of = F.transform("places", lambda p: F.struct(p.start.alias("start"), p.wid.alias("wid"), p.size.alias("size"), F.array_join(F.slice(F.col("w"), p.start + 1, p.size), " ").alias("words")))
    base = stored(placed.select("doc_id", "key", F.size("w").cast("bigint").alias("n_words"), parts_of.alias("parts")))
    same = base.select("key", F.inline("parts")).distinct().join(small_enough(known), ["wid", "size", "words"], "left_semi")
    same = stored(same.select("key", "wid", "start", (F.col("start") + F.col("size")).alias("end")))
    spans = same.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    reach = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a.hit + F.greatest(s.end - F.greatest(s.start, a.upto), F.lit(0))).alias("hit"), F.greatest(a.upto, s.end).alias("upto"))
    hits = spans.select("key", F.aggregate("spans", reach, step, lambda a: a.hit).cast("bigint").alias("n_hit"))
    named = same.select("key", "wid").distinct().join(small_enough(owners), "wid").groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = base.drop("parts").join(hits.join(named, "key"), "key", "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without those that the benchmark contaminates."""
    bad = contained(docs, table(spark, sf_dir, "benchmark")).where(is_contaminated()).select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    return rows.join(small_enough(stored(bad)), "key", "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM w, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.words = bw.words AND dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
