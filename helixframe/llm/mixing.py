"""Mixing sources to target weights by hierarchical budgeting.

Sources are leaves of a tree domain / language / source. A token budget flows down by weight. At each level the
children of a node share its budget in proportion to their weights until one reaches what its subtree can give;
what it cannot take goes to its siblings, so a shortage reaches an ancestor only when all of them are full. A leaf
can give its tokens ``epochs`` times: whole epochs first, then a prefix of a seeded order of its documents that
fits the rest.

The prefix needs no sort of a leaf: token sums of hash buckets show the one bucket in which the budget ends, and
only the rows of that bucket are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, small_enough, stored, table

#: Production weights; languages not named have the last weight; sources of one language weigh the same.
DOMAIN_WEIGHTS = {"web": 0.6, "reference": 0.3, "other": 0.1}
LANGUAGE_WEIGHTS, OTHER_LANGUAGE = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, 0.05
#: Budget as a share of all tokens, the epochs a source can give, the seed of the orders.
SHARE, EPOCHS, SEED = 0.5, 2, 20
#: Documents a bucket holds about.
BUCKET = 4000
LEAF = ["domain", "language", "origin"]


def domain_of(source: Column) -> Column:
    """Sources named with a number below 12 are web, below 18 reference; all others are other."""
    number = F.expr("try_cast(regexp_extract(src, '^src([0-9]+)$', 1) AS int)")
    return F.when(number < 12, "web").when(number < 18, "reference").otherwise("other")


def weight_of(column: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(column == name, w).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the budget of the parent shared among its children by weight, none above its room.

    Children in the order of room / weight: those before the first that does not fill up are full."""
    order = W.partitionBy(*parent).orderBy("fill", name) if parent else W.partitionBy(F.lit(1)).orderBy("fill", name)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    out = nodes.withColumn("fill", F.col("room") / F.col("weight")).withColumn("place", F.row_number().over(order))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    out = out.withColumn("last", F.min(F.when(F.col("fill") > F.col("level"), F.struct("place", "level"))).over(whole))
    given = F.when(F.col("last").isNull(), F.col("room")).otherwise(F.least("room", F.col("weight") * F.col("last.level")))
    return out.withColumn("given", given).drop("fill", "place", "level", "last")


def budgets(leaves: DataFrame, budget: Column, domains: dict[str, float], languages: dict[str, float], other: float, epochs: int) -> DataFrame:
    """(domain, language, origin, tokens, goal) from (domain, language, origin, tokens): whole tokens for each leaf.

    The tree is as large as the list of sources, not as the table of documents."""
    leaves = leaves.withColumn("room", F.col("tokens").cast("double") * epochs).where("room > 0")
    level1 = leaves.groupBy("domain").agg(F.sum("room").alias("room")).withColumn("weight", weight_of(F.col("domain"), domains, min(domains.values())))
    level1 = _share_out(level1.withColumn("budget", budget), [], "domain").select("domain", F.col("given").alias("budget"))
    level2 = leaves.groupBy("domain", "language").agg(F.sum("room").alias("room")).withColumn("weight", weight_of(F.col("language"), languages, other))
    level2 = _share_out(level2.join(level1, "domain"), ["domain"], "language").select("domain", "language", F.col("given").alias("budget"))
    level3 = leaves.withColumn("weight", F.lit(1.0)).join(level2, ["domain", "language"])
    return _share_out(level3, ["domain", "language"], "origin").select(*LEAF, "tokens", F.floor(F.col("given") + 1e-6).cast("bigint").alias("goal"))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.col("id")))


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domains: dict[str, float] | None = None,
        languages: dict[str, float] | None = None, other: float = OTHER_LANGUAGE, bucket: int = BUCKET) -> DataFrame:
    """(row, domain, epoch, n_tokens): each chosen document, once for each epoch it is chosen in.

    A missing language or source is a leaf of its own ('(none)'); documents without tokens (NULL or empty text) are
    never chosen; documents of one id (repeated rows among them) follow each other in the order, by text. Documents
    without an id are ordered by a hash of their text, so that a leaf of them alone is cut into buckets too. An empty
    table gives none. Columns of any name pass inside ``row``."""
    domains, languages = domains or DOMAIN_WEIGHTS, languages or LANGUAGE_WEIGHTS
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex(F.xxhash64("text")))).alias("id"), F.xxhash64("text").alias("t"), F.col("source").alias("src"), F.coalesce("lang", F.lit("(none)")).alias("language"), "text")
    rows = named.select("row", "id", "t", domain_of(F.col("src")).alias("domain"), "language", F.coalesce("src", F.lit("(none)")).alias("origin"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))
    slim = stored(rows.select("id", *LEAF, "n_tokens").where("n_tokens > 0"))
    leaves = stored(slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goals = budgets(leaves, F.lit(float(int(total * share))), domains, languages, other, epochs).join(leaves.drop("tokens"), LEAF)
    goals = goals.withColumn("full", F.floor(F.col("goal") / F.col("tokens")).cast("int")).withColumn("rest", F.col("goal") - F.col("full") * F.col("tokens"))
    goals = small_enough(stored(goals.withColumn("buckets", F.ceil(F.col("docs") / bucket)).select(*LEAF, "full", "rest", "buckets")))

    def placed(df: DataFrame) -> DataFrame:
        h = df.join(goals, LEAF).withColumn("h", _order(seed, F.col("full")))
        number = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
        return h.withColumn("bucket", F.floor(number * F.col("buckets") / F.lit(1 << 32)))

    sums = placed(slim).groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("held"))
    upto = W.partitionBy(*LEAF).orderBy("bucket")
    edges = sums.withColumn("upto", F.sum("held").over(upto)).where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before"))).alias("edge"))
    edges = small_enough(stored(edges.select(*LEAF, F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))))
    every = placed(rows.where("n_tokens > 0")).join(edges, LEAF, "left")
    out = ["row", "domain", "n_tokens"]
    whole = every.where("full > 0").select(*out, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    inside = every.where("edge IS NULL AND rest > 0 OR bucket < edge").select(*out, F.col("full").alias("epoch"))
    order = W.partitionBy(*LEAF).orderBy("h", "id", "t").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = every.where("bucket = edge").withColumn("sum", F.col("before") + F.sum("n_tokens").over(order)).where("sum <= rest").select(*out, F.col("full").alias("epoch"))
    return whole.unionByName(inside).unionByName(last).select("row", "domain", "epoch", "n_tokens")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the chosen documents and the epoch each is chosen in."""
    return mix(docs).select("row.doc_id", "row.text", "row.lang", "row.source", "row.n_chars", "epoch")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("row.doc_id", "row.lang", "row.source", "domain", "epoch", "n_tokens")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) AS number FROM documents),
t AS (SELECT *, CASE WHEN number < 12 THEN 'web' WHEN number < 18 THEN 'reference' ELSE 'other' END AS domain FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 2 AS room FROM t GROUP BY ALL),
l1 AS (
  SELECT domain, sum(room) AS room, CASE domain WHEN 'web' THEN 0.6::DOUBLE WHEN 'reference' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS weight,
    floor((SELECT sum(tokens) FROM leaf) * 0.5::DOUBLE) AS budget FROM leaf GROUP BY 1),
l1b AS (SELECT *, (budget - coalesce(sum(room) OVER (ORDER BY room / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY room / weight, domain) AS place FROM l1),
l1c AS (SELECT *, (SELECT level FROM l1b x WHERE x.room / x.weight > x.level ORDER BY place LIMIT 1) AS lv FROM l1b),
g1 AS (SELECT domain, CASE WHEN lv IS NULL THEN room ELSE least(room, weight * lv) END AS budget FROM l1c),
l2 AS (
  SELECT domain, language, sum(room) AS room, any_value(g1.budget) AS budget,
    CASE language WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'es' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS weight
  FROM leaf JOIN g1 USING (domain) GROUP BY 1, 2),
l2b AS (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY domain ORDER BY room / weight, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain ORDER BY room / weight, language ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (PARTITION BY domain ORDER BY room / weight, language) AS place FROM l2),
l2c AS (SELECT b.*, f.level AS lv FROM l2b b LEFT JOIN (SELECT domain, arg_min(level, place) AS level FROM l2b WHERE room / weight > level GROUP BY 1) f USING (domain)),
g2 AS (SELECT domain, language, CASE WHEN lv IS NULL THEN room ELSE least(room, weight * lv) END AS budget FROM l2c),
l3 AS (SELECT leaf.*, 1.0::DOUBLE AS weight, budget FROM leaf JOIN g2 USING (domain, language)),
l3b AS (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY domain, language ORDER BY room / weight, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain, language ORDER BY room / weight, origin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (PARTITION BY domain, language ORDER BY room / weight, origin) AS place FROM l3),
l3c AS (SELECT b.*, f.level AS lv FROM l3b b LEFT JOIN (SELECT domain, language, arg_min(level, place) AS level FROM l3b WHERE room / weight > level GROUP BY 1, 2) f USING (domain, language)),
goal AS (SELECT domain, language, origin, tokens, floor(CASE WHEN lv IS NULL THEN room ELSE least(room, weight * lv) END + 1e-6)::BIGINT AS goal FROM l3c),
e AS (
  SELECT t.*, goal // tokens AS f, goal % tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('20:' || (goal // tokens) || ':' || doc_id), doc_id::VARCHAR) AS upto
  FROM t JOIN goal USING (domain, language, origin))
SELECT doc_id, lang, source, domain, unnest(generate_series(0, f - 1))::INT AS epoch, n_tokens FROM e WHERE f > 0
UNION ALL SELECT doc_id, lang, source, domain, f::INT, n_tokens FROM e WHERE upto <= rest
"""
