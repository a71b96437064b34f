"""Operator 3: mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). The token budget goes down the tree: among the children of a node it is split in
proportion to their weights, no child gets more than its capacity (epochs * tokens below it), and what a full child can
not take goes to its siblings; only when all of them are full does it go to the siblings of an ancestor. A leaf with quota
q and t tokens takes q div t whole epochs and, from one more epoch in its own seeded order, the longest prefix of
documents with at most q mod t tokens.

The split has a closed form: with children in the order of capacity / weight, a child is full exactly if its capacity is
at most weight * (budget - capacities before it) / (weights from it on), and the first child that is not full fixes the
level for the rest; so it is a window over the children of each node. All arithmetic is on integers (fractions round
down). The seeded order is the md5 of seed, epoch and doc_id; rows that share it (equal doc_id) are taken or left
together. The prefix needs no sorted leaf: orders are cut in BINS ranges, and only the range that the quota ends in is
sorted, so a leaf with a third of all rows is spread over its ranges.

Null lang or source are values of their own, apart from every text; null texts have no tokens; a leaf without tokens is kept once; an
empty table gives an empty result; the caller's columns are kept, but for `domain`, `n_tokens` and `copies`, which are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import WORD, materialise

BINS = 256
#: Plans up to this many leaves are broadcast (under 20 MB); larger ones are joined by shuffle.
BROADCAST_LEAVES = 100_000
#: Production targets: domain by the last digit of the source's number, then language weights; sources weigh the same.
DOMAINS = {"web": 5, "books": 3, "reference": 2}
LANGS = {"en": 6, "de": 2, "fr": 2, "es": 2}
BUDGET = (3, 4)
EPOCHS = 2
SEED = 11

DOMAIN_SQL = (
    "CASE WHEN source LIKE '%0' OR source LIKE '%1' OR source LIKE '%2' OR source LIKE '%3' OR source LIKE '%4' THEN 'web' "
    "WHEN source LIKE '%5' OR source LIKE '%6' OR source LIKE '%7' THEN 'books' ELSE 'reference' END"
)


def weight(col: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for k, v in weights.items():
        out = F.when(F.col(col) == k, F.lit(v).cast("long")).otherwise(out)
    return out


def named(col: str) -> Column:
    """A leaf's part of the name: null becomes '', any other value gets a sign before it."""
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit(""))


def split_budget(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """nodes: parents..., name, cap, w and the budget of the parent; adds `quota`."""
    order = [F.col("cap") / F.col("w"), F.col("name")]
    all_of = Window.partitionBy(*parents)
    by = all_of.orderBy(*order)
    return (
        nodes.withColumn("c0", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w1", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("w1") <= F.col("w") * (F.col(budget) - F.col("c0")))
        .withColumn("level", F.first(F.when(~F.col("full"), F.struct("c0", "w1")), ignorenulls=True).over(
            by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(
            F.call_function("div", F.col("w") * (F.col(budget) - F.col("level.c0")), F.col("level.w1"))))
        .drop("c0", "w1", "full", "level")
    )


def order_of(seed: int, epoch: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def plan_leaves(leaves: DataFrame, domains: dict[str, int], langs: dict[str, int], budget: tuple[int, int], epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens; adds quota, whole (epochs) and rest (tokens of the last epoch)."""
    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = tree.agg(F.call_function("div", F.coalesce(F.sum("tokens"), F.lit(0)) * budget[0], F.lit(budget[1]).cast("long")).alias("b0"))
    top = tree.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight("domain", domains)).withColumn("name", F.col("domain"))
    top = split_budget(top.crossJoin(F.broadcast(total)), [], "b0").select("domain", F.col("quota").alias("b1"))
    mid = tree.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight("lang", {f"={k}": v for k, v in langs.items()})).withColumn("name", F.col("lang"))
    mid = split_budget(mid.join(top, "domain"), ["domain"], "b1").select("domain", "lang", F.col("quota").alias("b2"))
    low = tree.withColumn("w", F.lit(1).cast("long")).withColumn("name", F.col("source"))
    low = split_budget(low.join(mid, ["domain", "lang"]), ["domain", "lang"], "b2")
    n = F.when(F.col("tokens") > 0, F.col("tokens"))
    return low.select(
        "domain", "lang", "source", "tokens", "quota",
        F.coalesce(F.call_function("div", F.col("quota"), n), F.lit(1)).alias("whole"), F.coalesce(F.pmod("quota", n), F.lit(0)).alias("rest"),
    )


def mix(
    docs: DataFrame, domains=DOMAINS, langs=LANGS, budget=BUDGET, epochs=EPOCHS, seed=SEED, domain_sql=DOMAIN_SQL
) -> DataFrame:
    """The documents that the mixture takes, with `domain`, `n_tokens` (words) and `copies` (times it is taken)."""
    leaf = ["m_domain", "m_lang", "m_source"]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tagged = docs.withColumn("m_domain", F.expr(domain_sql)).withColumn(
        "m_lang", named("lang")).withColumn("m_source", named("source"))
    narrow = materialise(tagged.select("doc_id", *leaf, tokens.alias("m_tokens")))
    stats = narrow.groupBy(*leaf).agg(F.sum("m_tokens").alias("tokens"))
    plan = materialise(plan_leaves(
        stats.select(F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), "tokens"),
        domains, langs, budget, epochs,
    ).select(F.col("domain").alias("m_domain"), F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "whole", "rest"))
    small = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)
    ranked = narrow.join(hint(plan), leaf).filter(F.col("rest") > 0).withColumn("o", order_of(seed, F.col("whole")))
    ranked = ranked.withColumn("bin", F.shiftright("o", 60 - 8)).select(*leaf, "rest", "bin", "o", "m_tokens")
    sums = ranked.groupBy(*leaf, "rest", "bin").agg(F.sum("m_tokens").alias("t"))
    upto = Window.partitionBy(*leaf).orderBy("bin")
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).select(*leaf, "bin", "before")
    within = Window.partitionBy(*leaf).orderBy("o").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        ranked.join(hint(ends), [*leaf, "bin"]).withColumn("upto", F.col("before") + F.sum("m_tokens").over(within))
        .filter(F.col("upto") <= F.col("rest")).groupBy(*leaf).agg(F.max("o").alias("cut"))
    )
    cuts = plan.join(ends.select(*leaf, F.col("bin").alias("end_bin")), leaf, "left").join(last, leaf, "left").withColumn(
        "cut", F.when(F.col("rest") == 0, F.lit(-1)).otherwise(F.coalesce("cut", F.shiftleft("end_bin", 60 - 8) - 1, F.lit(2**62)))
    ).select(*leaf, "whole", "cut")
    cuts = materialise(cuts.withColumnsRenamed({"whole": "m_whole", "cut": "m_cut"}))
    taken = tagged.join(hint(cuts), leaf).withColumn(
        "copies", (F.col("m_whole") + (order_of(seed, F.col("m_whole")) <= F.col("m_cut")).cast("long")).cast("int")
    )
    return taken.filter(F.col("copies") > 0).withColumn("n_tokens", tokens).withColumn("domain", F.col("m_domain")).drop(*leaf, "m_whole", "m_cut")


def op3_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _cases(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _level(name: str, source: str, parents: str, budget: str) -> str:
    by = f"PARTITION BY {parents} " if parents else ""
    return f"""{name}_s AS (SELECT *, cap - cap + coalesce(sum(cap) OVER ({by}ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
      sum(w) OVER ({by}ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w1 FROM {source}),
    {name}_f AS (SELECT *, cap * w1 <= w * ({budget} - c0) AS isfull FROM {name}_s),
    {name}_l AS (SELECT *, min(CASE WHEN NOT isfull THEN c0 END) OVER ({by}) AS lc, max(CASE WHEN NOT isfull THEN w1 END) OVER ({by}) AS lw FROM {name}_f),
    {name} AS (SELECT *, CAST(CASE WHEN isfull THEN cap ELSE (w * ({budget} - lc)) // lw END AS BIGINT) AS quota FROM {name}_l)"""


OP3_SQL = f"""WITH d AS (SELECT doc_id, lang, source, {DOMAIN_SQL} AS domain, coalesce('=' || lang, '') AS ml, coalesce('=' || source, '') AS ms,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
    leaves AS (SELECT domain, ml, ms, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
    tot AS (SELECT coalesce(sum(tokens), 0)::BIGINT * {BUDGET[0]} // {BUDGET[1]} AS b0 FROM leaves),
    t1 AS (SELECT domain, domain AS name, sum(tokens)::BIGINT * {EPOCHS} AS cap, {_cases('domain', DOMAINS)} AS w, any_value(b0) AS b0 FROM leaves, tot GROUP BY domain),
    {_level('q1', 't1', '', 'b0')},
    t2 AS (SELECT l.domain, l.ml, l.ml AS name, sum(tokens)::BIGINT * {EPOCHS} AS cap, {_cases('l.ml', {f'={k}': v for k, v in LANGS.items()})} AS w, any_value(quota) AS b1
      FROM leaves l JOIN q1 ON l.domain = q1.domain GROUP BY l.domain, l.ml),
    {_level('q2', 't2', 'domain', 'b1')},
    t3 AS (SELECT l.domain, l.ml, l.ms, l.ms AS name, tokens, tokens * {EPOCHS} AS cap, 1 AS w, quota AS b2
      FROM leaves l JOIN q2 ON l.domain = q2.domain AND l.ml = q2.ml),
    {_level('q3', 't3', 'domain, ml', 'b2')},
    plan AS (SELECT domain, ml, ms, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM q3),
    o AS (SELECT d.*, whole, rest, CAST('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS o
      FROM d JOIN plan p ON d.domain = p.domain AND d.ml = p.ml AND d.ms = p.ms),
    c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, ml, ms ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
    FROM c WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mixture takes, each as often as it takes them."""
    taken = mix(docs).select("doc_id", "text", "lang", "source", "n_chars", "copies")
    # At most EPOCHS copies, so the repetition is bounded.
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies", "copy")
