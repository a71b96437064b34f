"""Aggregations: project statistics, conventions, token statistics, retrieval metrics, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths
from graphloom.functions.text import marked_bigrams

SNAKE = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
CAMEL = r"^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"
PASCAL = r"^[A-Z][a-zA-Z0-9]*$"
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)+$"


def project_stats(files: DataFrame) -> DataFrame:
    """files: path, n_functions, n_classes -> per language and in total (language null)."""
    rows = files.filter(~paths.is_ignored("path")).withColumn("language", paths.language("path")).filter("language is not null")
    return rows.rollup("language").agg(F.count("*").alias("n_files"), F.sum("n_functions").alias("n_functions"), F.sum("n_classes").alias("n_classes"))


def directory_stats(files: DataFrame, root: str) -> DataFrame:
    """By first path component below root ('.' for files at the root)."""
    rel = F.regexp_replace("path", "^" + root.rstrip("/") + "/", "")
    top = F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(".")
    return files.groupBy(top.alias("dir")).agg(F.count("*").alias("n_files"), F.sum("n_functions").alias("n_functions"), F.sum("n_classes").alias("n_classes"))


def drill_down(files: DataFrame, root: str, more_than: int) -> DataFrame:
    """Second level of the directories with more than so many files."""
    rel = F.split(F.regexp_replace("path", "^" + root.rstrip("/") + "/", ""), "/")
    rows = files.select(rel[0].alias("dir"), F.when(F.size(rel) >= 3, rel[1]).alias("sub"))
    big = rows.groupBy("dir").count().filter(F.col("count") > more_than).select("dir")
    return rows.filter("sub is not null").join(big, "dir", "left_semi").groupBy("dir", "sub").agg(F.count("*").alias("n_files"))


def call_counts(calls: DataFrame, builtins: list[str]) -> DataFrame:
    """calls: callee, file, pos -> number and first file, without builtins."""
    return calls.filter(~F.col("callee").isin(builtins)).groupBy("callee").agg(F.count("*").alias("n"), F.min_by("file", F.struct("pos", "file")).alias("file"))


def naming(names: DataFrame, most: int = 500) -> DataFrame:
    """names: language, name, seq -> shares of snake and camel among the first names of each language."""
    rank = F.row_number().over(Window.partitionBy("language").orderBy("seq"))
    head = names.withColumn("r", rank).filter(F.col("r") <= most)
    bare = F.regexp_replace("name", "^_+|_+$", "")
    share = lambda p: F.sum(bare.rlike(p).cast("long")) / F.count("*")
    out = head.groupBy("language").agg(F.count("*").alias("n"), F.round(share(SNAKE), 6).alias("snake"), F.round(share(CAMEL), 6).alias("camel"), F.round(share(PASCAL), 6).alias("pascal"))
    return out.withColumn("style", F.when(F.col("snake") >= F.greatest("camel", "pascal"), "snake_case").when(F.col("camel") >= F.col("pascal"), "camelCase").otherwise("PascalCase"))


def shares(counted: DataFrame) -> DataFrame:
    """counted with each row's share of all `n`."""
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def file_naming(files: DataFrame) -> DataFrame:
    """style, n, share among styled stems (no dunder, no index)."""
    stem = F.regexp_replace(paths.basename("path"), r"\.[^.]*$", "")
    rows = files.select(stem.alias("stem")).filter(~F.col("stem").startswith("__") & (F.col("stem") != "index"))
    style = F.when(F.col("stem").rlike(SNAKE), "snake_case").when(F.col("stem").rlike(KEBAB), "kebab-case").when(F.col("stem").rlike(PASCAL), "PascalCase").when(F.col("stem").rlike(CAMEL), "camelCase")
    counted = rows.select(style.alias("style")).filter("style is not null").groupBy("style").agg(F.count("*").alias("n"))
    return shares(counted)


def structure(files: DataFrame) -> DataFrame:
    """files: n_functions, n_classes, path -> averages and shares behind the structure conventions."""
    with_class = F.col("n_classes") > 0
    name = paths.basename("path")
    return files.agg(
        F.round(F.avg("n_functions"), 6).alias("avg_functions"),
        F.round(F.sum((F.col("n_classes") == 1).cast("long")) / F.nullif(F.sum(with_class.cast("long")), F.lit(0)), 6).alias("one_class"),
        F.sum(name.startswith("test_").cast("long")).alias("test_prefix"), F.sum(name.rlike(r"(_test|\.test|\.spec)\.[a-z]+$").cast("long")).alias("test_suffix"),
    )


def doc_style(doc: Column) -> Column:
    return (
        F.when(doc.rlike(r"(?m)^\s*(Args|Returns|Raises|Yields|Attributes):\s*$"), "google")
        .when(doc.rlike(r"(?m)^\s*(Parameters|Returns|Raises)\s*\n\s*-{3,}"), "numpy")
        .when(doc.rlike(r":(param|returns?|rtype|raises)\b"), "sphinx").otherwise("plain")
    )


def conventions(parts: list[DataFrame]) -> DataFrame:
    """Union of detectors (category, pattern, confidence), best first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("confidence", F.round("confidence", 2)).orderBy(F.desc("confidence"), "category", "pattern")


def summary(found: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """One line with the first patterns of high confidence."""
    rows = found.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "category", "pattern").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "category", "pattern")))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["pattern"]), "; ").alias("summary"))


def import_style(links: DataFrame) -> DataFrame:
    """links: file, target -> relative and absolute, each (file, target) once."""
    kind = F.when(F.col("target").rlike(r"^\.|^/"), "relative").otherwise("absolute")
    rows = links.select("file", "target").distinct().groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return shares(rows)


def top_packages(links: DataFrame, top: int = 10) -> DataFrame:
    """First component of the targets by number of files, longer than one character."""
    name = F.regexp_replace(F.split(F.regexp_replace("target", r"^[./]+", ""), r"[./]")[0], "[,;:]", "")
    rows = links.select("file", name.alias("package")).filter(F.length("package") > 1).groupBy("package").agg(F.count_distinct("file").alias("n_files"))
    return rows.orderBy(F.desc("n_files"), "package").limit(top)


def decorators(used: DataFrame, functions: int) -> DataFrame:
    """used: decorator, n -> those used three times or more with their confidence."""
    share = F.col("n") / F.lit(max(functions, 1))
    conf = F.when(F.col("n") >= 5, F.least(F.lit(0.95), share + 0.5)).otherwise(0.6)
    return used.filter("n >= 3").select("decorator", "n", F.round(conf, 6).alias("confidence"))


def bigram_log_probs(texts: DataFrame) -> DataFrame:
    """texts: text -> bigram, logp: ln((c + 1) / (T + V)), V = number of bigrams + 1; default under '__default__'."""
    counts = texts.select(F.explode(marked_bigrams("text")).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"), (F.count("*") + 1).alias("v"))
    rows = counts.crossJoin(F.broadcast(total)).select("bigram", F.round(F.log((F.col("c") + 1) / (F.col("t") + F.col("v"))), 6).alias("logp"))
    return rows.union(total.select(F.lit("__default__"), F.round(F.log(1 / (F.col("t") + F.col("v"))), 6)))


def trigram_vocabulary(texts: DataFrame, k: int) -> DataFrame:
    s = F.lower("text")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    rows = texts.filter(F.length("text") >= 3).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "gram").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "gram")))


def entropy(tokens: DataFrame) -> DataFrame:
    """tokens: id, token -> Shannon entropy in bits and share of distinct tokens."""
    counts = tokens.groupBy("id", "token").agg(F.count("*").alias("c"))
    total = Window.partitionBy("id")
    p = F.col("c") / F.sum("c").over(total)
    return counts.withColumn("p", p).groupBy("id").agg(
        F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"), F.round(F.count("*") / F.sum("c"), 6).alias("unique_ratio")
    )


def usages_by_file(sources: list[DataFrame]) -> DataFrame:
    out = sources[0].select("file")
    for s in sources[1:]:
        out = out.union(s.select("file"))
    return out.groupBy("file").agg(F.count("*").alias("n"))


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when((rank > 0) & (rank <= k), 1 / F.log2(rank + 1)).otherwise(0.0)


def mrr_at(rank: Column, k: int) -> Column:
    return F.when((rank > 0) & (rank <= k), 1 / rank).otherwise(0.0)


def retrieval_metrics(runs: DataFrame, k: int = 10) -> DataFrame:
    """runs: expected, ranked (array of names), latency -> mean nDCG@k, MRR@k and median latency."""
    rank = F.array_position("ranked", F.col("expected"))
    return runs.agg(F.round(F.avg(ndcg_at(rank, k)), 6).alias("ndcg"), F.round(F.avg(mrr_at(rank, k)), 6).alias("mrr"), F.round(F.median("latency"), 6).alias("p50"), F.count("*").alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """rows: category, label, predicted."""
    right = (F.col("label") == F.col("predicted")).cast("long")
    return rows.groupBy("category").agg(F.sum(right).alias("correct"), F.count("*").alias("total"), F.round(F.sum(right) / F.count("*"), 6).alias("accuracy"))
