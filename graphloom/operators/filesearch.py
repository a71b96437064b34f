"""File search beyond symbol scores: bonuses, admission by path and source, fusion, expansion along imports and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths
from graphloom.functions.text import split_tokens, stem_match

# Names of frameworks that tell which language a question is about.
FRONTEND_FRAMEWORKS = [
    "react", "vue", "angular", "svelte", "next", "nuxt", "remix", "zustand", "redux", "mobx", "jotai", "recoil", "pinia", "tailwind",
    "chakra", "mui", "shadcn",
]
BACKEND_FRAMEWORKS = ["django", "flask", "fastapi", "celery", "sqlalchemy", "express", "nest", "koa", "hono"]


def in_parent_directory(path: Column, tokens: Column) -> Column:
    """Whether a query token equals, or shares its stem with, a word of the file's directory name."""
    words = split_tokens(F.when(path.contains("/"), F.substring_index(paths.directory(path), "/", -1)).otherwise(""))
    return F.exists(tokens, lambda t: F.exists(words, lambda w: (t == w) | stem_match(t, w)))


def with_directory_bonus(ranks: DataFrame, tokens: Column) -> DataFrame:
    """ranks: path, score. Files in a directory that is named in the question get 1.3 times their score."""
    return ranks.withColumn("score", F.col("score") * F.when(in_parent_directory(F.col("path"), tokens), 1.3).otherwise(1.0))


def with_framework_bias(ranks: DataFrame, tokens: Column) -> DataFrame:
    """ranks: path, score, language. A question that names a framework of one side favours that side's files 1.5 times."""
    names = lambda given: F.exists(tokens, lambda t: t.isin(given))
    script = names(FRONTEND_FRAMEWORKS) & F.col("language").isin("typescript", "javascript")
    python = names(BACKEND_FRAMEWORKS) & (F.col("language") == "python")
    return ranks.withColumn("score", F.col("score") * F.when(script | python, 1.5).otherwise(1.0))


def file_token_sets(sources: DataFrame) -> DataFrame:
    """sources: file, tokens -> suffix (of one to five parts of the path), tokens: all that files with the suffix hold."""
    suffix = F.explode(paths.suffixes("file", 5)).alias("suffix")
    return sources.select(suffix, F.explode("tokens").alias("token")).groupBy("suffix").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def admitted(files: DataFrame, terms: Column) -> DataFrame:
    """path, score of files that hold two or more of the question's tokens, in path or source, and 0.3 of their weight.

    files: path, tokens (of the file's source); terms: array of struct(t, w). One hit at least must be in the file's own name
    or source; with fewer than two of those the score is cut to 0.6, and a fitting directory raises it 1.3 times, up to 1."""
    stem = F.regexp_replace(paths.basename("path"), r"\.[^.]*$", "")
    own, given = F.array_union(split_tokens(stem), F.coalesce("tokens", F.array())), F.col("terms")
    held = lambda words: F.filter(given, lambda x: F.array_contains(words, x["t"]))
    weight = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y["w"].cast("double"))
    rows = files.withColumn("terms", terms).withColumn("all", held(F.array_union(split_tokens("path"), own))).withColumn("own", F.size(held(own)))
    total = F.when(weight(given) > 0, weight(given)).otherwise(1.0)
    rows = rows.withColumn("coverage", weight(F.col("all")) / total).filter("size(all) >= 2 and coverage >= 0.3 and own > 0")
    score = F.col("coverage") * 0.7 * F.when(F.col("own") < 2, 0.6).otherwise(1.0)
    bonus = in_parent_directory(F.col("path"), F.transform(given, lambda x: x["t"]))
    return rows.select("path", F.when(bonus, F.least(F.lit(1.0), score * 1.3)).otherwise(score).alias("score"))


def fused(ranks: DataFrame, hits: DataFrame) -> DataFrame:
    """ranks: path, score; hits: path, score of functions. A file has the better of its own score and 0.95 of its best hit."""
    best = hits.groupBy("path").agg((F.max("score") * 0.95).alias("hit"))
    return ranks.groupBy("path").agg(F.max("score").alias("own")).join(best, "path", "full").select("path", F.greatest("own", "hit").alias("score"))


def with_consumers(ranks: DataFrame, imports: DataFrame, n: int) -> DataFrame:
    """ranks: path, score; imports: importer, target. Where there are fewer than n files, those that import one of the best three
    (of 0.3 or more) follow with 0.45 of its score; the better one counts. Adds via."""
    best = ranks.orderBy(F.desc("score"), "path").limit(3).filter("score >= 0.3")
    missing = ranks.agg((F.count("*") < n).alias("few"))
    found = imports.join(F.broadcast(best), F.col("target") == F.col("path")).drop("path")
    found = found.groupBy("importer").agg(F.max_by("target", F.struct("score", "target")).alias("via"), (F.max("score") * 0.45).alias("score"))
    found = found.join(ranks.select(F.col("path").alias("importer")), "importer", "left_anti").crossJoin(F.broadcast(missing)).filter("few")
    return ranks.select("path", "score", F.lit(None).cast("string").alias("via")).union(found.select("importer", "score", "via"))


def _best(results: DataFrame, n: int) -> DataFrame:
    return results.orderBy(F.desc("score"), "name", "file").limit(n)


def callers_of(results: DataFrame, edges: DataFrame, among: int = 15) -> DataFrame:
    """results: name, kind, file, score; edges: callee, caller, caller_file -> name, file, score of the callers, in other files, of
    the functions among the best results, at 0.55 of the score; what is a result already is left out."""
    top = _best(results, among).filter("kind = 'function'").select("name", "file", "score")
    rows = edges.join(F.broadcast(top), F.col("callee") == F.col("name")).filter("caller_file <> file")
    rows = rows.groupBy(F.col("caller").alias("name"), F.col("caller_file").alias("file")).agg((F.max("score") * 0.55).alias("score"))
    return rows.join(results.filter("kind = 'function'").select("name", "file").distinct(), ["name", "file"], "left_anti")


def colocated(results: DataFrame, functions: DataFrame, among: int = 5, most: int = 2) -> DataFrame:
    """functions: name, file, seq -> at most `most` other functions of each file of the best results, at 0.6 of its best score."""
    top = _best(results, among).filter("kind in ('function', 'class')").groupBy("file").agg((F.max("score") * 0.6).alias("score"))
    rows = functions.select("name", "file", "seq").join(F.broadcast(top), "file")
    rows = rows.join(results.filter("kind = 'function'").select("name", "file").distinct(), ["name", "file"], "left_anti")
    first = rows.groupBy("name", "file").agg(F.min("seq").alias("seq"), F.first("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    return first.withColumn("r", rank).filter(F.col("r") <= most).select("name", "file", "score")


def same_directory(results: DataFrame, functions: DataFrame, among: int = 5) -> DataFrame:
    """Functions in the directories of the best results, at 0.45 of the directory's best score."""
    folder = lambda df: df.withColumn("folder", paths.directory("file"))
    top = folder(_best(results, among).filter("file like '%/%'")).groupBy("folder").agg((F.max("score") * 0.45).alias("score"))
    rows = folder(functions.select("name", "file").distinct()).join(F.broadcast(top), "folder")
    return rows.join(results.filter("kind = 'function'").select("name", "file").distinct(), ["name", "file"], "left_anti").select("name", "file", "score")


def in_project(path: Column, root: str) -> Column:
    return path.startswith(root) | path.contains(root)
