"""Import resolution: suffix table, candidates in order of preference, nearest file, re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths
from graphloom.functions.text import shared_prefix


def suffix_table(files: DataFrame, most: int | None = None) -> DataFrame:
    """suffix, path, seq: the join key that stands for every `endswith` test."""
    return files.select("path", "seq", F.explode(paths.suffixes("path", most)).alias("suffix"))


def resolve(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """candidates: importer, imp (number of the statement), prio, suffix. The first candidate with a match; of its files the
    one that shares most leading directories with the importer, then the first indexed; same language family only."""
    met = candidates.join(table, "suffix")
    kin = paths.family(paths.language("importer")) == paths.family(paths.language("path"))
    near = shared_prefix(paths.parts(paths.directory("importer")), paths.parts(paths.directory("path")))
    other = (paths.language("importer") != paths.language("path")).cast("int")
    rank = F.row_number().over(Window.partitionBy("importer", "imp").orderBy(other, "prio", F.desc("shared"), "seq"))
    found = met.filter(kin).withColumn("shared", near).withColumn("r", rank).filter("r = 1")
    return found.select("importer", "imp", F.col("path").alias("target"), "prio", "shared")


def module_candidates(statements: DataFrame) -> DataFrame:
    """statements: importer, imp, module -> suffixes to look for, in order of preference."""
    stem = F.regexp_replace("module", r"\.", "/")
    ends = [".py", "/__init__.py", ".ts", ".tsx", "/index.ts", "/index.tsx", ".js", ".jsx", "/index.js", "/index.jsx"]
    rows = statements.filter(F.col("module") != "").select("importer", "imp", F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in ends])).alias("prio", "suffix"))
    return rows


def relative_target(statements: DataFrame, table: DataFrame) -> DataFrame:
    """statements: importer, imp, dots, rest: climb one directory for each dot but the first, then take the longest matching
    suffix; ties by the number of directories in common."""
    folder = paths.parts(paths.directory("importer"))
    base = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - (F.col("dots") - 1), F.lit(0)))
    full = F.concat_ws("/", base, F.regexp_replace("rest", r"\.", "/"))
    rows = statements.withColumn("full", full).select(
        "importer", "imp", F.explode(F.array(F.concat("full", F.lit(".py")), F.concat("full", F.lit("/__init__.py")))).alias("want")
    )
    # Whole paths first: short suffixes are in many files and are only looked up where no whole path is there.
    table = table.hint("merge")
    whole = rows.select("importer", "imp", F.lit(0).alias("prio"), F.array_join(F.filter(paths.parts("want"), lambda x: x != ""), "/").alias("suffix"))
    exact = whole.join(table, "suffix")
    rest = rows.join(exact.select("importer", "imp").distinct().hint("merge"), ["importer", "imp"], "left_anti")
    tried = rest.select("importer", "imp", F.posexplode(paths.suffixes("want")).alias("prio", "suffix"))
    tried = tried.join(table.select("suffix").distinct().hint("merge"), "suffix", "left_semi")
    longest = tried.withColumn("least", F.min("prio").over(Window.partitionBy("importer", "imp"))).filter("prio = least").drop("least")
    met = exact.unionByName(longest.join(table, "suffix"))
    common = F.size(F.array_intersect(paths.parts("importer"), paths.parts("path")))
    rank = F.row_number().over(Window.partitionBy("importer", "imp").orderBy("prio", F.desc(common), "seq"))
    return met.withColumn("r", rank).filter("r = 1").select("importer", "imp", F.col("path").alias("target"))


def through_reexports(symbol_imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Edges behind index files: importer -> the file that an imported name really comes from.

    symbol_imports: importer, target, name; exports: init, name (null: all names), source, prio."""
    offered = exports.withColumnsRenamed({"name": "e_name"})
    named = symbol_imports.join(offered, F.col("target") == F.col("init")).filter(F.col("e_name").isNull() | (F.col("name") == F.col("e_name")))
    rank = F.row_number().over(Window.partitionBy("importer", "target", "name").orderBy("prio", "source"))
    return named.withColumn("r", rank).filter("r = 1").select("importer", F.col("source").alias("target")).distinct()


def submodules(symbol_imports: DataFrame, table: DataFrame) -> DataFrame:
    """`from pkg import sub` also imports pkg/sub.py or pkg/sub/__init__.py."""
    package = symbol_imports.filter(F.col("target").endswith("/__init__.py")).withColumn("folder", paths.directory("target"))
    want = package.withColumn("suffix", F.explode(F.array(F.concat_ws("/", "folder", F.concat("name", F.lit(".py"))), F.concat_ws("/", "folder", "name", F.lit("__init__.py")))))
    files = table.select("path").distinct()
    return want.join(files, want["suffix"] == files["path"]).select("importer", F.col("path").alias("target")).distinct()


def imported_names(imports: DataFrame) -> DataFrame:
    from graphloom.functions.text import imported_names as names

    return imports.select(F.explode(names("source")).alias("name")).distinct()


def external_packages(lines: DataFrame) -> DataFrame:
    """lines: kind (requirements, pyproject, setup), text -> package names, normalised."""
    req = F.regexp_extract(F.trim("text"), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    quoted = F.transform(F.regexp_extract_all("text", F.lit("[\"']([^\"']+)[\"']"), 1), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    names = F.when(F.col("kind") == "pyproject", quoted).otherwise(F.array(req))
    rows = lines.filter(~F.trim("text").startswith("#")).select(F.explode(names).alias("name")).filter("name <> ''")
    return rows.select(F.lower(F.regexp_replace("name", "-", "_")).alias("name")).distinct()
