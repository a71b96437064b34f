"""Who calls what: caller lookup with disambiguation, trees and dependencies over edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import split_tokens


#: Share of dotted calls from which a name is taken for a method.
DOTTED = 0.8


def ambiguous_methods(methods: DataFrame) -> DataFrame:
    return methods.groupBy("name").agg(F.count_distinct("class_name").alias("n_classes"))


def dot_ratio(edges: DataFrame, least: float = DOTTED) -> DataFrame:
    """callee, n, ratio (of calls with a dot), dotted: of three or more callers at least that share call it with a dot."""
    ratio = F.avg(F.col("has_dot").cast("int"))
    return edges.groupBy("callee").agg(F.count("*").alias("n"), ratio.alias("ratio"), ((F.count("*") >= 3) & (ratio >= least)).alias("dotted"))


def plain_callers(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Callers where no class is given. A callee is taken for a method if some class has it, or if of three or more
    callers four in five call it with a dot; then untrusted dotted calls go."""
    known = methods.select(F.col("name").alias("callee")).distinct().withColumn("known", F.lit(True))
    share = dot_ratio(edges).select("callee", "dotted")
    rows = edges.join(known, "callee", "left").join(share, "callee")
    method = F.coalesce("known", F.lit(False)) | F.col("dotted")
    return rows.filter(~(method & F.col("has_dot") & ~F.col("trusted"))).drop("known", "dotted")


def caller_stats(edges: DataFrame) -> DataFrame:
    """callee, n_calls, n_files, n_callers and the share of all calls."""
    e = edges.groupBy("callee").agg(F.count("*").alias("n_calls"), F.count_distinct("caller_file").alias("n_files"), F.count_distinct("caller").alias("n_callers"))
    total = e.agg(F.sum("n_calls").alias("t"))
    return e.crossJoin(F.broadcast(total)).select("callee", "n_calls", "n_files", "n_callers", F.round(F.col("n_calls") / F.col("t"), 6).alias("share"))


def subclass_counts(classes: DataFrame) -> DataFrame:
    """name, n: direct subclasses by the last dotted part of their base; names without any are left out."""
    return classes.filter(F.col("base").isNotNull()).groupBy(F.substring_index("base", ".", -1).alias("name")).agg(F.count_distinct("name").alias("n"))


def allow_list(class_files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files from which a class may be called: class_name, file. Where it is defined, what imports that, and what imports
    its package's index file."""
    own = class_files.select("class_name", "file")
    index = own.select("class_name", F.explode(F.array(*[F.concat(F.regexp_replace("file", "/?[^/]*$", "/"), F.lit(x)) for x in ("__init__.py", "index.ts", "index.js")])).alias("file"))
    direct = own.union(index).join(imports.select(F.col("target").alias("file"), "importer"), "file").select("class_name", F.col("importer").alias("file"))
    return own.union(direct).distinct()


def class_callers(edges: DataFrame, methods: DataFrame, class_files: DataFrame, imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Callers of (callee, class_name) pairs in wanted, by four levels of doubt:

    1 the caller's own class has the method, 2 another class in the caller's file has it, 3 several classes have it and the
    caller's file imports none of this one's files, 4 the receivers share no word with the class name. Callers of the same
    class and trusted edges pass 1 to 3."""
    rows = edges.join(wanted, "callee")
    has = methods.select(F.col("name").alias("callee"), F.col("class_name").alias("k")).distinct()
    rows = rows.join(has.select("callee", F.col("k").alias("caller_class"), F.lit(True).alias("own")), ["callee", "caller_class"], "left")
    in_file = methods.select(F.col("name").alias("callee"), F.col("file").alias("caller_file"), F.col("class_name").alias("other")).distinct()
    near = in_file.join(wanted, "callee").filter(F.col("other") != F.col("class_name")).select("callee", "class_name", "caller_file", F.lit(True).alias("near")).distinct()
    rows = rows.join(near, ["callee", "class_name", "caller_file"], "left")
    rows = rows.join(ambiguous_methods(methods).withColumnRenamed("name", "callee"), "callee", "left")
    allowed = allow_list(class_files, imports).select("class_name", F.col("file").alias("caller_file"), F.lit(True).alias("allowed"))
    rows = rows.join(allowed, ["class_name", "caller_file"], "left")
    many = F.coalesce("n_classes", F.lit(0)) >= 2
    said = F.transform("receivers", lambda r: F.filter(split_tokens(r), lambda t: t != "self"))
    words = split_tokens("class_name")
    unlike = (F.size("receivers") > 0) & F.forall(said, lambda t: (F.size(t) > 0) & ~F.arrays_overlap(t, words))
    flag = lambda c: F.coalesce(c, F.lit(False))
    doubt = flag("own") | flag("near") | (many & ~flag("allowed"))
    same = F.col("caller_class").eqNullSafe(F.col("class_name"))
    return rows.filter(same | ((F.col("trusted") | ~doubt) & ~(many & unlike))).drop("own", "near", "n_classes", "allowed")


def receiver_token(receivers) -> F.Column:
    """First component behind self of the deepest receiver; ties to the smaller name."""
    inner = F.filter(F.transform(receivers, lambda r: F.regexp_replace(r, r"^self\.?", "")), lambda r: r != "")
    ranked = F.array_sort(F.transform(inner, lambda r: F.struct((-F.size(F.split(r, r"\."))).alias("d"), r.alias("r"))))
    return F.substring_index(F.get(ranked, F.lit(0))["r"], ".", 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the session names. In local mode alone a temporary one is made where it names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Frontier search over (src, dst): node and its least depth from each root, up to depth. Visited nodes are never
    expanded again, so the work per round is the frontier's edges. Each round is checkpointed: its plan stays small."""
    edges = checkpointed(edges)
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_tree(edges: DataFrame, root: str, depth: int, skip: list[str]) -> DataFrame:
    """Outgoing calls as (parent, node, depth); each function is expanded once, at its least depth."""
    spark = edges.sparkSession
    plain = edges.filter(~F.col("dst").isin(skip))
    nodes = reach(plain, spark.createDataFrame([(root,)], "node string"), depth)
    inner = nodes.filter(F.col("depth") < depth)
    return inner.join(plain, inner["node"] == plain["src"]).select(F.col("src").alias("parent"), F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()


def subclass_paths(classes: DataFrame, root: str, depth: int) -> DataFrame:
    """Subclass tree as paths: depth, path, node. Bases are matched by their last dotted part; a path never repeats a name,
    so diamonds come once per branch and cycles end."""
    up = classes.select(F.col("name").alias("child"), F.substring_index("base", ".", -1).alias("parent"))
    level = classes.filter(F.col("name") == root).select(F.lit(0).alias("depth"), F.array("name").alias("path"), F.col("name").alias("node")).distinct()
    out = None
    for k in range(1, depth + 1):
        joined = level.join(up, level["node"] == up["parent"]).filter(~F.array_contains("path", F.col("child")))
        level = joined.select(F.lit(k).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.col("child").alias("node"))
        out = level if out is None else out.union(level)
    return out


def flattened(tree: DataFrame) -> DataFrame:
    """path, node: a tree of paths (depth, path, node) in depth-first order, a parent before its children."""
    return tree.orderBy("path").select("path", "node")


def ancestors(classes: DataFrame, most: int = 8) -> DataFrame:
    """name, ancestor, depth (the least), for every class."""
    up = classes.filter(F.col("base").isNotNull()).select(F.col("name").alias("src"), F.substring_index("base", ".", -1).alias("dst")).distinct()
    start = classes.select(F.col("name").alias("node")).distinct()
    return reach(up, start, most).filter("depth > 0").select(F.col("root").alias("name"), F.col("node").alias("ancestor"), "depth")


def forward_dependencies(deps: DataFrame, project: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth inside the project, number of external names met). deps: src, dst; project: node."""
    spark = deps.sparkSession
    inside = deps.join(project.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    nodes = reach(inside, spark.createDataFrame([(root,)], "node string"), depth)
    met = nodes.filter(F.col("depth") < depth).join(deps, F.col("node") == deps["src"]).join(project.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.filter("depth > 0"), met.agg(F.count_distinct("dst").alias("externals"))


def reverse_dependencies(usages: DataFrame, importers: DataFrame, via_init: DataFrame) -> DataFrame:
    """file, n: counts of the first source that names the file (usages, then importers, then importers of re-exports)."""
    ranked = (
        usages.groupBy("file").agg(F.count("*").alias("n")).withColumn("src", F.lit(1))
        .union(importers.select("file").distinct().select("file", F.lit(1).cast("long"), F.lit(2)))
        .union(via_init.select("file").distinct().select("file", F.lit(1).cast("long"), F.lit(3)))
    )
    return ranked.groupBy("file").agg(F.min_by("n", "src").alias("n"))


def two_hops(imports: DataFrame, seeds: DataFrame, second: int = 3) -> DataFrame:
    """Importers of the seed files at half of their score, and up to `second` importers of each of those at 0.35."""
    one = seeds.join(imports, seeds["file"] == imports["target"]).groupBy(F.col("importer").alias("file")).agg(F.max(F.col("score") * 0.5).alias("score"))
    one = one.join(seeds.select("file"), "file", "left_anti").withColumn("hop", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("via").orderBy("file"))
    two = one.select(F.col("file").alias("via")).join(imports, F.col("via") == imports["target"]).select("via", F.col("importer").alias("file")).distinct()
    two = two.withColumn("r", rank).filter(F.col("r") <= second).select("file").distinct()
    two = two.join(seeds.select("file"), "file", "left_anti").join(one.select("file"), "file", "left_anti")
    return one.union(two.select("file", F.lit(0.35), F.lit(2)))
