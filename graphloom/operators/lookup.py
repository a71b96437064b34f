"""Point lookups, suggestions, line search and shaping of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths
from graphloom.functions.text import split_tokens

KEEP_ALWAYS = ("name", "file")


def by_name(functions: DataFrame, name: str) -> DataFrame:
    """Functions of that name (`Class.method` asks for methods of the class), tests last."""
    owner, _, last = name.rpartition(".")
    rows = functions.filter(F.col("name") == last)
    if owner:
        rows = rows.filter(F.col("class_name") == owner)
    return rows.orderBy(paths.is_test("file"), "seq")


def fuzzy(functions: DataFrame, query: str) -> DataFrame:
    """Methods whose class and name tokens hold all (two or more) query tokens."""
    q = split_tokens(F.lit(query))
    have = F.array_union(split_tokens("class_name"), split_tokens("name"))
    return functions.filter(F.col("class_name").isNotNull()).filter((F.size(q) >= 2) & (F.size(F.array_except(q, have)) == 0)).orderBy("seq")


def symbol(functions: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """The first class of that name, else the first function, else the first fuzzy match."""
    tiers = classes.filter(F.col("name") == name).select(F.lit(1).alias("tier"), "name", "file", "seq")
    tiers = tiers.union(functions.filter(F.col("name") == name).select(F.lit(2), "name", "file", "seq"))
    tiers = tiers.union(fuzzy(functions, name).select(F.lit(3), "name", "file", "seq"))
    return tiers.orderBy("tier", "seq").limit(1)


def file_tiers(files: DataFrame, query: str) -> DataFrame:
    """Best match for a path: exact, then suffix either way (by the shorter length), then equal trailing components."""
    q = F.lit(query)
    path = F.col("path")
    tail = F.reverse(paths.parts("path"))
    want = F.reverse(paths.parts(q))
    same = F.aggregate(
        F.zip_with(tail, want, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, x: F.struct((s["n"] + (s["go"] & x).cast("int")).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"],
    )
    tier = F.when(path == q, 0).when(path.endswith(query) | q.endswith(path), 1).when(same >= 1, 2)
    score = F.when(tier == 1, F.least(F.length("path"), F.length(q))).otherwise(same)
    return files.withColumn("tier", tier).filter("tier is not null").withColumn("score", score).orderBy("tier", F.desc("score"), "seq")


def importers(imports: DataFrame, query: str) -> DataFrame:
    """Importers of the file: those of the exact key, else of all keys that match by suffix either way."""
    q = F.lit(query)
    rows = imports.withColumn("exact", F.col("target") == q).filter(F.col("exact") | F.col("target").endswith(query) | q.endswith(F.col("target")))
    best = rows.agg(F.max("exact").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter(F.col("exact") == F.col("best")).select("importer").distinct()


def forward_imports(imports: DataFrame, query: str) -> DataFrame:
    """What the file imports: of the exact key, else of the first key (by name) that matches by suffix."""
    q = F.lit(query)
    rows = imports.withColumn("t", F.when(F.col("importer") == q, 0).when(F.col("importer").endswith(query) | q.endswith(F.col("importer")), 1)).filter("t is not null")
    first = rows.agg(F.min(F.struct("t", "importer")).alias("k")).select("k.importer")
    return rows.join(F.broadcast(first), "importer", "left_semi").select("target").distinct()


def method_class(methods: DataFrame) -> DataFrame:
    """file, name, class_name where exactly one class of the file has the method."""
    return methods.groupBy("file", "name").agg(F.count_distinct("class_name").alias("n"), F.min("class_name").alias("class_name")).filter("n = 1").drop("n")


def suggestions(symbols: DataFrame, query: str, top: int = 5) -> DataFrame:
    """symbols: name, tier (functions before classes), seq; scored by the query tokens that the name holds."""
    tokens = [t for t in query.lower().replace(".", " ").split() if t]
    score = sum((F.lower("name").contains(t).cast("int") for t in tokens), F.lit(0))
    return symbols.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "tier", "seq").limit(top)


def call_style(source: Column, name: str) -> Column:
    bare, dotted = source.rlike(rf"(^|[^\w.]){name}\s*\("), source.rlike(rf"\.{name}\s*\(")
    return F.when(bare & dotted, "mixed").when(dotted, "dotted").when(bare, "bare").otherwise("unknown")


def same_family(caller_file: Column, callee_file: Column, has_dot: Column) -> Column:
    """Keep a caller of another language family only if it calls with a dot; unknown extensions stay."""
    a, b = paths.family(paths.language(caller_file)), paths.family(paths.language(callee_file))
    return a.isNull() | b.isNull() | (a == b) | has_dot


def external_dependencies(uses: DataFrame, symbol_imports: DataFrame) -> DataFrame:
    """uses: file, name; those that the file imports from no project file although its imports are known."""
    known = symbol_imports.select(F.col("importer").alias("file")).distinct()
    mine = symbol_imports.select(F.col("importer").alias("file"), "name").distinct()
    return uses.join(known, "file", "left_semi").join(mine, ["file", "name"], "left_anti")


def reference_lines(sources: DataFrame, needle: str, most: int = 3) -> DataFrame:
    """The first lines of each source that hold the text: fn_id, line_no (from 1), line."""
    rows = sources.filter(F.col("source").contains(needle)).select("fn_id", F.posexplode(F.split("source", "\n")).alias("i", "line")).filter(F.col("line").contains(needle))
    rank = F.row_number().over(Window.partitionBy("fn_id").orderBy("i"))
    return rows.withColumn("r", rank).filter(F.col("r") <= most).select("fn_id", (F.col("i") + 1).alias("line_no"), "line")


def narrowed(rows: DataFrame, part: str) -> DataFrame:
    """Keep rows of files that hold `part`, unless none does."""
    hit = F.col("file").contains(part)
    any_hit = rows.agg(F.coalesce(F.max(hit), F.lit(False)).alias("any_hit"))
    return rows.crossJoin(F.broadcast(any_hit)).filter(hit | ~F.col("any_hit")).drop("any_hit")


DETAILS = {"full": (), "summary": ("source", "signature", "decorators", "docstring"), "signatures": ("source", "docstring", "decorators")}


def detail(rows: DataFrame, level: str) -> DataFrame:
    if level not in DETAILS:
        raise ValueError(f"detail must be one of {sorted(DETAILS)}")
    return rows.drop(*DETAILS[level])


def stripped(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """rows without some fields of the structs in an array column; fields that are not there are passed over."""
    there = rows.schema[column].dataType.elementType.fieldNames()
    gone = [f for f in fields if f in there]
    return rows.withColumn(column, F.transform(column, lambda x: x.dropFields(*gone))) if gone else rows


def envelope(matches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: whether more than one match stands for it, a message, and the matches in order."""
    rest = [c for c in matches.columns if c not in keys]
    rows = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("matches"))
    n = F.size("matches")
    return rows.select(*keys, (n > 1).alias("ambiguous"), F.when(n > 1, F.concat(F.lit("found "), n, F.lit(" matches; name a file or class"))).alias("message"), "matches")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(offset, 0)).limit(limit)


def per_group(rows: DataFrame, group: list, order: list, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= most)


def signature(language: str = "python") -> Column:
    """Rendered from is_async, name, params (name, type, default) and return_type."""
    typed = lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))
    args = F.array_join(F.transform("params", typed), ", ")
    if language == "python":
        head = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "), "name", F.lit("("), args, F.lit(")"))
        return F.concat(head, F.coalesce(F.concat(F.lit(" -> "), "return_type"), F.lit("")))
    head = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.lit("function "), "name", F.lit("("), args, F.lit(")"))
    return F.concat(head, F.coalesce(F.concat(F.lit(": "), "return_type"), F.lit("")))


def truncate(response, most: int = 50_000):
    """Shorten a response dict whose JSON is longer than `most`: lists to ten entries with their totals, else cut."""
    import json

    if len(json.dumps(response, default=str)) <= most:
        return response
    if isinstance(response, dict):
        out = {}
        for k, v in response.items():
            out[k] = v[:10] if isinstance(v, list) and len(v) > 10 else v
            if isinstance(v, list) and len(v) > 10:
                out[f"_{k}_total"] = len(v)
        return out
    return response[:20] if isinstance(response, list) else str(response)[:most]
