"""Derivation of caller edges: extract, check against known names, keep the first of each key, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names that are never references, and receivers that never name a class instance.
SKIP_NAMES = [
    "self", "cls", "None", "True", "False", "super", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "type", "object", "bytes",
]
SKIP_VARS = [
    "self", "cls", "super", "os", "sys", "re", "json", "math", "logging", "logger", "log", "print", "str", "int", "float",
    "list", "dict", "set", "tuple", "type", "object", "path", "Path", "datetime", "date", "time", "uuid",
]
TASK_DECORATORS = ["task", "shared_task", "periodic_task"]
DISPATCH = ["delay", "apply_async", "s", "si"]
# What counts as each form of source text. Edges are only comparable if these match the same strings.
DOTTED_CALL = r"(\w+(?:\.\w+)*\.\w+)\s*\("
ARGUMENT = r"\w+\s*\(\s*(\w+)\s*[,)]"
KEYWORD_ARGUMENT = r"=\s*(\w+)\s*[,)\n]"
ANNOTATED_VAR = r"\b(\w+)\s*:\s*([A-Z]\w*)(?:\s*=|\s*[,\)])"
CONSTRUCTED_VAR = r"(?m)^[ \t]+(\w+)\s*=\s*(?:await\s+)?([A-Z]\w*)\s*\("
FACTORY_VAR = r"(?m)^[ \t]+(\w+)\s*=\s*(?:await\s+)?([a-z_]\w*)\s*\("
METHOD_CALL = r"\b(\w+)\.(\w+)\s*\("
CLASS_FIELD = r"(?m)^[ \t]+(\w+)\s*:\s*([A-Z]\w*)(?:\s*=|\s*$)"
CONSTRUCTED_FIELD = r"self\.(\w+)\s*(?::\s*\w[\w\[\], |]*\s*)?=\s*([A-Z]\w*)\s*\("
ANNOTATED_FIELD = r"self\.(\w+)\s*:\s*([A-Z]\w*)\s*="
FACTORY_FIELD = r"self\.(\w+)\s*=\s*(?:await\s+)?(\w+)\s*\("
FIELD_CALL = r"self\.(\w+)\.(\w+)\s*\("
REGISTERED = r"(?:decorate|register|use)\s*\(\s*['\"]\w{4,}['\"]\s*,\s*(\w{4,})"
ARRAY_ELEMENT = r"[\[,]\s*(?:\w+\.)?(\w{4,})\s*(?=[,\]])"
PROPERTY_VALUE = r":\s*(?:\w+\.)?(\w{4,})\s*[,}\n]"
JSX_TAG = r"<\s*([A-Z]\w{3,})[\s/>]"
SINGLETON = r"(?m)^([a-z_][a-z0-9_]*)\s*(?::\s*\w[\w\[\], \|]*\s*)?=\s*([A-Z]\w*)\s*\("

KEY = ["callee", "caller", "caller_file"]


def first_wins(edges: DataFrame, order: list) -> DataFrame:
    """One edge for each (callee, caller, caller_file): the one of the earliest pass."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return edges.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def drop_ambiguous(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Callers without a class: where the callee is a method of some class, untrusted dotted calls go."""
    known = methods.select(F.col("name").alias("callee")).distinct().withColumn("is_method", F.lit(True))
    flagged = edges.join(known, "callee", "left")
    return flagged.filter(~(F.coalesce("is_method", F.lit(False)) & F.col("has_dot") & ~F.col("trusted"))).drop("is_method")


def receivers(source: Column, callee: Column) -> Column:
    """Dotted prefixes in front of calls of callee."""
    calls = F.regexp_extract_all(source, F.lit(DOTTED_CALL), 1)
    mine = F.filter(calls, lambda x: F.substring_index(x, ".", -1) == callee)
    return F.array_sort(F.array_distinct(F.transform(mine, lambda x: F.regexp_replace(x, r"\.\w+$", ""))))


def primary(functions: DataFrame) -> DataFrame:
    """Pass 1: every call of every function. functions: name, class_name, file, source, calls, seq."""
    rows = functions.filter(F.col("name") != "").withColumn("callee", F.explode("calls"))
    found = rows.withColumn("receivers", receivers(F.col("source"), F.col("callee")))
    return found.select(
        "callee", F.col("name").alias("caller"), F.col("file").alias("caller_file"), F.col("class_name").alias("caller_class"),
        "receivers", (F.size("receivers") > 0).alias("has_dot"), F.lit(False).alias("trusted"), F.lit(1).alias("pass"), "seq",
    )


def _shuffled(side: DataFrame) -> DataFrame:
    """side for a shuffle join: sizes of what is taken out of texts are estimated far too low, and a broadcast passes the driver."""
    return side.hint("merge")


def _known(rows: DataFrame, names: DataFrame, at: int, trusted: bool) -> DataFrame:
    kept = rows.join(_shuffled(names.select(F.col("name").alias("callee")).distinct()), "callee", "left_semi")
    return _marked(kept, at, trusted)


def _marked(kept: DataFrame, at: int, trusted: bool) -> DataFrame:
    return kept.select(
        "callee", F.col("name").alias("caller"), F.col("file").alias("caller_file"), F.col("class_name").alias("caller_class"),
        F.array().cast("array<string>").alias("receivers"), F.lit(False).alias("has_dot"), F.lit(trusted).alias("trusted"), F.lit(at).alias("pass"), "seq",
    ).distinct()


def references(functions: DataFrame) -> DataFrame:
    """Pass 2: functions handed over as arguments (dependency injection, callbacks)."""
    args = F.concat(
        F.regexp_extract_all("source", F.lit(ARGUMENT), 1), F.regexp_extract_all("source", F.lit(KEYWORD_ARGUMENT), 1)
    )
    rows = functions.withColumn("callee", F.explode(F.array_distinct(args)))
    rows = rows.filter((F.col("callee") != F.col("name")) & ~F.col("callee").isin(SKIP_NAMES))
    return _known(rows, functions, 2, False)


def factories(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Top-level functions that return a known class; the last of a name counts."""
    rows = functions.filter(F.col("class_name").isNull()).select("name", "seq", F.posexplode(F.regexp_extract_all("return_type", F.lit(r"([A-Z]\w+)"), 1)).alias("pos", "type"))
    rows = rows.join(_shuffled(classes.select(F.col("name").alias("type")).distinct()), "type", "left_semi")
    first = rows.groupBy("name", "seq").agg(F.min_by("type", "pos").alias("type"))
    return first.groupBy("name").agg(F.max_by("type", "seq").alias("type"))


def typed_calls(functions: DataFrame, classes: DataFrame, class_methods: DataFrame) -> DataFrame:
    """Pass 3: calls on variables whose class is annotated, constructed or returned by a factory."""
    base = functions.select("name", "class_name", "file", "source", "seq")
    ways = [(1, ANNOTATED_VAR), (2, CONSTRUCTED_VAR), (0, FACTORY_VAR)]
    made = [
        base.select("seq", F.posexplode(F.arrays_zip(F.regexp_extract_all("source", F.lit(p), 1).alias("var"), F.regexp_extract_all("source", F.lit(p), 2).alias("type"))).alias("pos", "x"))
        .select("seq", F.lit(way).alias("way"), "pos", "x.var", "x.type")
        for way, p in ways
    ]
    by_factory = made[2].join(_shuffled(factories(functions, classes).select(F.col("type").alias("made"), F.col("name").alias("type"))), "type").select("seq", "way", "pos", "var", F.col("made").alias("type"))
    types = made[0].union(made[1]).union(by_factory).groupBy("seq", "var").agg(F.max_by("type", F.struct("way", "pos")).alias("type"))
    pattern = F.lit(METHOD_CALL)
    calls = base.select("name", "class_name", "file", "seq", F.explode(F.arrays_zip(F.regexp_extract_all("source", pattern, 1).alias("var"), F.regexp_extract_all("source", pattern, 2).alias("callee"))).alias("x"))
    calls = calls.select("name", "class_name", "file", "seq", "x.var", "x.callee")
    owned = class_methods.select(F.col("class_name").alias("type"), F.col("name").alias("callee")).distinct()
    found = calls.join(_shuffled(types), ["seq", "var"]).join(_shuffled(owned), ["type", "callee"], "left_semi")
    return _marked(found, 3, True)


def _pairs(rows: DataFrame, keys: list, pattern: str) -> DataFrame:
    """keys, pos, var, type: the two groups of a pattern, match by match."""
    one, two = (F.regexp_extract_all("source", F.lit(pattern), g) for g in (1, 2))
    return rows.select(*keys, F.posexplode(F.arrays_zip(one.alias("var"), two.alias("type"))).alias("pos", "x")).select(*keys, "pos", "x.var", "x.type")


def field_types(functions: DataFrame, made: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """class_name, file, var, type: fields annotated in the class body (bodies: class_name, file, source), then, the last one
    winning, those constructed or annotated in methods; a factory's result (made: name, type) only fills what is missing."""
    base, keys = functions.filter(F.col("class_name").isNotNull()), ["class_name", "file", "seq"]
    rows = _pairs(base, keys, CONSTRUCTED_FIELD).withColumn("way", F.lit(1)).union(_pairs(base, keys, ANNOTATED_FIELD).withColumn("way", F.lit(2)))
    if bodies is not None:
        rows = rows.union(_pairs(bodies.withColumn("seq", F.lit(None).cast("long")), keys, CLASS_FIELD).withColumn("way", F.lit(0)))
    found = rows.groupBy("class_name", "file", "var").agg(F.max_by("type", F.struct(F.col("way") > 0, "seq", "way", "pos")).alias("type"))
    if made is None:
        return found
    calls = _pairs(base, keys, FACTORY_FIELD).join(_shuffled(made.select(F.col("name").alias("type"), F.col("type").alias("made"))), "type")
    filled = calls.groupBy("class_name", "file", "var").agg(F.min_by("made", F.struct("seq", "pos")).alias("type"))
    return found.union(filled.join(_shuffled(found), ["class_name", "file", "var"], "left_anti").select("class_name", "file", "var", "type"))


def field_calls(functions: DataFrame, class_methods: DataFrame, made: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Pass 3b: calls on fields of self whose class is known; see field_types."""
    base = functions.filter(F.col("class_name").isNotNull())
    calls = _pairs(base, ["name", "class_name", "file", "seq"], FIELD_CALL).withColumnsRenamed({"type": "callee"}).drop("pos")
    found = calls.join(_shuffled(field_types(functions, made, bodies)), ["class_name", "file", "var"])
    owned = class_methods.select(F.col("class_name").alias("type"), F.col("name").alias("callee")).distinct()
    return _marked(found.join(_shuffled(owned), ["type", "callee"], "left_semi"), 4, True)


def dispatched(functions: DataFrame) -> DataFrame:
    """Pass 4: queued tasks (`task.delay()` and the like)."""
    bare = lambda d: F.substring_index(F.regexp_replace(F.regexp_replace(d, r"\(.*$", ""), "@", ""), ".", -1)
    tasks = functions.filter(F.exists("decorators", lambda d: bare(d).isin(TASK_DECORATORS)))
    pattern = F.lit(rf"\b(\w+)\.({'|'.join(DISPATCH)})\s*\(")
    rows = functions.withColumn("callee", F.explode(F.array_distinct(F.regexp_extract_all("source", pattern, 1)))).filter(F.col("callee") != F.col("name"))
    return _known(rows, tasks, 5, True)


def unique_methods(methods: DataFrame) -> DataFrame:
    """Methods defined in exactly one class: name, class_name."""
    return (
        methods.filter(~F.col("name").startswith("__")).groupBy("name")
        .agg(F.count_distinct("class_name").alias("n"), F.min("class_name").alias("class_name")).filter("n = 1").drop("n")
    )


def unique_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Pass 5: `var.method()` with a method of one class only. calls: var, callee, caller_class and others."""
    target = unique_methods(methods).select(F.col("name").alias("callee"), F.col("class_name").alias("target"))
    return calls.filter(~F.col("var").isin(SKIP_VARS)).join(target, "callee").filter(~F.col("caller_class").eqNullSafe(F.col("target")))


def framework_references(functions: DataFrame, names: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Pass 6: handlers registered under a string, array elements and property values that are functions, and JSX tags that are
    functions or classes."""
    found = lambda *ways: F.array_distinct(F.concat(*[F.regexp_extract_all("source", F.lit(p), 1) for p in ways]))
    others = lambda ways: functions.withColumn("callee", F.explode(found(*ways))).filter(F.col("callee") != F.col("name"))
    known = names.select("name") if classes is None else names.select("name").union(classes.select("name"))
    return _known(others([REGISTERED, ARRAY_ELEMENT, PROPERTY_VALUE]), names, 6, True).union(_known(others([JSX_TAG]), known, 6, True)).distinct()


def import_calls(calls: DataFrame, methods: DataFrame, imported: DataFrame) -> DataFrame:
    """Pass 7: a method of 1 to 5 classes, exactly one of which the caller's file imports.

    calls: callee, caller_file, caller_class; imported: file, class_name. Adds target."""
    owners = methods.select(F.col("name").alias("callee"), F.col("class_name").alias("target")).distinct()
    few = owners.groupBy("callee").count().filter("count <= 5").select("callee")
    rows = calls.join(owners.join(few, "callee", "left_semi"), "callee")
    mine = F.max((F.col("caller_class") == F.col("target")).cast("int")).alias("own")
    seen = imported.select(F.col("file").alias("caller_file"), F.col("class_name").alias("target"), F.lit(1).alias("seen")).distinct()
    marked = rows.join(seen, ["caller_file", "target"], "left")
    keys = [c for c in calls.columns]
    return (
        marked.groupBy(*keys).agg(F.sum(F.coalesce("seen", F.lit(0))).alias("n"), F.max(F.when(F.col("seen") == 1, F.col("target"))).alias("target"), mine)
        .filter("n = 1 AND coalesce(own, 0) = 0").drop("n", "own")
    )


def class_instances(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Module-level singletons: class_name, var, file."""
    p = F.lit(SINGLETON)
    rows = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("source", p, 1).alias("var"), F.regexp_extract_all("source", p, 2).alias("type"))).alias("x"))
    return rows.select(F.col("x.type").alias("class_name"), "x.var", F.col("path").alias("file")).join(classes.select(F.col("name").alias("class_name")).distinct(), "class_name", "left_semi")


def class_methods_last(methods: DataFrame) -> DataFrame:
    """Methods of the last definition (file) of every class name."""
    last = methods.groupBy("class_name").agg(F.max_by("file", "seq").alias("file"))
    return methods.join(last, ["class_name", "file"]).select("class_name", "name").distinct()


def decorator_counts(decorated: DataFrame) -> DataFrame:
    """decorated: language, decorator, example, seq -> count and the first three examples."""
    rows = decorated.withColumn("decorator", F.regexp_replace(F.regexp_replace("decorator", r"\(.*$", ""), "^@", ""))
    return rows.groupBy("language", "decorator").agg(
        F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "example"))), 1, 3), lambda x: x["example"]).alias("examples")
    )
