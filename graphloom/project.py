"""The query surface: a source tree opened as tables, and the questions that can be asked of it.

Every method returns DataFrames (or a dict of them); nothing is gathered on the driver but what a caller collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths, text
from graphloom.operators import callers, dead, edges, imports, lookup, search, stats
from graphloom.sources import code

# Calls that say nothing about a design.
BUILTINS = [
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "isinstance", "issubclass", "type", "id", "hash",
    "repr", "getattr", "setattr", "hasattr", "delattr", "callable", "super", "enumerate", "zip", "map", "filter", "sorted", "reversed", "any",
    "all", "min", "max", "sum", "abs", "round", "open", "next", "iter", "vars", "dir", "input", "join", "split", "strip", "lstrip", "rstrip",
    "replace", "format", "startswith", "endswith", "lower", "upper", "find", "index", "count", "encode", "decode", "title", "capitalize",
    "isdigit", "isalpha", "append", "extend", "insert", "remove", "pop", "clear", "copy", "keys", "values", "items", "get", "update", "add",
    "discard", "sort", "reverse", "read", "write", "close", "flush", "seek", "now", "utcnow", "today", "timestamp", "isoformat", "strftime",
    "strptime", "total_seconds", "fromtimestamp", "fromisoformat", "date", "time", "timedelta", "astimezone", "combine", "debug", "info",
    "warning", "error", "critical", "exception", "getLogger", "setLevel", "addHandler", "exists", "mkdir", "makedirs", "isfile", "isdir",
    "basename", "dirname", "joinpath", "resolve", "absolute", "parent", "stem", "suffix", "name", "dumps", "loads", "dump", "load", "sleep",
    "run", "wait", "create_task", "gather", "ensure_future",
]
MAX_HINTS = 5


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.set_project(root)

    def set_project(self, root: str) -> None:
        """Open another tree; tables are views that are computed when asked."""
        self.root = root.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        """Parse again. Derived relations follow, none is kept stale."""
        for old in ("files", "symbols"):
            if hasattr(self, old):
                getattr(self, old).unpersist()
        for derived in getattr(self, "_derived", {}).values():
            derived.unpersist()
        self._derived: dict[str, DataFrame] = {}
        self.files = code.files(self.spark, self.root).withColumn("seq", F.xxhash64("path")).persist()
        self.symbols = code.symbols(self.files).withColumn("seq", F.xxhash64("file", "line", "name")).persist()
        of = lambda *kinds: self.symbols.filter(F.col("kind").isin(*kinds))
        self.functions = of("function", "method").drop("bases", "error", "kind").withColumn("decorators", F.coalesce("decorators", F.array().cast("array<string>")))
        self.methods = of("method").select("name", "class_name", "file", "seq")
        self.classes = of("class").select("name", "file", "line", "docstring", "source", "seq", "bases", F.get("bases", F.lit(0)).alias("base"))
        self.statements = of("import").select(F.col("file").alias("importer"), "line", "source")
        self.failures = of("error").select("file", "error")

    # Relations, each computed once between two refreshes

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = make().persist()
        return self._derived[name]

    def import_edges(self) -> DataFrame:
        return self._once("imports", self._import_edges)

    def symbol_imports(self) -> DataFrame:
        return self._once("names", self._symbol_imports)

    def caller_edges(self) -> DataFrame:
        """All passes, the first edge of each key."""
        return self._once("callers", self._caller_edges)

    def _import_edges(self) -> DataFrame:
        dots = F.length(F.regexp_extract("source", r"^from\s+(\.+)", 1))
        rows = self.statements.withColumn("dots", dots).withColumn("module", text.import_module("source")).withColumn("imp", F.col("line"))
        table = imports.suffix_table(self.files)
        near = rows.filter("dots > 0").withColumn("rest", F.regexp_extract("source", r"^from\s+\.+([\w.]*)", 1)).select("importer", "imp", "dots", "rest")
        absolute = imports.resolve(imports.module_candidates(rows.filter("dots = 0").select("importer", "imp", "module")), table)
        return absolute.select("importer", "imp", "target").union(imports.relative_target(near, table)).distinct()

    def _symbol_imports(self) -> DataFrame:
        names = self.statements.select("importer", F.col("line").alias("imp"), F.explode(text.imported_names("source")).alias("name"))
        return names.join(self.import_edges(), ["importer", "imp"]).select("importer", "target", "name").distinct()

    def _caller_edges(self) -> DataFrame:
        passes = [
            edges.primary(self.functions), edges.references(self.functions), edges.typed_calls(self.functions, self.classes, self.methods),
            edges.field_calls(self.functions, self.methods, edges.factories(self.functions, self.classes)), edges.dispatched(self.functions),
            edges.framework_references(self.functions, self.functions, self.classes),
        ]
        out = passes[0]
        for p in passes[1:]:
            out = out.unionByName(p)
        return edges.first_wins(out, ["pass", "seq"])

    def callers_of(self, name: str, class_name: str | None = None) -> DataFrame:
        e = self.caller_edges().filter(F.col("callee") == name)
        if class_name is None:
            return callers.plain_callers(e, self.methods)
        wanted = self.spark.createDataFrame([(name, class_name)], "callee string, class_name string")
        defs = self.classes.select(F.col("name").alias("class_name"), "file")
        return callers.class_callers(e, self.methods, defs, self.import_edges().select("importer", "target"), wanted)

    # The questions

    def get_project_skeleton(self, max_depth: int = 3) -> dict[str, DataFrame]:
        per_file = self._counts()
        return {"stats": stats.project_stats(per_file), "directories": stats.directory_stats(per_file, self.root), "tree": self.tree(max_depth), "hints": self._hints("skeleton")}

    def _counts(self) -> DataFrame:
        n = self.symbols.groupBy(F.col("file").alias("path")).agg(
            F.sum((F.col("kind") == "function").cast("long")).alias("n_functions"), F.sum((F.col("kind") == "class").cast("long")).alias("n_classes")
        )
        return self.files.select("path", "seq").join(n, "path", "left").fillna(0, ["n_functions", "n_classes"])

    def tree(self, max_depth: int) -> DataFrame:
        """Directories down to max_depth below the root with their files, and up to three of their names."""
        rel = F.filter(paths.parts(F.regexp_replace("path", "^" + self.root, "")), lambda p: p != "")
        rows = self.files.select(F.slice(rel, F.lit(1), F.least(F.size(rel) - 1, F.lit(max_depth))).alias("dirs"), F.element_at(rel, -1).alias("leaf"))
        rows = rows.select(F.array_join("dirs", "/").alias("dir"), "leaf")
        first = F.slice(F.array_sort(F.collect_list("leaf")), 1, 3)
        return rows.groupBy("dir").agg(F.count("*").alias("n_files"), first.alias("some")).orderBy("dir")

    def get_module_context(self, module: str, detail: str = "full", offset: int = 0, limit: int = 100) -> dict[str, DataFrame]:
        inside = F.col("file").contains("/" + module.strip("/") + "/") | F.col("file").endswith("/" + module.strip("/") + ".py")
        files = self.symbols.filter(inside).select("file").distinct()
        own = files.select(F.col("file").alias("importer"))
        return {
            "files": lookup.page(files, ["file"], offset, limit), "functions": lookup.detail(self.functions.filter(inside), detail),
            "classes": lookup.detail(self.classes.filter(inside), detail), "imports": self.import_edges().join(own, "importer", "left_semi"),
        }

    def get_function_context(self, name: str, file_path: str | None = None, detail: str = "full") -> dict[str, DataFrame]:
        found = lookup.by_name(self.functions, name)
        if found.isEmpty():
            found = lookup.fuzzy(self.functions, name)
        if file_path:
            found = lookup.narrowed(found, file_path)
        owner, _, last = name.rpartition(".")
        calls = found.select("file", F.posexplode("calls").alias("pos", "callee"))
        called = lookup.same_family(F.col("caller_file"), F.lit("x.py"), F.col("has_dot"))
        return {"matches": lookup.detail(found, detail), "calls": stats.call_counts(calls, BUILTINS), "callers": self.callers_of(last, owner or None).filter(called), "hints": self._hints("function", last)}

    def get_file_context(self, path: str) -> dict[str, DataFrame]:
        best = lookup.file_tiers(self.files.select("path", "seq"), path).limit(1)
        here = self.symbols.join(best.select(F.col("path").alias("file")), "file", "left_semi")
        e = self.import_edges()
        return {
            "file": best, "symbols": here.filter("kind <> 'import'").select("kind", "name", "class_name", "line"), "imports": here.filter("kind = 'import'").select("source"),
            "importers": e.join(best, e["target"] == best["path"]).select("importer").distinct(),
        }

    def get_class_context(self, name: str, file_path: str | None = None, detail: str = "full") -> dict[str, DataFrame]:
        found = self.classes.filter(F.col("name") == name)
        if file_path:
            found = lookup.narrowed(found, file_path)
        users = self.symbol_imports().filter(F.col("name") == name).select(F.col("importer").alias("file"))
        made = edges.class_instances(self.files, self.classes.filter(F.col("name") == name)).select("file")
        return {
            "matches": lookup.detail(found, detail), "methods": self.methods.filter(F.col("class_name") == name),
            "usages": stats.usages_by_file([users, made]), "subclasses": self.get_subclasses(name, 1), "hints": self._hints("class", name),
        }

    def find_related_code(self, description: str, max_results: int = 10) -> DataFrame:
        """Ranked symbols: heuristic score, caller bonus, source hits, quota merge; low_confidence where nothing fits well."""
        terms, weighted = self._terms(description)
        base = self.functions.select("name", "file", F.coalesce("docstring", F.lit("")).alias("docstring"), F.lit("function").alias("kind"), "seq")
        base = base.union(self.classes.select("name", "file", F.coalesce("docstring", F.lit("")), F.lit("class"), "seq"))
        base = base.union(self.files.select(paths.basename("path"), F.col("path"), F.lit(""), F.lit("file"), "seq"))
        n = self.caller_edges().groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_callers"))
        rows = base.join(n, "name", "left").crossJoin(F.broadcast(weighted))
        score = search.heuristic_score(F.col("name"), F.col("docstring"), F.col("file"), F.lit(description.lower()), F.col("terms"))
        rows = rows.withColumn("score", search.caller_bonus(score, F.coalesce("n_callers", F.lit(0)))).filter("score > 0.12")
        bodies = self.functions.select(F.col("seq").alias("fn_id"), "source")
        hits = search.source_search(search.postings(bodies), terms.withColumn("query_id", F.lit(0)))
        more = hits.join(self.functions.select(F.col("seq").alias("fn_id"), "name", "file"), "fn_id").select("name", F.lit("function").alias("kind"), "file", "score")
        merged = search.quota_merge(rows.select("name", "kind", "file", "score").unionByName(more), max_results)
        return search.low_confidence(merged.withColumn("score", F.round("score", 3)))

    def _terms(self, description: str) -> tuple[DataFrame, DataFrame]:
        q = self.spark.createDataFrame([(description,)], "q string").select(F.explode(text.query_tokens("q")).alias("token"))
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{3,})"), 1))
        symbols = self.functions.select(F.col("seq").alias("id"), text.split_tokens("name").alias("name_tokens"), words(F.col("docstring")).alias("doc_tokens"))
        symbols = symbols.union(self.classes.select("seq", text.split_tokens("name"), words(F.col("docstring"))))
        vocabulary = self.functions.select(F.explode(text.source_tokens("source")).alias("token"))
        terms = search.weights(q, symbols, vocabulary).select("token", "w")
        return terms, q.join(terms, "token").agg(F.array_sort(F.collect_list(F.struct(F.col("token").alias("t"), "w"))).alias("terms"))

    def find_related_files(self, description: str, max_results: int = 5) -> DataFrame:
        symbols = self.find_related_code(description, 10 * max_results).filter("kind <> 'file'").select("file", "score")
        _, weighted = self._terms(description)
        none = F.lit("")
        named = self.files.crossJoin(F.broadcast(weighted)).select(
            F.col("path").alias("file"), search.heuristic_score(paths.basename("path"), none, F.col("path"), F.lit(description.lower()), F.col("terms")).alias("score")
        )
        scored = search.file_scores(symbols, named).filter("score > 0").withColumnRenamed("file", "path")
        return search.directory_cap(scored).orderBy("place").limit(max_results)

    def get_dependency_graph(self, symbol: str, depth: int = 2) -> dict[str, DataFrame]:
        calls = self.functions.select(F.col("name").alias("src"), F.explode("calls").alias("dst")).distinct()
        inside = self.functions.select(F.col("name").alias("node")).union(self.classes.select("name")).distinct()
        forward, externals = callers.forward_dependencies(calls, inside, symbol, depth)
        used = self.callers_of(symbol).select(F.col("caller_file").alias("file"))
        importing = self.symbol_imports().filter(F.col("name") == symbol).select(F.col("importer").alias("file"))
        options = self.functions.select("name", F.lit(0).alias("tier"), "seq").union(self.classes.select("name", F.lit(1), "seq"))
        return {"depends_on": forward, "externals": externals, "used_by": callers.reverse_dependencies(used, importing, importing.limit(0)), "suggestions": lookup.suggestions(options, symbol)}

    def get_call_graph(self, name: str, depth: int = 3, include_builtins: bool = False) -> dict[str, DataFrame]:
        skip = [] if include_builtins else BUILTINS
        calls = self.functions.select(F.col("name").alias("src"), F.explode("calls").alias("dst")).distinct()
        back = self.caller_edges().select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
        return {"calls": callers.call_tree(calls, name, depth, skip), "callers": callers.call_tree(back, name, depth, skip)}

    def get_conventions(self) -> DataFrame:
        f = self.functions.withColumn("language", paths.language("file"))
        names = stats.naming(f.filter("class_name is null").select("language", "name", "seq"))
        share = F.greatest("snake", "camel", "pascal")
        shares = f.agg(
            F.avg(F.col("return_type").isNotNull().cast("int")).alias("typed"), F.avg(F.col("is_async").cast("int")).alias("async"),
            F.avg((F.coalesce("docstring", F.lit("")) != "").cast("int")).alias("documented"), F.count("*").alias("n"),
        ).filter("n > 0")
        one = lambda c, label, conf: shares.select(F.lit(c).alias("category"), F.concat(F.lit(label + " "), F.floor(100 * F.col(c)), F.lit("%")).alias("pattern"), conf.alias("confidence"))
        parts = [
            names.select(F.lit("naming").alias("category"), F.concat("language", F.lit(": "), "style").alias("pattern"), share.alias("confidence")),
            self.classes.agg(F.avg(F.regexp_replace("name", "^_+", "").rlike(stats.PASCAL).cast("int")).alias("confidence")).filter("confidence is not null").select(F.lit("naming").alias("category"), F.lit("classes: PascalCase").alias("pattern"), "confidence"),
            one("typed", "return annotations", F.col("typed")), one("async", "async functions", F.greatest("async", F.lit(0.5))), one("documented", "docstrings", F.col("documented")),
        ]
        used = f.select(F.explode("decorators").alias("decorator")).groupBy(F.regexp_replace(F.regexp_replace("decorator", r"\(.*$", ""), "^@", "").alias("decorator")).agg(F.count("*").alias("n"))
        conf = F.when(F.col("n") >= 5, 0.9).otherwise(0.6)
        parts.append(used.filter("n >= 3").select(F.lit("decorators").alias("category"), F.col("decorator").alias("pattern"), conf.alias("confidence")))
        return stats.conventions(parts)

    def get_unused_symbols(self, symbol_type: str = "functions", include_tests: bool = False, max_results: int = 50) -> DataFrame:
        names = self.symbol_imports().select("name").distinct()
        e = self.caller_edges()
        if symbol_type == "classes":
            owners = e.filter("trusted").join(self.methods.select(F.col("name").alias("callee"), "class_name").distinct(), "callee").select("class_name")
            out = dead.unused_classes(self.classes, names, owners, e.select(F.col("callee").alias("name")), include_tests)
            return out.select("name", "file", "line").orderBy("file", "line").limit(max_results)
        plain = e.select(F.col("callee").alias("name"), F.lit(None).cast("string").alias("class_name"))
        owned = e.join(self.methods.select(F.col("name").alias("callee"), "class_name").distinct(), "callee").select(F.col("callee").alias("name"), "class_name")
        mentions = self.files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"(\w+)\s*\("), 1))).alias("name")).select("name", "file")
        up = callers.ancestors(self.classes).select(F.col("name").alias("class_name"), "ancestor")
        known = self.classes.select(F.col("name").alias("ancestor")).distinct()
        over = up.join(self.methods.select(F.col("class_name").alias("ancestor"), "name").distinct(), "ancestor").select("class_name", "name")
        outside = up.filter(~F.col("ancestor").isin(dead.PLAIN_BASES)).join(known, "ancestor", "left_anti").select("class_name", F.lit(None).cast("string").alias("name"))
        out = dead.unused_functions(self.functions, plain.union(owned).distinct(), names, mentions, names, over.union(outside), include_tests)
        return out.select("name", "class_name", "file", "line", "re_exported").orderBy("file", "line").limit(max_results)

    def get_subclasses(self, name: str, depth: int = 3, file_path: str | None = None) -> DataFrame:
        c = self.classes.select("name", F.explode_outer("bases").alias("base"), "file")
        return callers.subclass_paths(lookup.narrowed(c, file_path) if file_path else c, name, depth)

    def _hints(self, kind: str, name: str | None = None) -> DataFrame:
        """Up to MAX_HINTS next questions: the busiest modules, or the most called functions beside the symbol."""
        if kind == "skeleton":
            top = stats.directory_stats(self._counts(), self.root).select(F.lit("get_module_context").alias("tool"), F.col("dir").alias("argument"), (F.col("n_functions") + F.col("n_classes")).alias("weight"))
        elif kind == "class":
            top = self.methods.filter(F.col("class_name") == name).groupBy("name").agg(F.count("*").alias("weight")).select(F.lit("get_function_context").alias("tool"), F.concat(F.lit(f"{name}."), "name").alias("argument"), "weight")
        else:
            top = self.caller_edges().filter(F.col("callee") == name).groupBy("caller").agg(F.count("*").alias("weight")).select(F.lit("get_function_context").alias("tool"), F.col("caller").alias("argument"), "weight")
        rank = F.row_number().over(Window.orderBy(F.desc("weight"), "argument"))
        return top.orderBy(F.desc("weight"), "argument").limit(MAX_HINTS).withColumn("rank", rank)
