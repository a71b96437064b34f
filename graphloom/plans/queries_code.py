"""Edge passes over synthetic source code, one function per part. Texts are built from part keys, and the SQL twins derive the
expected edges from the same keys by arithmetic alone, without reading a text, so that they test what the patterns find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import callers, dead, edges, imports
from graphloom.plans.views import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return add


#: Functions fn_1 to fn_199 are called; part has 200 rows or more at any scale.
_CALLED = {"t1": 5, "t2": 11, "t3": 7, "t4": 13, "t5": 17, "t6": 19, "t7": 23}
_CODE = ", ".join(f"(k * {m}) % 199 + 1 AS {t}" for t, m in _CALLED.items())
#: k: the function's number; ca, cb, cm: classes of the annotated, the constructed and the factory's variable; owner: its own class.
_KEYS = f"""SELECT *, CASE WHEN k % 2 = 0 THEN t4 % 50 ELSE (t4 + 1) % 50 END AS ca, CASE WHEN k % 2 = 1 THEN t3 % 50 ELSE (t3 + 1) % 50 END AS cb, k % 20 AS cm,
  CASE WHEN k % 3 = 0 THEN k % 50 END AS owner, k % 40 AS home, k % 4 = 0 AS task FROM (SELECT p_partkey AS k, {_CODE} FROM part) q"""
_FACTORIES = "SELECT s_suppkey % 20 AS factory, s_suppkey % 60 AS made, s_suppkey AS seq FROM supplier"
_MADE = f"made AS (SELECT factory, arg_max(made, seq) AS made FROM ({_FACTORIES}) WHERE made < 50 GROUP BY factory)"


def code(spark, sf) -> DataFrame:
    """name, class_name, file, seq, source, calls, decorators, return_type of every function, factories included."""
    table(spark, sf, "part").createOrReplaceTempView("code_part")
    keys = spark.sql(_KEYS.replace("FROM part", "FROM code_part"))
    n, fn = (lambda c: F.col(c).cast("string")), (lambda t: F.concat(F.lit("fn_"), F.col(t).cast("string")))
    kls = lambda c: F.concat(F.lit("Kls"), n(c))
    text = F.concat(
        F.lit("def "), fn("k"), F.lit("(x: "), kls("ca"), F.lit(", y):\n    box = "), kls("cb"), F.lit("()\n    made = await make_"), n("cm"), F.lit("(1)\n    "),
        fn("t1"), F.lit("(x)\n    wrap("), fn("t2"), F.lit(")\n    box."), fn("t3"), F.lit("(2)\n    x."), fn("t4"), F.lit("()\n    made."), fn("t5"), F.lit("()\n    "),
        fn("t6"), F.lit(".delay(3)\n    app.register('/path', "), fn("t1"), F.lit(")\n    app.register('name', "), fn("t7"), F.lit(")\n"),
        F.when(F.col("owner").isNotNull(), F.concat(
            F.lit("    self.dep = "), kls("cb"), F.lit("()\n    self.dep."), fn("t3"), F.lit("()\n    self.late = make_"), n("cm"), F.lit("()\n    self.late."), fn("t5"), F.lit("(4)\n"))).otherwise(""),
    )
    own = keys.select(
        fn("k").alias("name"), F.when(F.col("owner").isNotNull(), kls("owner")).alias("class_name"), F.concat(F.lit("/proj/m"), n("home"), F.lit(".py")).alias("file"),
        F.col("k").alias("seq"), text.alias("source"), F.array(fn("t1"), fn("t3")).alias("calls"),
        F.array(F.when(F.col("task"), F.lit("@app.task(bind=True)")).otherwise("@other")).alias("decorators"), F.lit(None).cast("string").alias("return_type"),
    )
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("f"), (F.col("s_suppkey") % 60).alias("m"), F.col("s_suppkey").alias("q"))
    none = F.array().cast("array<string>")
    made = s.select(
        F.concat(F.lit("make_"), n("f")), F.lit(None).cast("string"), F.lit("/proj/factory.py"), F.col("q") + 10**9, F.lit("def make(n):\n    pass\n"), none, none,
        F.concat(F.lit("Optional[Kls"), n("m"), F.lit("]")),
    )
    return own.union(made)


def classes(spark) -> DataFrame:
    return spark.range(50).select(F.concat(F.lit("Kls"), "id").alias("name"))


def methods(functions: DataFrame) -> DataFrame:
    return functions.filter("class_name is not null").select("class_name", "name")


_BASE = f"WITH c AS ({_KEYS})"
_OUT = "concat('fn_', callee) AS callee, concat('fn_', k) AS caller, concat('/proj/m', home, '.py') AS caller_file"


@query(f"""{_BASE}, one AS (SELECT *, t1 AS callee FROM c UNION ALL SELECT *, t3 FROM c)
  SELECT {_OUT}, list_sort(list_distinct(list_filter([CASE WHEN t3 = callee THEN 'box' END, CASE WHEN t4 = callee THEN 'x' END, CASE WHEN t5 = callee THEN 'made' END,
    CASE WHEN owner IS NOT NULL AND t3 = callee THEN 'self.dep' END, CASE WHEN owner IS NOT NULL AND t5 = callee THEN 'self.late' END], lambda x: x IS NOT NULL))).array_to_string(',') AS receivers FROM one""")
def b01_primary_calls(spark, sf):
    return edges.primary(code(spark, sf)).select("callee", "caller", "caller_file", F.array_join("receivers", ",").alias("receivers"))


@query(f"""{_BASE}, r AS (SELECT k, home, t2 AS callee FROM c) SELECT DISTINCT {_OUT} FROM r WHERE callee <> k""")
def b04_references(spark, sf):
    return edges.references(code(spark, sf)).select("callee", "caller", "caller_file")


@query(f"WITH {_MADE} SELECT concat('make_', factory) AS name, concat('Kls', made) AS type FROM made")
def b05_factories(spark, sf):
    return edges.factories(code(spark, sf), classes(spark)).select("name", "type")


_METHODS = "m AS (SELECT DISTINCT owner, k AS method FROM c WHERE owner IS NOT NULL)"


@query(f"""{_BASE}, {_METHODS}, {_MADE}, t AS (SELECT k, home, t3 AS callee, cb AS type FROM c UNION SELECT k, home, t4, ca FROM c
    UNION SELECT k, home, t5, made FROM c JOIN made ON factory = cm)
  SELECT DISTINCT {_OUT} FROM t JOIN m ON owner = type AND method = callee""")
def b06_typed_calls(spark, sf):
    f = code(spark, sf)
    return edges.typed_calls(f, classes(spark), methods(f)).select("callee", "caller", "caller_file")


@query(f"""{_BASE}, {_METHODS}, {_MADE}, dep AS (SELECT owner AS o, home AS h, arg_max(cb, k) AS type FROM c WHERE owner IS NOT NULL GROUP BY ALL),
  late AS (SELECT owner AS o, home AS h, arg_min(made, k) AS type FROM c JOIN made ON factory = cm WHERE owner IS NOT NULL GROUP BY ALL),
  t AS (SELECT k, home, t3 AS callee, dep.type FROM c JOIN dep ON o = owner AND h = home UNION SELECT k, home, t5, late.type FROM c JOIN late ON o = owner AND h = home)
  SELECT DISTINCT {_OUT} FROM t JOIN m ON m.owner = type AND method = callee""")
def b07_field_calls(spark, sf):
    f = code(spark, sf)
    return edges.field_calls(f, methods(f), edges.factories(f, classes(spark))).select("callee", "caller", "caller_file")


@query(f"""{_BASE}, r AS (SELECT k, home, t6 AS callee FROM c) SELECT DISTINCT {_OUT} FROM r WHERE callee <> k AND callee % 4 = 0""")
def b08_dispatched(spark, sf):
    return edges.dispatched(code(spark, sf)).select("callee", "caller", "caller_file")


@query(f"""{_BASE}, r AS (SELECT k, home, t7 AS callee FROM c) SELECT DISTINCT {_OUT} FROM r WHERE callee <> k""")
def b10_framework_references(spark, sf):
    """A handler registered under a name counts, one registered under a path with a slash does not."""
    f = code(spark, sf)
    return edges.framework_references(f, f.filter("seq < 1000000000"), classes(spark)).select("callee", "caller", "caller_file")


@query("""SELECT concat('Kls', s_suppkey % 70) AS class_name, 'conn' AS var, concat('/proj/s', s_suppkey, '.py') AS file FROM supplier WHERE s_suppkey % 70 < 50
  UNION ALL SELECT concat('Kls', s_suppkey % 50), concat('x', s_suppkey), concat('/proj/s', s_suppkey, '.py') FROM supplier""")
def b13_class_instances(spark, sf):
    n = lambda m: (F.col("s_suppkey") % m).cast("string")
    text = F.concat(
        F.lit("conn = Kls"), n(70), F.lit("()\nx"), F.col("s_suppkey"), F.lit(": Kls"), n(50), F.lit(" = Kls"), n(50), F.lit("(1)\n  inner = Kls1()\nKlsX = Kls2()\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("/proj/s"), "s_suppkey", F.lit(".py")).alias("path"), text.alias("source"))
    return edges.class_instances(files, classes(spark)).select("class_name", "var", "file")


#: A tree of 10 packages of 4 subpackages: module k is in package k % 10, subpackage k % 4.
_MODULE = "concat('/proj/p', {0} % 10, '/q', {0} % 4, '/mod', {0}, '.py')"


def tree(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    inits = spark.range(10).crossJoin(spark.range(5).withColumnRenamed("id", "q"))  # 50 rows
    folder = F.concat(F.lit("/proj/p"), "id", F.when(F.col("q") < 4, F.concat(F.lit("/q"), "q")).otherwise(""), F.lit("/__init__.py"))
    return part.select(F.expr(_MODULE.format("k")).alias("path"), F.col("k").alias("seq")).union(inits.select(folder, (10**9 + F.col("id") * 10 + F.col("q"))))


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part), one AS (SELECT a.k, 1 AS imp, b.k - 20 AS t FROM p a JOIN p b ON b.k = a.k + 40 UNION ALL SELECT a.k, 2, b.k FROM p a JOIN p b ON b.k = a.k + 40)
  SELECT {_MODULE.format('k')} AS importer, imp::BIGINT AS imp, {_MODULE.format('t')} AS target FROM one
  UNION ALL SELECT {_MODULE.format('k')}, 3, concat('/proj/p', k % 10, '/q', (k + 1) % 4, '/__init__.py') FROM p""")
def b17_relative_imports(spark, sf):
    """One dot and a sibling, two dots and a cousin in the same place, two dots and a subpackage."""
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    forms = F.array(*[F.struct(F.lit(i).cast("long").alias("imp"), F.lit(d).alias("dots"), F.expr(r).alias("rest")) for i, d, r in (
        (1, 2, "concat('q', k % 4, '.mod', k + 20)"), (2, 1, "concat('mod', k + 40)"), (3, 2, "concat('q', (k + 1) % 4)"))])
    there = base.select((F.col("k") - 40).alias("k"), F.lit(True).alias("there"))
    rows = base.join(there, "k", "left").select(F.expr(_MODULE.format("k")).alias("importer"), "there", F.explode(forms).alias("s"))
    # A module that is not there is not imported.
    rows = rows.filter("there or s.imp = 3").select("importer", "s.imp", "s.dots", "s.rest")
    return imports.relative_target(rows, imports.suffix_table(tree(spark, sf)))


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part) SELECT DISTINCT {_MODULE.format('k')} AS importer, concat('/proj/p', (k + 3) % 10, '/q', k % 7, '/__init__.py') AS target FROM p WHERE k % 7 < 4
  UNION SELECT {_MODULE.format('k')}, {_MODULE.format('(k * 3 % 199 + 1)')} FROM p""")
def b19_submodules(spark, sf):
    """`from package import sub` for packages and for modules; names that are no files add nothing."""
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(_MODULE.format("p_partkey")).alias("importer"))
    one = k.select("importer", F.expr("concat('/proj/p', (k + 3) % 10, '/__init__.py')").alias("target"), F.expr("concat('q', k % 7)").alias("name"))
    two = k.withColumn("t", F.expr("k * 3 % 199 + 1")).select("importer", F.expr("concat('/proj/p', t % 10, '/q', t % 4, '/__init__.py')"), F.expr("concat('mod', t)"))
    return imports.submodules(one.union(two), imports.suffix_table(tree(spark, sf)))


@query(f"""{_BASE}, called AS (SELECT t1 AS k FROM c UNION SELECT t3 FROM c), imp AS (SELECT k FROM c WHERE k % 9 = 0)
  SELECT concat('fn_', k) AS name, CASE WHEN owner IS NOT NULL THEN concat('Kls', owner) END AS class_name, concat('/proj/m', home, '.py') AS file, k AS seq, k % 9 = 0 AS re_exported FROM c
  WHERE NOT task AND NOT (k IN (SELECT k FROM called) AND (owner IS NULL OR k % 9 = 0 OR k % 2 = 0))""")
def h01_unused_functions(spark, sf):
    """Functions without callers; tasks are reached by their framework. Calls of methods count for a class only where k is even."""
    f = code(spark, sf).filter("seq < 1000000000")
    calls = edges.primary(f).select(F.col("callee").alias("name")).distinct()
    number = F.expr("cast(substr(name, 4) as long)")
    called = calls.join(f.select("name", "class_name"), "name").select("name", F.when(number % 2 == 0, F.col("class_name")).alias("class_name"))
    imported = f.filter("seq % 9 = 0").select("name")
    none = spark.createDataFrame([], "name string, file string")
    bases = spark.createDataFrame([], "class_name string, name string")
    return dead.unused_functions(f, called, imported, none, imported, bases).select("name", "class_name", "file", "seq", "re_exported")


_HEIRS = "SELECT p_partkey AS k, concat('Part', p_partkey) AS name, concat('pkg.Part', p_partkey * 2) AS base, concat('/proj/', CASE WHEN p_partkey % 10 = 0 THEN 'tests/' ELSE '' END, 'm.py') AS file FROM part"


@query(f"""WITH c AS ({_HEIRS}) SELECT name, file FROM c WHERE k % 2 = 1 AND k % 5 <> 0 AND k % 3 <> 0 AND k % 7 <> 0 ORDER BY k""")
def h02_unused_classes(spark, sf):
    """Even numbers are bases of others; multiples of five are constructed, of three imported, and methods of sevens are called."""
    table(spark, sf, "part").createOrReplaceTempView("code_part")
    c = spark.sql(_HEIRS.replace("FROM part", "FROM code_part"))
    of = lambda m, name: c.filter(f"k % {m} = 0").select(F.col("name").alias(name))
    return dead.unused_classes(c, of(3, "name"), of(7, "class_name"), of(5, "name")).select("name", "file")


@query(f"""WITH c AS ({_HEIRS}), n AS (SELECT max(k) AS n FROM c) SELECT name AS class_name, concat('Part', k * d) AS ancestor
  FROM c, n, (SELECT unnest([2, 4, 8]) AS d) x WHERE k > 0 AND k * d <= 2 * n""")
def g13_class_bases(spark, sf):
    """Every base up to three levels up, those that are only named included."""
    table(spark, sf, "part").createOrReplaceTempView("code_part")
    c = spark.sql(_HEIRS.replace("FROM part", "FROM code_part"))
    return callers.ancestors(c, 3).select(F.col("name").alias("class_name"), "ancestor")
