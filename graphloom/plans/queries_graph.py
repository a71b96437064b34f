"""Queries of the graph families (edges, imports, lookup, callers, dead code) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import callers, edges, imports, lookup, search
from graphloom.plans.views import relation, table, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(" ".join(sql.split()))
        return f

    return add


def _b(c: str):
    return F.col(c).cast("long").alias(c)


FIRST = """row_number() OVER (PARTITION BY callee, caller, caller_file ORDER BY pass, seq, has_dot, trusted, receiver, caller_class) = 1"""
ORDER = ["pass", "seq", "has_dot", "trusted", "receiver", "caller_class"]


@query(f"""WITH d AS (SELECT * FROM edges QUALIFY {FIRST}),
  k AS (SELECT * FROM d WHERE NOT (has_dot AND NOT trusted AND callee IN (SELECT name FROM functions)))
  SELECT callee, count(*) AS n_callers, count(DISTINCT caller_file) AS n_files FROM k GROUP BY callee ORDER BY n_callers DESC, callee LIMIT 20""")
def m0_top_callees(spark, sf):
    """Who is called most: first edge of each key, dotted untrusted calls of known methods dropped."""
    e = edges.drop_ambiguous(edges.first_wins(relation(spark, sf, "edges"), ORDER), relation(spark, sf, "functions"))
    out = e.groupBy("callee").agg(F.count("*").alias("n_callers"), F.count_distinct("caller_file").alias("n_files"))
    return out.orderBy(F.desc("n_callers"), "callee").limit(20)


@query(f"SELECT callee, caller, caller_file, pass::BIGINT AS pass, trusted, seq FROM edges QUALIFY {FIRST}")
def b01_first_wins_dedup(spark, sf):
    e = edges.first_wins(relation(spark, sf, "edges"), ORDER)
    return e.select("callee", "caller", "caller_file", _b("pass"), "trusted", "seq")


@query("""WITH l AS (SELECT class_name, arg_max(file, seq) AS file FROM functions GROUP BY class_name)
  SELECT DISTINCT f.class_name, f.name FROM functions f JOIN l ON f.class_name = l.class_name AND f.file = l.file""")
def b02_class_methods_last_wins(spark, sf):
    return edges.class_methods_last(relation(spark, sf, "functions"))


@query("""WITH d AS (SELECT lower(o_orderstatus) AS language, regexp_replace(o_orderpriority, '^[0-9]-', '') AS decorator, o_orderkey AS seq FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY language, decorator ORDER BY seq) AS rn FROM d)
  SELECT language, decorator, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN CAST(seq AS VARCHAR) END, ',' ORDER BY seq) AS examples FROM r GROUP BY ALL""")
def b03_decorators(spark, sf):
    d = table(spark, sf, "orders").select(
        F.lower("o_orderstatus").alias("language"), F.concat(F.lit("@"), F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.lit("(x)")).alias("decorator"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("example"),
    )
    return edges.decorator_counts(d).select("language", "decorator", "n", F.array_join("examples", ",").alias("examples"))


@query("SELECT name, min(class_name) AS class_name FROM methods GROUP BY name HAVING count(DISTINCT class_name) = 1")
def b05_unique_methods(spark, sf):
    return edges.unique_methods(relation(spark, sf, "methods"))


_CALLS = """SELECT DISTINCT concat(replace(p_name, ' ', '_'), p_size) AS callee, c.c_mktsegment AS var, concat('Brand', l_suppkey % 25) AS caller_class,
  n_name AS caller_file FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 45"""


def _calls(spark, sf) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").filter("l_quantity >= 45").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.col("p_size")).alias("callee"), F.col("c_mktsegment").alias("var"),
        F.concat(F.lit("Brand"), F.col("l_suppkey") % 25).alias("caller_class"), F.col("n_name").alias("caller_file"),
    ).distinct()


@query(f"""WITH u AS (SELECT name, min(class_name) AS target FROM methods GROUP BY name HAVING count(DISTINCT class_name) = 1), c AS ({_CALLS})
  SELECT callee, var, caller_class, caller_file, target FROM c JOIN u ON callee = name WHERE caller_class <> target""")
def b09_unique_method_edges(spark, sf):
    return edges.unique_calls(_calls(spark, sf), relation(spark, sf, "methods")).select("callee", "var", "caller_class", "caller_file", "target")


@query(f"""WITH c AS ({_CALLS}), o AS (SELECT DISTINCT name AS callee, class_name AS target FROM methods),
  few AS (SELECT callee FROM o GROUP BY callee HAVING count(*) <= 5),
  i AS (SELECT DISTINCT importer AS caller_file, concat('Brand', length(name)) AS target FROM symbol_imports),
  m AS (SELECT c.*, o.target, i.target IS NOT NULL AS seen FROM c JOIN o ON c.callee = o.callee JOIN few ON c.callee = few.callee
    LEFT JOIN i ON c.caller_file = i.caller_file AND o.target = i.target)
  SELECT callee, var, caller_class, caller_file, max(CASE WHEN seen THEN target END) AS target FROM m GROUP BY callee, var, caller_class, caller_file
  HAVING count_if(seen) = 1 AND count_if(caller_class = target) = 0""")
def b11_import_disambiguated(spark, sf):
    seen = relation(spark, sf, "symbol_imports").select(F.col("importer").alias("file"), F.concat(F.lit("Brand"), F.length("name")).alias("class_name"))
    return edges.import_calls(_calls(spark, sf), relation(spark, sf, "methods"), seen).select("callee", "var", "caller_class", "caller_file", "target")


@query("""WITH p AS (SELECT path, seq, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM files),
  s AS (SELECT path, seq, ps, unnest(range(1, len(ps) + 1)) AS k FROM p)
  SELECT path, seq, array_to_string(list_slice(ps, len(ps) - k + 1, len(ps)), '/') AS suffix FROM s""")
def b14_suffix_table(spark, sf):
    return imports.suffix_table(relation(spark, sf, "files"))


_LINKS = """l AS (SELECT seq AS imp, path AS importer, regexp_replace(unnest(string_split(source, 'href="/')[2:]), '".*$', '', 's') AS module FROM files)"""


@query("""WITH c AS (SELECT f.path AS importer, f.seq AS imp, g.pr AS prio, concat(split_part(f.path, '/', 3), '/', CAST((f.seq * 7 + g.pr * 25) % 250 AS VARCHAR), g.ext) AS suffix
    FROM files f, (SELECT unnest([0, 1, 2]) AS pr, unnest(['.py', '.ts', '.js']) AS ext) g),
  t AS (SELECT path, seq, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM files),
  s AS (SELECT path, seq, ps, array_to_string(list_slice(ps, len(ps) - k + 1, len(ps)), '/') AS suffix FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM t)),
  lang AS (SELECT c.*, s.path AS target, s.seq, regexp_extract(importer, '[^.]+$') AS el, regexp_extract(s.path, '[^.]+$') AS er FROM c JOIN s ON c.suffix = s.suffix),
  kin AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1, 20)) AS i) WHERE array_to_string(list_slice(string_split(importer, '/')[:-2], 1, i), '/') = array_to_string(list_slice(string_split(target, '/')[:-2], 1, i), '/')
      AND i <= least(len(string_split(importer, '/')) - 1, len(string_split(target, '/')) - 1)) AS shared
    FROM lang WHERE (el = 'py') = (er = 'py'))
  SELECT importer, imp, target, prio::BIGINT AS prio, shared::BIGINT AS shared FROM kin
  QUALIFY row_number() OVER (PARTITION BY importer, imp ORDER BY (el <> er)::INT, prio, shared DESC, seq) = 1""")
def b15_suffix_resolution(spark, sf):
    f = relation(spark, sf, "files")
    ends = F.array(*[F.struct(F.lit(i).alias("pr"), F.lit(e).alias("ext")) for i, e in enumerate((".py", ".ts", ".js"))])
    c = f.select(F.col("path").alias("importer"), F.col("seq").alias("imp"), F.explode(ends).alias("g"))
    c = c.select("importer", "imp", F.col("g.pr").alias("prio"), F.concat(F.split("importer", "/")[2], F.lit("/"), ((F.col("imp") * 7 + F.col("g.pr") * 25) % 250).cast("string"), F.col("g.ext")).alias("suffix"))
    out = imports.resolve(c, imports.suffix_table(f))
    return out.select("importer", "imp", "target", _b("prio"), _b("shared"))


@query("""WITH e AS (SELECT DISTINCT target AS init, name, concat(target, '/', substr(name, 1, 3)) AS source FROM symbol_imports WHERE length(name) % 2 = 0
    UNION ALL SELECT DISTINCT target, CAST(NULL AS VARCHAR), concat(target, '/all') FROM symbol_imports),
  j AS (SELECT i.importer, i.target, i.name, e.source, CASE WHEN e.name IS NULL THEN 1 ELSE 0 END AS prio FROM symbol_imports i JOIN e ON i.target = e.init AND (e.name IS NULL OR e.name = i.name))
  SELECT DISTINCT importer, source AS target FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY importer, target, name ORDER BY prio, source) = 1)""")
def b18_reexports(spark, sf):
    s = relation(spark, sf, "symbol_imports")
    named = s.filter(F.length("name") % 2 == 0).select(F.col("target").alias("init"), "name", F.concat("target", F.lit("/"), F.substring("name", 1, 3)).alias("source"), F.lit(0).alias("prio")).distinct()
    every = s.select(F.col("target").alias("init"), F.lit(None).cast("string").alias("name"), F.concat("target", F.lit("/all")).alias("source"), F.lit(1).alias("prio")).distinct()
    return imports.through_reexports(s, named.union(every))


@query("SELECT DISTINCT trim(unnest(string_split(regexp_extract(concat('from m import ', replace(p_name, ' ', ' as '), ', ', p_type), 'import (.*)$', 1), ','))) AS raw FROM part WHERE false UNION ALL SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) FROM part")
def b20_imported_names(spark, sf):
    stmt = F.concat(F.lit("from m import "), F.regexp_replace("p_name", " ", " as "), F.lit(", "), F.col("p_type"))
    return imports.imported_names(table(spark, sf, "part").select(stmt.alias("source"))).select(F.col("name").alias("raw"))


@query("""SELECT name, class_name, file, seq FROM functions WHERE name = 'red_widget' AND class_name = 'Brand17'""")
def c01_lookup(spark, sf):
    return lookup.by_name(relation(spark, sf, "functions"), "Brand17.red_widget").select("name", "class_name", "file", "seq")


@query("""SELECT name, class_name, seq FROM functions WHERE contains(concat('_', name, '_'), '_red_') AND contains(concat('_', name, '_'), '_widget_')""")
def c02_fuzzy_all_tokens(spark, sf):
    return lookup.fuzzy(relation(spark, sf, "functions"), "red widget").select("name", "class_name", "seq")


@query("SELECT name, file, seq FROM classes WHERE name = 'Nation7'")
def c05_symbol(spark, sf):
    return lookup.symbol(relation(spark, sf, "functions").select("name", "file", "seq", "class_name"), relation(spark, sf, "classes"), "Nation7").select("name", "file", "seq")


@query("""WITH t AS (SELECT path, seq, CASE WHEN path = 'en/25.ts' THEN 0 WHEN path LIKE '%en/25.ts' THEN 1 WHEN split_part(path, '/', -1) = '25.ts' THEN 2 END AS tier FROM files)
  SELECT path, seq, tier::BIGINT AS tier FROM t WHERE tier IS NOT NULL""")
def c04_path_tiers(spark, sf):
    return lookup.file_tiers(relation(spark, sf, "files"), "en/25.ts").select("path", "seq", _b("tier"))


@query("SELECT DISTINCT importer FROM imports WHERE target = 'NATION_9'")
def c06_importers(spark, sf):
    return lookup.importers(relation(spark, sf, "imports"), "NATION_9")


@query("SELECT DISTINCT target FROM imports WHERE importer = 'NATION_3'")
def c07_forward_imports(spark, sf):
    return lookup.forward_imports(relation(spark, sf, "imports"), "NATION_3")


@query("SELECT file, name, min(class_name) AS class_name FROM functions GROUP BY file, name HAVING count(DISTINCT class_name) = 1")
def c08_method_class(spark, sf):
    return lookup.method_class(relation(spark, sf, "functions"))


@query("""WITH s AS (SELECT DISTINCT name, 0 AS tier, min(seq) OVER (PARTITION BY name) AS seq FROM functions UNION ALL SELECT name, 1, seq FROM classes)
  SELECT name, (contains(lower(name), 'red')::INT + contains(lower(name), 'widget')::INT + contains(lower(name), 'nation')::INT)::BIGINT AS score FROM s
  WHERE score > 0 ORDER BY score DESC, tier, seq LIMIT 5""")
def c09_suggestions(spark, sf):
    f = relation(spark, sf, "functions").groupBy("name").agg(F.min("seq").alias("seq")).select("name", F.lit(0).alias("tier"), "seq")
    s = f.union(relation(spark, sf, "classes").select("name", F.lit(1), "seq"))
    return lookup.suggestions(s, "red.widget nation").select("name", _b("score"))


_STYLE = "concat(CASE WHEN doc_id % 2 = 0 THEN 'x = run(1) ' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'a.run (2) ' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'rerun(3)' ELSE '' END)"


@query(f"""SELECT doc_id, CASE WHEN b AND d THEN 'mixed' WHEN d THEN 'dotted' WHEN b THEN 'bare' ELSE 'unknown' END AS style
  FROM (SELECT doc_id, regexp_matches(s, '(^|[^A-Za-z0-9_.])run\\s*\\(') AS b, regexp_matches(s, '\\.run\\s*\\(') AS d FROM (SELECT doc_id, {_STYLE} AS s FROM documents))""")
def c10_call_style(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lookup.call_style(F.expr(_STYLE), "run").alias("style"))


@query("""WITH e AS (SELECT f.path AS a, g.path AS b, f.seq % 4 = 0 AS dot FROM files f JOIN files g ON g.seq = (f.seq * 13 + 5) % 250)
  SELECT a, b FROM e WHERE (a LIKE '%.py') = (b LIKE '%.py') OR dot""")
def c11_language_family(spark, sf):
    f = relation(spark, sf, "files")
    g = f.select(F.col("path").alias("b"), F.col("seq").alias("s2"))
    e = f.join(g, F.col("s2") == (F.col("seq") * 13 + 5) % 250).select(F.col("path").alias("a"), "b", (F.col("seq") % 4 == 0).alias("dot"))
    return e.filter(lookup.same_family(F.col("a"), F.col("b"), F.col("dot"))).select("a", "b")


@query("""WITH u AS (SELECT DISTINCT caller_file AS file, callee AS name FROM edges)
  SELECT file, name FROM u WHERE file IN (SELECT importer FROM symbol_imports) AND (file, name) NOT IN (SELECT (importer, name) FROM symbol_imports)""")
def c12_external_dependencies(spark, sf):
    u = relation(spark, sf, "edges").select(F.col("caller_file").alias("file"), F.col("callee").alias("name")).distinct()
    return lookup.external_dependencies(u, relation(spark, sf, "symbol_imports"))


@query("""WITH l AS (SELECT fn_id, unnest(string_split(source, chr(10))) AS line, generate_subscripts(string_split(source, chr(10)), 1) AS i FROM sources)
  SELECT fn_id, i::BIGINT AS line_no, line FROM l WHERE contains(line, 'thing') QUALIFY row_number() OVER (PARTITION BY fn_id ORDER BY i) <= 3""")
def c14_reference_lines(spark, sf):
    return lookup.reference_lines(relation(spark, sf, "sources"), "thing").select("fn_id", _b("line_no"), "line")


@query("SELECT name, file, seq FROM functions WHERE name = 'red_widget' AND file LIKE '%/promo/%'")
def c15_narrowed(spark, sf):
    f = relation(spark, sf, "functions").filter("name = 'red_widget'")
    return lookup.narrowed(f, "/promo/").select("name", "file", "seq")


@query("SELECT path, seq FROM files ORDER BY path, seq LIMIT 20 OFFSET 40")
def d04_page(spark, sf):
    return lookup.page(relation(spark, sf, "files"), ["path", "seq"], 40, 20).select("path", "seq")


@query("SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) <= 3")
def d11_per_group_cap(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = lookup.per_group(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3)
    return out.select("l_suppkey", "l_orderkey", _b("l_linenumber"), "l_partkey")


@query("SELECT seq, concat('def ', name, '(self, size: int = ', size, ') -> ', class_name) AS signature FROM functions")
def d05_signature(spark, sf):
    p = lambda n, t, d: F.struct(F.lit(n).alias("name"), t.alias("type"), d.alias("default"))
    none = F.lit(None).cast("string")
    f = relation(spark, sf, "functions").withColumn("params", F.array(p("self", none, none), p("size", F.lit("int"), F.col("size").cast("string"))))
    return f.withColumn("is_async", F.lit(False)).withColumn("return_type", F.col("class_name")).select("seq", lookup.signature().alias("signature"))


@query("SELECT DISTINCT callee, caller FROM edges WHERE callee IN (SELECT name FROM methods) OR callee IN (SELECT name FROM functions WHERE size > 40)")
def e03_semi_join(spark, sf):
    known = relation(spark, sf, "functions").filter("size > 40").select("name").union(relation(spark, sf, "methods").select("name")).distinct()
    return relation(spark, sf, "edges").select("callee", "caller").distinct().join(known, F.col("callee") == F.col("name"), "left_semi")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND year(l_shipdate) = 1998)""")
def e04_anti_join(spark, sf):
    sold = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND year(l_shipdate) = 1998").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(sold, "p_partkey", "left_anti")


@query("""WITH q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS t FROM benchmark),
  n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS n FROM documents)
  SELECT t, n FROM q JOIN n ON least(length(t), length(n)) >= 4 AND ((abs(length(t) - length(n)) <= 3 AND left(t, greatest(4, least(length(t), length(n)) - 1)) = left(n, greatest(4, least(length(t), length(n)) - 1)))
    OR (least(length(t), length(n)) >= 7 AND left(t, 5) = left(n, 5)))""")
def e06_stem_join(spark, sf):
    """Stem similarity as an equi-join on the first four characters with a residual."""
    words = lambda df, name: df.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1)).alias(name)).select(F.lower(name).alias(name)).distinct()
    q = words(table(spark, sf, "benchmark"), "t").withColumn("k", F.left("t", F.lit(4)))
    n = words(table(spark, sf, "documents"), "n").withColumn("k", F.left("n", F.lit(4)))
    return q.join(n, "k").filter(text.stem_match("t", "n")).select("t", "n")


_PLAIN = """WITH s AS (SELECT callee, count(*) >= 3 AND avg(has_dot::INT) >= 0.8 AS dotted FROM edges GROUP BY callee)
  SELECT e.callee, count(*) AS n FROM edges e JOIN s ON e.callee = s.callee WHERE NOT ((dotted OR e.callee IN (SELECT name FROM methods)) AND has_dot AND NOT trusted) GROUP BY e.callee"""


@query(_PLAIN)
def g01_callers(spark, sf):
    return callers.plain_callers(relation(spark, sf, "edges"), relation(spark, sf, "methods")).groupBy("callee").agg(F.count("*").alias("n"))


_DEFS = "SELECT DISTINCT class_name, concat('NATION_', length(name)) AS file FROM functions"
_ALLOW = f"""d AS ({_DEFS}), allow AS (SELECT class_name, file FROM d UNION SELECT class_name, importer FROM d JOIN imports ON target = file
  UNION SELECT class_name, importer FROM d JOIN imports ON target = '__init__.py')"""


def _defs(spark, sf) -> DataFrame:
    return relation(spark, sf, "functions").select("class_name", F.concat(F.lit("NATION_"), F.length("name")).alias("file")).distinct()


@query(f"WITH {_ALLOW} SELECT class_name, file FROM allow")
def g04_allow_list(spark, sf):
    return callers.allow_list(_defs(spark, sf), relation(spark, sf, "imports"))


@query(f"""WITH {_ALLOW}, m AS (SELECT DISTINCT name, class_name, concat('NATION_', size % 25) AS file FROM functions),
  w AS (SELECT DISTINCT name AS callee, class_name FROM m WHERE class_name IN ('Brand3', 'Brand7')),
  n AS (SELECT name, count(DISTINCT class_name) AS k FROM m GROUP BY name),
  r AS (SELECT e.callee, w.class_name, e.caller, e.caller_file, e.seq, e.pass, e.caller_class = w.class_name AS same, trusted,
      (e.callee, e.caller_class) IN (SELECT (name, class_name) FROM m) AS own,
      EXISTS (SELECT 1 FROM m WHERE m.name = e.callee AND m.file = e.caller_file AND m.class_name <> w.class_name) AS near,
      coalesce(n.k, 0) >= 2 AS many, (w.class_name, e.caller_file) IN (SELECT (class_name, file) FROM allow) AS allowed,
      has_dot AND lower(e.receiver) <> lower(w.class_name) AS unlike
    FROM edges e JOIN w ON e.callee = w.callee LEFT JOIN n ON n.name = e.callee)
  SELECT callee, class_name, caller, caller_file, count(*) AS n FROM r WHERE same OR ((trusted OR NOT (own OR near OR (many AND NOT allowed))) AND NOT (many AND unlike)) GROUP BY ALL""")
def g02_callers_disambiguated(spark, sf):
    m = relation(spark, sf, "functions").select("name", "class_name", F.concat(F.lit("NATION_"), F.col("size") % 25).alias("file")).distinct()
    wanted = m.filter(F.col("class_name").isin("Brand3", "Brand7")).select(F.col("name").alias("callee"), "class_name").distinct()
    e = relation(spark, sf, "edges").withColumn("receivers", F.when(F.col("has_dot"), F.array("receiver")).otherwise(F.array().cast("array<string>")))
    out = callers.class_callers(e, m, _defs(spark, sf), relation(spark, sf, "imports"), wanted)
    return out.groupBy("callee", "class_name", "caller", "caller_file").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT importer, target FROM imports WHERE importer <> target),
  w AS (SELECT 'NATION_3' AS node, 0 AS depth UNION SELECT e.target, depth + 1 FROM w JOIN e ON e.importer = w.node WHERE depth < 4)
  SELECT node, min(depth)::BIGINT AS depth FROM w GROUP BY node""")
def g06_reachable_calls(spark, sf):
    e = relation(spark, sf, "imports").select(F.col("importer").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct()
    return callers.reach(e, spark.createDataFrame([("NATION_3",)], "node string"), 4).select("node", _b("depth"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT importer, target FROM imports WHERE importer <> target),
  w AS (SELECT n_name AS root, n_name AS node, 0 AS depth FROM nation UNION SELECT root, e.target, depth + 1 FROM w JOIN e ON e.importer = w.node WHERE depth < 3)
  SELECT root, node, min(depth)::BIGINT AS depth FROM w GROUP BY root, node HAVING min(depth) > 0""")
def g09_forward_dependencies(spark, sf):
    e = relation(spark, sf, "imports").select(F.col("importer").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct()
    roots = table(spark, sf, "nation").select(F.col("n_name").alias("node"))
    return callers.reach(e, roots, 3).filter("depth > 0").select("root", "node", _b("depth"))


@query("""WITH u AS (SELECT caller_file AS file, count(*) AS n, 1 AS src FROM edges WHERE callee = 'red_widget' AND NOT trusted GROUP BY 1
    UNION ALL SELECT DISTINCT importer, 1, 2 FROM imports WHERE target = 'NATION_7' UNION ALL SELECT DISTINCT importer, 1, 3 FROM imports WHERE target = 'NATION_9')
  SELECT file, arg_min(n, src)::BIGINT AS n FROM u GROUP BY file""")
def g10_reverse_dependencies(spark, sf):
    i = relation(spark, sf, "imports")
    u = relation(spark, sf, "edges").filter("callee = 'red_widget' AND NOT trusted").select(F.col("caller_file").alias("file"))
    via = lambda t: i.filter(F.col("target") == t).select(F.col("importer").alias("file"))
    return callers.reverse_dependencies(u, via("NATION_7"), via("NATION_9"))


@query("""WITH RECURSIVE c AS (SELECT name, split_part(base, '.', -1) AS parent FROM classes WHERE base IS NOT NULL),
  t AS (SELECT 0 AS depth, 'Region1' AS path, 'Region1' AS node UNION ALL SELECT depth + 1, concat(path, '>', c.name), c.name FROM t JOIN c ON c.parent = t.node WHERE depth < 3)
  SELECT depth::BIGINT AS depth, path, node FROM t WHERE depth > 0""")
def g11_subclass_tree(spark, sf):
    t = callers.subclass_paths(relation(spark, sf, "classes"), "Region1", 3)
    return t.select(_b("depth"), F.array_join("path", ">").alias("path"), "node")


@query("""WITH RECURSIVE c AS (SELECT name, split_part(base, '.', -1) AS parent FROM classes WHERE base IS NOT NULL),
  t AS (SELECT 0 AS depth, ['Region1'] AS path, 'Region1' AS node UNION ALL SELECT depth + 1, list_append(path, c.name), c.name FROM t JOIN c ON c.parent = t.node WHERE depth < 3)
  SELECT node, row_number() OVER (ORDER BY path) AS place FROM t WHERE depth > 0""")
def g08_flatten(spark, sf):
    """Subclasses in depth-first order."""
    flat = callers.flattened(callers.subclass_paths(relation(spark, sf, "classes"), "Region1", 3))
    return search.numbered(flat, ["path"], "place").select("node", _b("place"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT name, split_part(base, '.', -1) AS parent FROM classes WHERE base IS NOT NULL),
  t AS (SELECT name, parent AS ancestor, 1 AS depth FROM c UNION SELECT t.name, c.parent, depth + 1 FROM t JOIN c ON c.name = t.ancestor WHERE depth < 8)
  SELECT name, ancestor, min(depth)::BIGINT AS depth FROM t GROUP BY ALL""")
def g12_ancestors(spark, sf):
    return callers.ancestors(relation(spark, sf, "classes")).select("name", "ancestor", _b("depth"))


@query("""WITH s AS (SELECT 'NATION_7' AS file, 0.8 AS score UNION ALL SELECT 'NATION_9', 0.6),
  one AS (SELECT importer AS file, max(score * 0.5) AS score FROM s JOIN imports ON file = target WHERE importer NOT IN (SELECT file FROM s) GROUP BY importer),
  two AS (SELECT DISTINCT importer AS file FROM (SELECT DISTINCT one.file AS via, importer FROM one JOIN imports ON one.file = target) QUALIFY row_number() OVER (PARTITION BY via ORDER BY importer) <= 3)
  SELECT file, round(score, 6)::DOUBLE AS score, 1::BIGINT AS hop FROM one UNION ALL SELECT file, 0.35::DOUBLE, 2 FROM two WHERE file NOT IN (SELECT file FROM s) AND file NOT IN (SELECT file FROM one)""")
def g14_two_hops(spark, sf):
    s = spark.createDataFrame([("NATION_7", 0.8), ("NATION_9", 0.6)], "file string, score double")
    return callers.two_hops(relation(spark, sf, "imports"), s).select("file", F.round("score", 6).alias("score"), _b("hop"))


@query("""SELECT path, list_contains(string_split(lower(path), '/'), 'tests') AS is_test, CASE regexp_extract(path, '[^.]+$') WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' ELSE 'javascript' END AS language,
  split_part(path, '/', -1) AS base FROM files""")
def h03_path_predicates(spark, sf):
    return relation(spark, sf, "files").filter(~paths.is_ignored("path") & ~paths.is_migration("path")).select(
        "path", paths.is_test("path").alias("is_test"), paths.language("path").alias("language"), paths.basename("path").alias("base")
    )
