"""File search and expansion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import filesearch, lookup, search
from graphloom.plans.views import relation, table, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(" ".join(sql.split()))
        return f

    return add


def _tokens(*words: str):
    return F.array(*[F.lit(w) for w in words])


@query("SELECT DISTINCT file AS path, round(avg(size) OVER (PARTITION BY file) / 50 * CASE WHEN split_part(file, '/', 3) = 'promo' THEN 1.3 ELSE 1 END, 6)::DOUBLE AS score FROM functions")
def i22_directory_bonus(spark, sf):
    """`promos` shares its stem with the directory `promo`; `brand` is in file names only."""
    ranks = relation(spark, sf, "functions").groupBy(F.col("file").alias("path")).agg((F.avg("size") / 50).alias("score"))
    return filesearch.with_directory_bonus(ranks, _tokens("promos", "brand")).select("path", F.round("score", 6).alias("score"))


@query("SELECT path, seq, CASE WHEN path LIKE '%.py' THEN 0.5 ELSE 0.75 END::DOUBLE AS score FROM files")
def i22_framework_bias(spark, sf):
    ranks = relation(spark, sf, "files").select("path", "seq", F.lit(0.5).alias("score"), paths.language("path").alias("language"))
    return filesearch.with_framework_bias(ranks, _tokens("state", "redux")).select("path", "seq", "score")


@query("""WITH f AS (SELECT file AS path, split_part(file, '/', 3) = 'promo' AS promo, bool_or(contains(concat('_', name, '_'), '_red_')) AS red FROM functions GROUP BY ALL),
  s AS (SELECT *, (1.0 * promo::INT + 0.8 * red::INT + 0.5) / 2.3 AS c FROM f)
  SELECT path, round(least(1, c * 0.7 * CASE WHEN red THEN 1 ELSE 0.6 END * CASE WHEN promo THEN 1.3 ELSE 1 END), 6)::DOUBLE AS score FROM s WHERE (promo OR red) AND c >= 0.3""")
def i23_admission(spark, sf):
    """Tokens of the question: promo (directories), red (sources) and brand (all file names)."""
    words = F.split("name", "_")
    f = relation(spark, sf, "functions").select(F.col("file").alias("path"), F.explode(words).alias("w")).groupBy("path").agg(F.collect_set("w").alias("tokens"))
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in (("promo", 1.0), ("red", 0.8), ("brand", 0.5))])
    return filesearch.admitted(f, terms).select("path", F.round("score", 6).alias("score"))


_RANKS = "SELECT n_name AS path, round(n_nationkey / 30.0, 6)::DOUBLE AS score FROM nation WHERE n_nationkey % 2 = 1"


def _ranks(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("path"), F.round(F.col("n_nationkey") / 30, 6).alias("score"))


@query(f"""WITH r AS ({_RANKS}), h AS (SELECT n_name AS path, max(s_acctbal) / 10000 * 0.95 AS hit FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
  SELECT coalesce(r.path, h.path) AS path, round(greatest(r.score, h.hit), 6)::DOUBLE AS score FROM r FULL JOIN h ON r.path = h.path""")
def i24_file_fusion(spark, sf):
    hits = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("path"), (F.col("s_acctbal") / 10000).alias("score"))
    return filesearch.fused(_ranks(spark, sf), hits).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH r AS ({_RANKS}), b AS (SELECT * FROM r ORDER BY score DESC, path LIMIT 3),
  i AS (SELECT DISTINCT c.n_name AS importer, t.n_name AS target FROM supplier JOIN customer ON c_custkey % 100 = s_suppkey % 100 JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation t ON s_nationkey = t.n_nationkey)
  SELECT path, score, NULL::VARCHAR AS via FROM r UNION ALL SELECT importer, round(max(score) * 0.45, 6), arg_max(target, score) FROM i JOIN b ON target = path WHERE importer NOT IN (SELECT path FROM r) GROUP BY importer""")
def i24_consumers(spark, sf):
    t = lambda n: table(spark, sf, n)
    near, far = (t("nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x)) for x in ("importer", "target"))
    # Only nations count: each side is reduced to its (remainder, nation) pairs before the remainders, 100 at most, meet.
    c = t("customer").select((F.col("c_custkey") % 100).alias("k"), F.col("c_nationkey").alias("importer_key")).distinct().join(near, "importer_key")
    s = t("supplier").select((F.col("s_suppkey") % 100).alias("k"), F.col("s_nationkey").alias("target_key")).distinct().join(far, "target_key")
    i = s.join(c, "k").select("importer", "target").distinct()
    return filesearch.with_consumers(_ranks(spark, sf), i, 20).select("path", F.round("score", 6).alias("score"), "via")


_RESULTS = "r AS (SELECT name, 'function' AS kind, file, max(size) / 50.0 AS score FROM functions GROUP BY name, file ORDER BY score DESC, name, file LIMIT 30)"


def _results(spark, sf) -> DataFrame:
    r = relation(spark, sf, "functions").groupBy("name", F.lit("function").alias("kind"), "file").agg((F.max("size") / 50).alias("score"))
    return r.orderBy(F.desc("score"), "name", "file").limit(30)


@query(f"""WITH {_RESULTS}, b AS (SELECT * FROM r ORDER BY score DESC, name, file LIMIT 15)
  SELECT caller AS name, caller_file AS file, round(max(score) * 0.55, 6)::DOUBLE AS score FROM edges JOIN b ON callee = name WHERE caller_file <> file GROUP BY caller, caller_file""")
def g15_caller_expansion(spark, sf):
    return filesearch.callers_of(_results(spark, sf), relation(spark, sf, "edges")).select("name", "file", F.round("score", 6).alias("score"))


@query(f"""WITH {_RESULTS}, b AS (SELECT file, max(score) * 0.6 AS score FROM (SELECT * FROM r ORDER BY score DESC, name, file LIMIT 5) GROUP BY file),
  c AS (SELECT f.name, f.file, min(seq) AS seq, any_value(score) AS score FROM functions f JOIN b ON f.file = b.file WHERE (f.name, f.file) NOT IN (SELECT (name, file) FROM r) GROUP BY f.name, f.file)
  SELECT name, file, round(score, 6)::DOUBLE AS score FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq) <= 2""")
def g16_colocated(spark, sf):
    return filesearch.colocated(_results(spark, sf), relation(spark, sf, "functions")).select("name", "file", F.round("score", 6).alias("score"))


@query(f"""WITH {_RESULTS}, b AS (SELECT split_part(file, '/', 3) AS folder, max(score) * 0.45 AS score FROM (SELECT * FROM r ORDER BY score DESC, name, file LIMIT 5) GROUP BY 1)
  SELECT DISTINCT name, file, round(score, 6)::DOUBLE AS score FROM functions JOIN b ON split_part(file, '/', 3) = folder WHERE (name, file) NOT IN (SELECT (name, file) FROM r)""")
def g16_same_directory(spark, sf):
    return filesearch.same_directory(_results(spark, sf), relation(spark, sf, "functions")).select("name", "file", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT string_split(substr(file, 2), '/') AS ps, split_part(name, '_', 1) AS token FROM functions UNION SELECT string_split(substr(file, 2), '/'), split_part(name, '_', 2) FROM functions),
  s AS (SELECT array_to_string(ps[k:], '/') AS suffix, token FROM p, (SELECT unnest([1, 2, 3]) AS k) x)
  SELECT suffix, array_to_string(list_sort(list(DISTINCT token)), ',') AS tokens FROM s GROUP BY suffix""")
def f08_file_token_sets(spark, sf):
    f = relation(spark, sf, "functions").select("file", F.split("name", "_").alias("tokens"))
    return filesearch.file_token_sets(f).select("suffix", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT path, contains(path, '/proj/en/') OR path LIKE '/proj/de/%' AS inside FROM (SELECT path FROM files UNION ALL SELECT concat('/mnt', path) FROM files)")
def c13_project_files(spark, sf):
    """Paths under a root, or under a copy of it."""
    f = relation(spark, sf, "files").select("path")
    both = f.union(f.select(F.concat(F.lit("/mnt"), "path")))
    de = F.col("path").startswith("/proj/de/")
    return both.select("path", (filesearch.in_project(F.col("path"), "/proj/en/") | de).alias("inside"))


_ASKED = """q AS (SELECT s_suppkey AS query_id, s_acctbal / 10000 AS score, s_suppkey % 2 = 0 AS nonsense, CASE s_suppkey % 3 WHEN 0 THEN 'widgets' ELSE 'zzzzz' END AS one,
  concat('tok', s_suppkey % 7) AS two, concat('tok', s_suppkey % 5) AS three FROM supplier)"""


@query(f"""WITH {_ASKED}, n AS (SELECT query_id, (two IN ('tok0', 'tok1', 'tok2'))::INT + (three <> two AND three IN ('tok0', 'tok1', 'tok2'))::INT AS inside FROM q)
  SELECT q.query_id, round(CASE WHEN nonsense AND one = 'zzzzz' AND inside < 2 THEN least(score, 0.35) ELSE score END, 6)::DOUBLE AS score FROM q JOIN n ON q.query_id = n.query_id""")
def i19_gibberish_gate(spark, sf):
    """`widgets` shares its stem with a symbol; tok0 to tok2 are in the sources."""
    table(spark, sf, "supplier").createOrReplaceTempView("files_supplier")
    q = spark.sql(f"WITH {_ASKED} SELECT * FROM q".replace("FROM supplier", "FROM files_supplier"))
    tokens = q.select("query_id", F.explode(F.array("one", "two", "three")).alias("token"))
    symbols = relation(spark, sf, "functions").select(F.explode(F.split("name", "_")).alias("token"))
    inside = spark.range(3).select(F.concat(F.lit("tok"), "id").alias("token"))
    out = search.gated(q.select("query_id", "score"), tokens, symbols, inside, q.filter("nonsense").select("query_id"))
    return out.select("query_id", F.round("score", 6).alias("score"))


@query("""SELECT name, count(*) > 1 AS ambiguous, CASE WHEN count(*) > 1 THEN concat('found ', count(*), ' matches; name a file or class') END AS message,
  string_agg(concat(file, '#', seq), ',' ORDER BY file, seq) AS places FROM functions GROUP BY name""")
def c16_ambiguity_envelope(spark, sf):
    out = lookup.envelope(relation(spark, sf, "functions").select("name", "file", "seq"), ["name"], ["file", "seq"])
    places = F.array_join(F.transform("matches", lambda x: F.concat(x["file"], F.lit("#"), x["seq"])), ",")
    return out.select("name", "ambiguous", "message", places.alias("places"))


@query("SELECT file, string_agg(concat('{\"name\":\"', name, '\",\"seq\":', seq, '}'), ',' ORDER BY seq) AS items FROM functions GROUP BY file")
def d02_nested_strip(spark, sf):
    """Members of a file without their docstrings and class names."""
    item = F.struct("seq", "name", "docstring", "class_name")
    rows = relation(spark, sf, "functions").groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = lookup.stripped(rows, "items", ["docstring", "class_name", "decorators"])
    return out.select("file", F.array_join(F.transform("items", lambda x: F.to_json(F.struct(x["name"].alias("name"), x["seq"].alias("seq")))), ",").alias("items"))
