"""Queries of the text families (scalar functions, statistics, search, conventions, learning, streaming) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import callers, learning, search, stats
from graphloom.plans.views import relation, table, with_views
from graphloom.streaming import watch

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(" ".join(sql.split(" ")))
        return f

    return add


def _b(c: str):
    return F.col(c).cast("long").alias(c)


def t1(e: str) -> str:
    return (
        f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace({e}, '[_\\-.\\s/\\\\]+', ' ', 'g'), "
        "'([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '\\s+'), lambda x: x <> '')"
    )


def t2(e: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({e}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-zA-Z0-9]+'), lambda x: length(x) >= 2)"


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS + text.CODE_STOP_WORDS) + "]"


def t3(e: str) -> str:
    names = f"flatten(list_transform(regexp_extract_all({e}, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda w: {t1('w')}))"
    quoted = f"flatten(list_transform(regexp_extract_all({e}, '[\"'']([^\"'']{{3,}})[\"'']', 1), lambda q: list_transform(regexp_extract_all(q, '[a-zA-Z]{{3,}}'), lambda y: lower(y))))"
    return f"list_filter(list_concat({names}, {quoted}), lambda z: length(z) >= 3 AND NOT list_contains({_STOP}, z))"


_IDENT = "concat('get', p_type, '_', replace(p_name, ' ', 'HTTPResponse'), '.', p_brand, 'v2')"


@query(f"SELECT p_partkey, array_to_string({t1(_IDENT)}, ' ') AS tokens FROM part")
def j01_tokens_t1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.split_tokens(F.expr(_IDENT)), " ").alias("tokens"))


@query(f"SELECT p_partkey, array_to_string({t2(_IDENT)}, ' ') AS tokens FROM part")
def j02_tokens_t2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.short_tokens(F.expr(_IDENT)), " ").alias("tokens"))


@query(f"SELECT fn_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT fn_id, {t3('source')} AS t FROM sources)")
def j03_source_tokens(spark, sf):
    s = relation(spark, sf, "sources").withColumn("t", text.source_tokens("source"))
    return s.select("fn_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_STEM = "least(length(a), length(b)) >= 4 AND ((abs(length(a) - length(b)) <= 3 AND left(a, greatest(4, least(length(a), length(b)) - 1)) = left(b, greatest(4, least(length(a), length(b)) - 1))) OR (least(length(a), length(b)) >= 7 AND left(a, 5) = left(b, 5)))"


@query(f"SELECT a, b, {_STEM} AS same FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part), (SELECT DISTINCT split_part(p_name, ' ', 2) AS b FROM part UNION SELECT DISTINCT concat(split_part(p_name, ' ', 1), 'ing') FROM part)")
def j04_stem(spark, sf):
    p = table(spark, sf, "part")
    word = lambda i: F.split("p_name", " ")[i]
    a = p.select(word(0).alias("a")).distinct()
    b = p.select(word(1).alias("b")).union(p.select(F.concat(word(0), F.lit("ing")))).distinct()
    return a.crossJoin(F.broadcast(b)).select("a", "b", text.stem_match("a", "b").alias("same"))  # 16 words by 24


def _bi(e: str) -> str:
    s = f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, i, 2)))"


@query(f"""SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM (SELECT p_partkey, {_bi('p_name')} AS x, {_bi("concat(p_brand, ' ', p_type)")} AS y FROM part)""")
def j05_bigram_jaccard(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(text.jaccard(text.bigrams("p_name"), text.bigrams(F.concat("p_brand", F.lit(" "), "p_type"))), 6).alias("jaccard"))


@query("""SELECT doc_id, regexp_replace(trim(lower(text)), '[^a-z0-9 ]', '', 'g') AS clean FROM documents""")
def j06_normalised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalised("text").alias("clean"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('from ', replace(p_name, ' ', '.'), ' import ', p_type, ', ', lower(p_type), ' as x') WHEN 1 THEN concat('import ', replace(p_name, ' ', '.'))
    WHEN 2 THEN concat('import { ', p_type, ' } from ''../', replace(p_name, ' ', '/'), '.ts''') ELSE concat('from .', p_type, ' import y') END AS src, replace(p_name, ' ', '.') AS dotted, replace(p_name, ' ', '/') AS slashed FROM part)
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN dotted WHEN 1 THEN dotted WHEN 2 THEN slashed ELSE '' END AS module FROM s""")
def j09_import_module(spark, sf):
    src = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('from ', replace(p_name, ' ', '.'), ' import ', p_type, ', ', lower(p_type), ' as x') WHEN 1 THEN concat('import ', replace(p_name, ' ', '.'))
      WHEN 2 THEN concat('import { ', p_type, " } from '../", replace(p_name, ' ', '/'), ".ts'") ELSE concat('from .', p_type, ' import y') END""")
    return table(spark, sf, "part").select("p_partkey", text.import_module(src).alias("module"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN true ELSE false END AS annotated FROM part""")
def j12_return_annotation(spark, sf):
    sig = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('def f(a) -> ', p_type) WHEN 1 THEN concat('function f(a): ', p_type) ELSE 'def f(a: int = 3)' END")
    return table(spark, sf, "part").select("p_partkey", text.return_annotated(sig).alias("annotated"))


@query("""SELECT doc_id, trim(split_part(trim(regexp_replace(split_part(trim(text), chr(10) || chr(10), 1), '[ \\t\\r\\n]+', ' ', 'g')), '. ', 1)) AS sentence FROM documents""")
def j13_first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_sentence("text").alias("sentence"))


@query("""SELECT l_orderkey, round(CASE WHEN s <= .85 THEN s ELSE .85 + .15 * (s - .85) / (.15 + s - .85) END, 6) AS capped, round(least(n / 20, 1), 6) AS sat, round(1 / (1 + exp(-greatest(least(q, 20), -20))), 6) AS sig
  FROM (SELECT l_orderkey, l_discount * 12 AS s, l_linenumber * 4.0 AS n, l_quantity - 25 AS q FROM lineitem)""")
def j14_normalisers(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", F.round(text.soft_cap(F.col("l_discount") * 12), 6).alias("capped"), F.round(text.saturating(F.col("l_linenumber") * 4, 20), 6).alias("sat"), F.round(text.sigmoid(F.col("l_quantity") - 25), 6).alias("sig"))


@query("SELECT lang, count(*) AS n_files FROM documents GROUP BY lang HAVING count(*) >= 2")
def a01_language_detect(spark, sf):
    from graphloom.sources.code import languages

    return languages(table(spark, sf, "documents").select(F.col("lang").alias("language"))).select(F.col("language").alias("lang"), "n_files")


@query("""SELECT CASE regexp_extract(path, '[^.]+$') WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' ELSE 'javascript' END AS language, count(*) AS n_files, sum(seq % 5)::BIGINT AS n_functions, sum(seq % 3)::BIGINT AS n_classes FROM files GROUP BY 1
  UNION ALL SELECT NULL, count(*), sum(seq % 5)::BIGINT, sum(seq % 3)::BIGINT FROM files""")
def f01_project_stats(spark, sf):
    f = relation(spark, sf, "files").select("path", (F.col("seq") % 5).alias("n_functions"), (F.col("seq") % 3).alias("n_classes"))
    return stats.project_stats(f)


@query("""SELECT split_part(path, '/', 3) AS dir, count(*) AS n_files, sum(seq % 5)::BIGINT AS n_functions, sum(seq % 3)::BIGINT AS n_classes FROM files GROUP BY 1""")
def f02_directory_stats(spark, sf):
    f = relation(spark, sf, "files").select("path", (F.col("seq") % 5).alias("n_functions"), (F.col("seq") % 3).alias("n_classes"))
    return stats.directory_stats(f, "/proj")


@query("""WITH f AS (SELECT concat('/proj/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '/', p_partkey, '.py') AS path FROM part),
  d AS (SELECT split_part(path, '/', 3) AS dir, split_part(path, '/', 4) AS sub FROM f)
  SELECT dir, sub, count(*) AS n_files FROM d WHERE dir IN (SELECT dir FROM d GROUP BY dir HAVING count(*) > 330) GROUP BY ALL""")
def f03_drill_down(spark, sf):
    f = table(spark, sf, "part").select(F.expr("concat('/proj/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '/', p_partkey, '.py')").alias("path"))
    return stats.drill_down(f, "/proj", 330)


@query("""SELECT callee, count(*) AS n, arg_min(caller_file, concat(lpad(CAST(seq AS VARCHAR), 12, '0'), caller_file)) AS file FROM edges WHERE callee NOT IN ('red_widget', 'small_ring') GROUP BY callee""")
def f04_call_counts(spark, sf):
    e = relation(spark, sf, "edges").select("callee", F.col("caller_file").alias("file"), F.col("seq").alias("pos"))
    return stats.call_counts(e, ["red_widget", "small_ring"])


@query("""SELECT file, count(*) AS n FROM (SELECT caller_file AS file FROM edges WHERE callee = 'red_widget' UNION ALL SELECT importer FROM symbol_imports WHERE name = 'red_widget' UNION ALL SELECT importer FROM imports) GROUP BY file""")
def f05_usages_by_file(spark, sf):
    e = relation(spark, sf, "edges").filter("callee = 'red_widget'").select(F.col("caller_file").alias("file"))
    s = relation(spark, sf, "symbol_imports").filter("name = 'red_widget'").select(F.col("importer").alias("file"))
    return stats.usages_by_file([e, s, relation(spark, sf, "imports").select(F.col("importer").alias("file"))])


_QUERIES = [(1, "red widget"), (2, "blue gizmos promotional"), (3, "economy ring zzzqqq the")]
_QSQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _QUERIES) + ") AS q(query_id, query)"
_SYM = f"SELECT seq AS id, name, docstring, file, {t1('name')} AS nt, list_distinct(regexp_extract_all(lower(docstring), '[a-z]{{3,}}')) AS dt FROM functions"
_STOPQ = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TERMS = f"qq AS ({_QSQL}), tk AS (SELECT query_id, query, unnest(list_filter({t1('query')}, lambda w: NOT list_contains({_STOPQ}, w))) AS token FROM qq)"


def _stem_sql(a: str, b: str) -> str:
    import re

    return re.sub(r"\bb\b", "\0", re.sub(r"\ba\b", a, _STEM)).replace("\0", b)


_WEIGHTS = f"""{_TERMS}, sy AS ({_SYM}), tt AS (SELECT DISTINCT token FROM tk),
  hits AS (SELECT DISTINCT token, id FROM tt, sy WHERE list_contains(nt, token) OR list_contains(dt, token) OR len(list_filter(nt, lambda n: {_stem_sql('token', 'n')})) > 0),
  dfs AS (SELECT token, count(*) AS df FROM hits GROUP BY token),
  ws AS (SELECT tt.token, coalesce(df, 0)::BIGINT AS df, CASE WHEN df > 0 THEN greatest(0.5, ln((SELECT count(*) FROM sy) / df) / ln((SELECT count(*) FROM sy))) WHEN tt.token IN ('gizmos') THEN 0.6 ELSE 0.3 END AS w FROM tt LEFT JOIN dfs ON tt.token = dfs.token)"""


def _search_inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = spark.createDataFrame(_QUERIES, "query_id int, query string")
    tokens = q.select("query_id", "query", F.explode(text.query_tokens("query")).alias("token"))
    f = relation(spark, sf, "functions")
    symbols = f.select(F.col("seq").alias("id"), "name", "docstring", "file", text.split_tokens("name").alias("name_tokens"), F.array_distinct(F.regexp_extract_all(F.lower("docstring"), F.lit("([a-z]{3,})"), 1)).alias("doc_tokens"))
    vocabulary = spark.createDataFrame([("gizmos",)], "token string")
    return tokens, symbols, search.weights(tokens, symbols, vocabulary)


@query(f"WITH {_WEIGHTS} SELECT token, df, round(w, 6) AS w FROM ws")
def f06_idf(spark, sf):
    return _search_inputs(spark, sf)[2].select("token", "df", F.round("w", 6).alias("w"))


_POST = f"""p AS (SELECT DISTINCT fn_id, unnest({t3('source')}) AS token FROM sources), ix AS (SELECT fn_id, token, count(*) OVER (PARTITION BY token) AS df FROM p),
  kept AS (SELECT * FROM ix WHERE df <= 0.3 * (SELECT count(*) FROM sources))"""


@query(f"WITH {_POST} SELECT token, count(*) AS df, min(fn_id) AS first_id FROM kept GROUP BY token")
def f07_df_prune(spark, sf):
    return search.postings(relation(spark, sf, "sources")).groupBy("token").agg(F.count("*").alias("df"), F.min("fn_id").alias("first_id"))


@query("SELECT callee, count(*) AS n, round(avg(has_dot::INT), 6) AS ratio, count(*) >= 3 AND avg(has_dot::INT) >= 0.8 AS dotted FROM edges GROUP BY callee")
def f10_dot_ratio(spark, sf):
    return callers.dot_ratio(relation(spark, sf, "edges")).withColumn("ratio", F.round("ratio", 6))


@query("""WITH s AS (SELECT concat('^', regexp_replace(trim(lower(p_name)), '[^a-z0-9 ]', '', 'g'), '$') AS s FROM part), g AS (SELECT substr(s, unnest(range(1, length(s))), 2) AS bigram FROM s),
  c AS (SELECT bigram, count(*) AS c FROM g GROUP BY 1), t AS (SELECT sum(c) AS t, count(*) + 1 AS v FROM c)
  SELECT bigram, round(ln((c + 1) / (t + v)), 6) AS logp FROM c, t UNION ALL SELECT '__default__', round(ln(1 / (t + v)), 6) FROM t""")
def f13_bigram_logprob(spark, sf):
    return stats.bigram_log_probs(table(spark, sf, "part").select(F.col("p_name").alias("text")))


@query("""WITH g AS (SELECT substr(lower(p_name), unnest(range(1, length(p_name) - 1)), 3) AS gram FROM part), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 40)
  SELECT gram, n, row_number() OVER (ORDER BY n DESC, gram)::BIGINT AS rank FROM c""")
def f14_trigram_vocabulary(spark, sf):
    return stats.trigram_vocabulary(table(spark, sf, "part").select(F.col("p_name").alias("text")), 40).select("gram", "n", _b("rank"))


@query("""SELECT callee, count(*) AS n_calls, count(DISTINCT caller_file) AS n_files, count(DISTINCT caller) AS n_callers, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY callee""")
def f15_caller_stats(spark, sf):
    return callers.caller_stats(relation(spark, sf, "edges"))


@query("SELECT split_part(base, '.', -1) AS name, count(DISTINCT name) AS n FROM classes WHERE base IS NOT NULL GROUP BY 1")
def f15_subclass_counts(spark, sf):
    return callers.subclass_counts(relation(spark, sf, "classes"))


@query("""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(substr(text, 1, 2000), '[a-z]{3,}')) AS token FROM documents), c AS (SELECT id, token, count(*) AS c FROM t GROUP BY ALL),
  p AS (SELECT *, c / sum(c) OVER (PARTITION BY id) AS p FROM c) SELECT id, round(-sum(p * log2(p)), 4) + 0.0 AS entropy, round(count(*) / sum(c), 6) AS unique_ratio FROM p GROUP BY id""")
def f17_entropy(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.substring("text", 1, 2000), F.lit("([a-z]{3,})"), 1)).alias("token"))
    return stats.entropy(d).select("id", (F.col("entropy") + 0.0).alias("entropy"), "unique_ratio")


@query("""SELECT d.source AS category, sum((quality = (n_chars > 900)::INT)::INT)::BIGINT AS correct, count(*) AS total, round(avg((quality = (n_chars > 900)::INT)::INT), 6) AS accuracy FROM labels JOIN documents d ON d.doc_id = labels.doc_id GROUP BY 1""")
def f19_confusion(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("source").alias("category"), F.col("quality").alias("label"), (F.col("n_chars") > 900).cast("int").alias("predicted"))
    return stats.confusion(rows)


_SW = "list_sum(list_transform(terms, lambda x: x.w))"
_SCORE = f"""{_WEIGHTS}, te AS (SELECT query_id, any_value(query) AS query, list({{'t': tk.token, 'w': w}} ORDER BY tk.token) AS terms FROM tk JOIN ws ON tk.token = ws.token GROUP BY query_id),
  pr AS (SELECT *, {t1('file')} AS pt, flatten(list_transform(string_split(file, '/')[:-2], lambda d: {t1('d')})) AS di, {_SW} AS total FROM te, sy),
  sc AS (SELECT *, list_filter(terms, lambda x: list_contains(nt, x.t)) AS hits,
    coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN list_contains(nt, x.t) THEN x.w WHEN len(list_filter(nt, lambda n: contains(n, x.t) OR contains(x.t, n))) > 0 THEN 0.6 * x.w WHEN len(list_filter(nt, lambda n: {_stem_sql('x.t', 'n')})) > 0 THEN 0.5 * x.w ELSE 0 END)), 0) / total AS cont,
    list_sum(list_transform(terms, lambda x: CASE WHEN contains(lower(docstring), x.t) THEN x.w WHEN len(list_filter(dt, lambda n: {_stem_sql('x.t', 'n')})) > 0 THEN 0.7 * x.w ELSE 0 END)) / total AS ds,
    list_sum(list_transform(terms, lambda x: CASE WHEN list_contains(pt, x.t) THEN x.w WHEN len(list_filter(pt, lambda n: {_stem_sql('x.t', 'n')})) > 0 THEN 0.5 * x.w ELSE 0 END)) / total AS ps,
    list_sum(list_transform(terms, lambda x: CASE WHEN list_contains(di, x.t) THEN x.w WHEN len(list_filter(di, lambda n: {_stem_sql('x.t', 'n')})) > 0 THEN 0.5 * x.w ELSE 0 END)) / total * 1.3 AS dd FROM pr),
  nm AS (SELECT *, greatest(cont, CASE WHEN len(hits) > 0 THEN list_max(list_transform(hits, lambda x: x.w)) * greatest(0.35, len(hits) / len(nt)) ELSE 0 END, CASE WHEN contains(lower(name), query) THEN 0.9 ELSE 0 END) AS ns, len(list_filter(terms, lambda x: x.w <= 0.3)) / len(terms) AS odd FROM sc),
  raw AS (SELECT query_id, id, (0.55 * ns + 0.20 * ds + 0.25 * greatest(ps, dd)) * CASE WHEN odd > 0.5 THEN 1 - 0.5 * odd ELSE 1 END AS s FROM nm)"""


@query(f"WITH {_SCORE} SELECT query_id::BIGINT AS query_id, id, round(CASE WHEN s <= .85 THEN s ELSE .85 + .15 * (s - .85) / (.15 + (s - .85)) END, 5) AS score FROM raw")
def i02_heuristic_score(spark, sf):
    """Every query against every symbol: one broadcast row of weighted terms per query, one Column expression."""
    tokens, symbols, weights = _search_inputs(spark, sf)
    terms = tokens.join(weights.select("token", "w"), "token").groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct(F.col("token").alias("t"), "w"))).alias("terms"))
    rows = symbols.crossJoin(F.broadcast(terms))
    score = search.heuristic_score(F.col("name"), F.col("docstring"), F.col("file"), F.col("query"), F.col("terms"))
    return rows.select(_b("query_id"), "id", F.round(score, 5).alias("score"))


@query("SELECT callee, n, round(CASE WHEN n > 0 AND s > .15 THEN least(1, s + least(.12, .02 * log2(1 + n))) ELSE s END, 6) AS score FROM (SELECT callee, count(*) AS n, avg(has_dot::INT) AS s FROM edges GROUP BY callee)")
def i05_caller_bonus(spark, sf):
    e = relation(spark, sf, "edges").groupBy("callee").agg(F.count("*").alias("n"), F.avg(F.col("has_dot").cast("int")).alias("s"))
    return e.select("callee", "n", F.round(search.caller_bonus(F.col("s"), F.col("n")), 6).alias("score"))


_BQ = "bq AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: true))) AS token FROM benchmark)"


@query(f"""WITH {_POST}, {_BQ}, vc AS (SELECT DISTINCT token FROM kept), ex AS (SELECT query_id, token, 1.0::DOUBLE AS w, token AS use FROM bq WHERE token IN (SELECT token FROM vc)),
  nr AS (SELECT query_id, bq.token, 0.7::DOUBLE AS w, min(v.token) AS use FROM bq JOIN vc v ON left(bq.token, 4) = left(v.token, 4) AND {_stem_sql('bq.token', 'v.token')} WHERE bq.token NOT IN (SELECT token FROM vc) GROUP BY query_id, bq.token),
  h AS (SELECT query_id, fn_id, sum(w) AS s FROM (FROM ex UNION ALL FROM nr) u JOIN kept ON kept.token = u.use GROUP BY query_id, fn_id), tot AS (SELECT query_id, count(*) AS n FROM bq GROUP BY query_id),
  sc AS (SELECT h.query_id, fn_id, least(0.82, round(s / n, 6)) AS score FROM h JOIN tot ON h.query_id = tot.query_id)
  SELECT query_id, fn_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fn_id) AS rank FROM sc WHERE score > 0.10) WHERE rank <= 20""")
def i07_source_search(spark, sf):
    b = table(spark, sf, "benchmark")
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1))).alias("token"), F.lit(1.0).alias("w"))
    return search.source_search(search.postings(relation(spark, sf, "sources")), terms).select("query_id", "fn_id", "score", _b("rank"))


@query(f"SELECT seq, substr(concat(class_name, '.', name, ' in ', split_part(file, '/', -1), ': ', substr(docstring, 1, 100), '. ', array_to_string(list_slice({t1('name')}, 1, 20), ' ')), 1, 256) AS document FROM functions WHERE split_part(name, '_', 1) <> split_part(name, '_', 2)")
def i10_function_documents(spark, sf):
    f = relation(spark, sf, "functions").filter("split_part(name, '_', 1) <> split_part(name, '_', 2)")
    doc = search.function_document(F.col("name"), F.col("class_name"), F.col("file"), F.col("docstring"), text.split_tokens("name"))
    return f.select("seq", doc.alias("document"))


@query("""WITH r AS (SELECT file, name, substr(docstring, 1, 60) AS d, row_number() OVER (PARTITION BY file ORDER BY seq, name) AS rn, seq FROM functions)
  SELECT file, substr(concat(array_to_string(string_split(file, '/')[-3:], '/'), ': ', string_agg(CASE WHEN rn <= 15 THEN name END, ', ' ORDER BY rn), '. ', string_agg(CASE WHEN rn <= 5 THEN d END, ' ' ORDER BY rn)), 1, 512) AS document FROM r GROUP BY file""")
def i11_file_documents(spark, sf):
    return search.file_documents(relation(spark, sf, "functions"))


@query("""WITH b AS (SELECT seq // 10000 AS blk, sha256(string_agg(concat(name, ':', file, ':', class_name), chr(10) ORDER BY seq)) AS h FROM functions GROUP BY 1) SELECT left(sha256(string_agg(h, '' ORDER BY blk)), 16) AS fingerprint FROM b""")
def i12_fingerprint(spark, sf):
    return search.fingerprint(relation(spark, sf, "functions"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(least(1, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
  SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.15) WHERE rank <= 20""")
def i13_vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.vector_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 0.15, 20).select("query_id", "id", "score", _b("rank"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(least(1, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
  SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.20) WHERE rank <= 10""")
def i14_file_vectors(spark, sf):
    """The ten nearest files of 0.20 or more."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.vector_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 0.20, 10).select("query_id", "id", "score", _b("rank"))


_RES = "SELECT DISTINCT name, CASE size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'file' END AS kind, file, round((seq % 97) / 97.0, 4)::DOUBLE AS score FROM functions"


@query(f"""WITH r AS (SELECT name, kind, file, max(score) AS score FROM ({_RES}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, name, file) <= CASE WHEN kind = 'file' THEN 4 ELSE 6 END AS inside FROM r)
  SELECT name, kind, file, score, row_number() OVER (ORDER BY inside DESC, score DESC, name, file) AS place FROM k ORDER BY place LIMIT 20""")
def i16_quota_merge(spark, sf):
    f = relation(spark, sf, "functions")
    kind = F.when(F.col("size") % 3 == 0, "function").when(F.col("size") % 3 == 1, "class").otherwise("file")
    rows = f.select("name", kind.alias("kind"), "file", F.round((F.col("seq") % 97) / 97.0, 4).alias("score"))
    return search.quota_merge(rows, 20).select("name", "kind", "file", "score", _b("place"))


@query("""WITH k AS (SELECT doc_id AS id, round((doc_id % 89) / 89.0, 4)::DOUBLE AS k FROM documents WHERE doc_id % 3 = 0), v AS (SELECT doc_id AS id, round((doc_id % 61) / 61.0, 4)::DOUBLE AS v FROM documents WHERE doc_id % 2 = 0)
  SELECT id, score FROM (SELECT coalesce(k.id, v.id) AS id, CASE WHEN k IS NULL THEN CASE WHEN v > .3 THEN v END WHEN v > .2 THEN greatest(k, v) ELSE k END AS score FROM k FULL JOIN v ON k.id = v.id) WHERE score IS NOT NULL""")
def i17_fusion(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    part = lambda m, p: d.filter(F.col("id") % m == 0).select("id", F.round((F.col("id") % p) / float(p), 4).alias("score"))
    return search.fuse(part(3, 89), part(2, 61))


@query("""WITH p AS (SELECT doc_id AS id, (doc_id % 89) / 89.0 AS score FROM documents WHERE doc_id % 3 = 0), m AS (SELECT doc_id AS id, (doc_id % 61) / 61.0 AS score FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT id FROM p)),
  u AS (SELECT id, score, 1 AS tier FROM (FROM p ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT id, score, 2 FROM (FROM m ORDER BY score DESC, id LIMIT 5))
  SELECT id, round(score, 6)::DOUBLE AS score, tier::BIGINT AS tier, row_number() OVER (ORDER BY tier, u.score DESC, id) AS place FROM u""")
def i18_expansion(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    part = lambda m, p: d.filter(F.col("id") % m == 0).select("id", ((F.col("id") % p) / float(p)).alias("score"))
    return search.with_expansion(part(3, 89), part(2, 61), 10).select("id", F.round("score", 6).alias("score"), _b("tier"), _b("place"))


@query("""WITH s AS (SELECT file, max(r) AS s, count(*) AS n FROM (SELECT file, (seq % 101) / 101.0 AS r FROM functions) WHERE r > 0.15 GROUP BY file), f AS (SELECT DISTINCT file, 0.6 * length(file) / 100.0 AS f FROM functions WHERE file LIKE '%1%' UNION SELECT '/other.py', 0.3)
  SELECT coalesce(s.file, f.file) AS file, round(greatest(coalesce(s, 0), coalesce(f, 0)), 6)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS n_symbols FROM s FULL JOIN f ON s.file = f.file""")
def i21_file_scores(spark, sf):
    f = relation(spark, sf, "functions")
    symbols = f.select("file", ((F.col("seq") % 101) / 101.0).alias("score"))
    names = f.filter("file LIKE '%1%'").select("file", (F.length("file") / 100.0).alias("score")).distinct().union(spark.createDataFrame([("/other.py", 0.5)], "file string, score double"))
    return search.file_scores(symbols, names).select("file", "score", _b("n_symbols"))


@query("""WITH f AS (SELECT path, round((seq % 83) / 83.0, 6)::DOUBLE AS score, array_to_string(string_split(path, '/')[:-2], '/') AS dir FROM files), r AS (SELECT path, score, (row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) > 2)::INT AS over FROM f)
  SELECT path, score, over::BIGINT AS over, row_number() OVER (ORDER BY over, score DESC, path) AS place FROM r""")
def i25_directory_cap(spark, sf):
    f = relation(spark, sf, "files").select("path", F.round((F.col("seq") % 83) / 83.0, 6).alias("score"))
    return search.directory_cap(f).select("path", "score", _b("over"), _b("place"))


@query("""WITH r AS (SELECT p_type AS language, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat(split_part(p_name, ' ', 1), upper(left(split_part(p_name, ' ', 2), 1)), substr(split_part(p_name, ' ', 2), 2)) ELSE p_type END AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part),
  h AS (SELECT * FROM r WHERE rn <= 500), a AS (SELECT language, count(*) AS n, round(avg(regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$')::INT), 6) AS snake, round(avg(regexp_matches(name, '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$')::INT), 6) AS camel, round(avg(regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')::INT), 6) AS pascal FROM h GROUP BY language)
  SELECT *, CASE WHEN snake >= greatest(camel, pascal) THEN 'snake_case' WHEN camel >= pascal THEN 'camelCase' ELSE 'PascalCase' END AS style FROM a""")
def k02_naming(spark, sf):
    second = F.split("p_name", " ")[1]
    name = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", " ", "_")).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.split("p_name", " ")[0], F.upper(F.left(second, F.lit(1))), F.substring(second, 2, 99))).otherwise(F.col("p_type"))
    return stats.naming(table(spark, sf, "part").select(F.col("p_type").alias("language"), name.alias("name"), F.col("p_partkey").alias("seq")))


@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN 'Widget' ELSE 'index' END AS stem FROM part),
  s AS (SELECT CASE WHEN stem LIKE '%\\_%' ESCAPE '\\' THEN 'snake_case' WHEN stem LIKE '%-%' THEN 'kebab-case' WHEN stem = 'Widget' THEN 'PascalCase' END AS style FROM f)
  SELECT style, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s WHERE style IS NOT NULL GROUP BY style""")
def k04_file_naming(spark, sf):
    m = F.col("p_partkey") % 4
    stem = F.when(m == 0, F.regexp_replace("p_name", " ", "_")).when(m == 1, F.regexp_replace("p_name", " ", "-")).when(m == 2, "Widget").otherwise("index")
    return stats.file_naming(table(spark, sf, "part").select(F.concat(F.lit("/src/"), stem, F.lit(".py")).alias("path")))


@query("""SELECT round(avg(seq % 7), 6) AS avg_functions, round(count_if(seq % 3 = 1) / count_if(seq % 3 > 0), 6) AS one_class, 0::BIGINT AS test_prefix, 0::BIGINT AS test_suffix FROM files""")
def k05_structure(spark, sf):
    return stats.structure(relation(spark, sf, "files").select("path", (F.col("seq") % 7).alias("n_functions"), (F.col("seq") % 3).alias("n_classes")))


@query("""SELECT style, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'numpy' WHEN 2 THEN 'sphinx' ELSE 'plain' END AS style FROM documents) GROUP BY style""")
def k08_doc_style(spark, sf):
    m = F.col("doc_id") % 4
    tail = F.when(m == 0, "\nArgs:\n  x").when(m == 1, "\nParameters\n-----\n").when(m == 2, "\n:param x: y").otherwise("")
    return table(spark, sf, "documents").select(stats.doc_style(F.concat("text", tail)).alias("style")).groupBy("style").agg(F.count("*").alias("n"))


_HREF = "SELECT DISTINCT page_id AS file, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"


def _links(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).distinct()


@query(f"SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN target LIKE '.%' OR target LIKE '/%' THEN 'relative' ELSE 'absolute' END AS kind FROM ({_HREF})) GROUP BY kind")
def k09_link_style(spark, sf):
    return stats.import_style(_links(spark, sf))


@query(f"""WITH l AS (SELECT file, regexp_replace(string_split_regex(regexp_replace(target, '^[./]+', ''), '[./]')[1], '[,;:]', '', 'g') AS package FROM ({_HREF}))
  SELECT package, count(DISTINCT file) AS n_files FROM l WHERE length(package) > 1 GROUP BY package ORDER BY n_files DESC, package LIMIT 10""")
def k10_top_packages(spark, sf):
    return stats.top_packages(_links(spark, sf))


@query("SELECT p_type AS decorator, count(*) AS n, round(least(.95, count(*) / 2000 + .5), 6) AS confidence FROM part GROUP BY 1 HAVING count(*) >= 5")
def k11_decorators(spark, sf):
    used = table(spark, sf, "part").groupBy(F.col("p_type").alias("decorator")).agg(F.count("*").alias("n"))
    return stats.decorators(used, 2000)


@query("""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'typing' ELSE 'naming' END AS category, concat('pattern ', toxic) AS pattern, round(avg(doc_id % 2), 2) AS confidence FROM labels GROUP BY quality, toxic) SELECT * FROM c""")
def k01_conventions(spark, sf):
    rows = table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.avg(F.col("doc_id") % 2).alias("confidence"))
    parts = [rows.filter(c).select(F.lit(n).alias("category"), F.concat(F.lit("pattern "), "toxic").alias("pattern"), "confidence") for c, n in (("quality = 1", "typing"), ("quality = 0", "naming"))]
    return stats.conventions(parts)


@query("""SELECT s_suppkey AS id, round(least(c / 20, 1), 6) AS f0, round(least(n / 30.0, 1), 6) AS f8, round(least((c + 1) / 50, 1), 6) AS fallback FROM (SELECT s_suppkey, any_value(length(s_name)) AS n, count(l_orderkey) AS c FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)""")
def l04_importance_features(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    g = s.groupBy(F.col("s_suppkey").alias("id")).agg(F.first("s_name").alias("name"), F.count("l_orderkey").alias("n_callers"))
    rows = g.select("id", "name", F.lit("/src/api/x.py").alias("file"), "n_callers", F.lit(1).alias("n_files"), F.lit(1).alias("n_importers"), F.lit(0).alias("n_methods"))
    f = learning.importance_features(rows)
    return f.select("id", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[8], 6).alias("f8"), F.round(learning.importance_fallback(F.col("n_callers"), F.col("n_importers")), 6).alias("fallback"))


@query("""WITH s AS (SELECT p_partkey, concat('^', regexp_replace(trim(lower(p_name)), '[^a-z0-9 ]', '', 'g'), '$') AS s FROM part), g AS (SELECT p_partkey, substr(s, unnest(range(1, length(s))), 2) AS g FROM s),
  pl AS (SELECT p_partkey, list_sum(list_transform([1, 2], lambda k: CASE k WHEN 1 THEN 29 ELSE 1 END * CASE substr(g, k, 1) WHEN '^' THEN 26 WHEN '$' THEN 27 WHEN ' ' THEN 28 ELSE ascii(substr(g, k, 1)) - 97 END))::BIGINT AS place FROM g),
  c AS (SELECT p_partkey, place, count(*) AS c FROM pl GROUP BY ALL) SELECT p_partkey, place, round(c / sqrt(sum(c * c) OVER (PARTITION BY p_partkey)), 6) AS v FROM c""")
def l06_bigram_vector(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.explode(learning.bigram_vector(F.col("p_name"))).alias("x"))
    return rows.select("p_partkey", F.col("x.i").cast("long").alias("place"), F.round("x.v", 6).alias("v"))


@query("""SELECT doc_id, round(.30 * (lang = 'en')::INT + .25 * (source = 'src1')::INT + .15 * (n_chars > 10)::INT + .10 * (n_chars % 2 > 0)::INT + .10 * (n_chars > 3)::INT + .10 * (doc_id % 2 = 0)::INT, 6)::DOUBLE AS score,
  (round(.30 * (lang = 'en')::INT + .25 * (source = 'src1')::INT + .15 * (n_chars > 10)::INT + .10 * (n_chars % 2 > 0)::INT + .10 * (n_chars > 3)::INT + .10 * (doc_id % 2 = 0)::INT, 6) >= .5)::BIGINT AS label FROM documents""")
def l13_proxy_importance(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", (F.col("lang") == "en").alias("in_readme"), (F.col("source") == "src1").alias("in_api"), F.col("n_chars").alias("n_files"), (F.col("n_chars") % 2).alias("n_subclasses"), (F.col("doc_id") % 2 == 0).alias("in_all"))
    return learning.proxy_importance(rows).select("doc_id", "score", _b("label"))


@query("""SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS b FROM documents)""")
def l15_hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", learning.hash_split(F.col("doc_id")).alias("split"))


@query("""WITH r AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[:10] AS ranked, max(o_orderkey) AS expected, max(o_totalprice) AS latency FROM orders GROUP BY 1), p AS (SELECT coalesce(list_position(ranked, expected), 0) AS rank, latency FROM r)
  SELECT round(avg(CASE WHEN rank > 0 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END), 6) AS mrr, round(median(latency), 6) AS p50, count(*) AS n FROM p""")
def l22_ndcg_mrr(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"]), 1, 10).alias("ranked"),
        F.max("o_orderkey").alias("expected"), F.max("o_totalprice").alias("latency"),
    )
    return stats.retrieval_metrics(o)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sid""")
def m03_debounce_sessions(spark, sf):
    return watch.debounced(table(spark, sf, "events"), "12 hours", ["user_id"])


@query("""SELECT event_id, path FROM (SELECT event_id, event_type, concat('/src/', event_type, CASE event_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.txt' ELSE '/node_modules/x.js' END) AS path FROM events) WHERE event_id % 4 < 2 AND event_type IN ('click', 'view', 'error', 'purchase')""")
def m02_event_filter(spark, sf):
    kind = F.create_map(*[F.lit(x) for x in ("click", "created", "view", "modified", "error", "deleted", "purchase", "moved", "signup", "other")])
    m = F.col("event_id") % 4
    end = F.when(m == 0, ".py").when(m == 1, ".ts").when(m == 2, ".txt").otherwise("/node_modules/x.js")
    e = table(spark, sf, "events").select("event_id", kind[F.col("event_type")].alias("type"), F.concat(F.lit("/src/"), "event_type", end).alias("path"), F.lit(None).cast("string").alias("dest"))
    return watch.relevant(e).select("event_id", "path")


@query()
def l07_mlp_forward(spark, sf):
    """Inference over feature arrays with a network fitted on a bounded sample (rows-only: a model has no SQL form)."""
    import numpy as np

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    sample = rows.orderBy("vec_id").limit(500).toPandas()
    model = learning.Mlp.fit(np.stack(sample["features"]), (sample["label"] < 5).to_numpy(float), epochs=10)
    return learning.predict(rows.select("vec_id", "features"), model).select("vec_id", "score")


@query()
def a04_python_ast(spark, sf):
    """Symbols of the engine's own functions package, parsed on executors (rows-only: a parser has no SQL form)."""
    import os

    from graphloom.sources import code

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return code.symbols(code.files(spark, os.path.join(root, "functions"))).select("kind", "name", "class_name", "file", "line")


@query()
def b12_object_methods(spark, sf):
    from graphloom.sources import code

    text_ = F.concat(F.lit("export const api"), F.col("conv_id"), F.lit(" = { run() { return '}' }, stop: async () => 1, _hidden() {} };"))
    rows = table(spark, sf, "conversations").select(F.concat("role", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text_.alias("source"))
    return code.object_literals(rows)
