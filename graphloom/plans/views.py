"""Relations of a code base, laid over the driver's tables by SQL that Spark and DuckDB both read.

`relation()` gives the DataFrame; `with_views()` puts the same SQL in front of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # name in many classes, as methods of real code have
    "functions": """SELECT p_partkey AS seq, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '') AS class_name,
        concat('/proj/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '.py') AS file,
        concat(p_name, ' is made by ', p_brand, ' for the ', lower(p_type), ' range') AS docstring, p_size AS size FROM part""",
    "methods": """SELECT p_partkey AS seq, concat(replace(p_name, ' ', '_'), p_size) AS name, replace(p_brand, '#', '') AS class_name,
        concat('/proj/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '.py') AS file FROM part""",
    "classes": """SELECT concat('Region', r_regionkey) AS name, CAST(NULL AS VARCHAR(100)) AS base, '/proj/core/region.py' AS file, r_regionkey AS seq FROM region
        UNION ALL SELECT concat('Nation', n_nationkey), concat('Region', n_regionkey), '/proj/core/nation.py', 100 + n_nationkey FROM nation
        UNION ALL SELECT concat('Supplier', s_suppkey), concat('pkg.Nation', s_nationkey), '/proj/tests/supplier.py', 1000 + s_suppkey FROM supplier""",
    "edges": """SELECT replace(p_name, ' ', '_') AS callee, s_name AS caller, n_name AS caller_file,
        concat('Brand', s_suppkey % 25) AS caller_class, replace(p_brand, '#', '') AS receiver,
        l_returnflag = 'A' AS has_dot, l_linestatus = 'F' AS trusted, l_linenumber AS pass, l_orderkey AS seq
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "symbol_imports": """SELECT DISTINCT c.n_name AS importer, t.n_name AS target, replace(p_name, ' ', '_') AS name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation t ON s_nationkey = t.n_nationkey JOIN part ON l_partkey = p_partkey
        WHERE l_quantity >= 45 AND o_orderpriority LIKE '1%' AND l_returnflag = 'R' AND l_discount >= 0.1""",
    "imports": """SELECT DISTINCT c.n_name AS importer, t.n_name AS target
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation t ON s_nationkey = t.n_nationkey
        WHERE l_quantity >= 45 AND o_orderpriority LIKE '1%' AND l_returnflag = 'R' AND l_discount >= 0.1""",
    "files": """SELECT page_id AS seq, concat('/proj', regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''),
        CASE WHEN page_id % 3 = 0 THEN '.py' WHEN page_id % 3 = 1 THEN '.ts' ELSE '.js' END) AS path, html AS source FROM pages""",
    "sources": "SELECT doc_id AS fn_id, text AS source, lang AS language, source AS file FROM documents",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _used(sql: str, names) -> list[str]:
    import re

    return [n for n in names if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    sql = VIEWS[name]
    for t in _used(sql, TABLES):
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    sql = re.sub(r"\{(\w+)\}(?! (?:ON|AS|WHERE|UNION|JOIN|[a-z]\b))", r"{\1}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _used(VIEWS[name], TABLES)})


def with_views(body: str) -> str:
    """body with the views it reads in front."""
    used = _used(body, VIEWS)
    head = ", ".join(f"v_{n} AS ({VIEWS[n]})" for n in used)
    import re

    for n in used:
        body = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 v_{n}", body)
    if not head:
        return body
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        return ("WITH RECURSIVE " if recursive else "WITH ") + head + ", " + body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
    return f"WITH {head} {body}"
