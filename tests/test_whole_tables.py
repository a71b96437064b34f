"""Queries over whole tables: brute force on rows that id, size and modulo filters or prefixes would leave out."""

from graphloom.plans import queries_graph, queries_text
from tests.llm.helpers import DOCS, table_dir

SF = "/root/testdata/sf0.001"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_e06_stem_join(spark, tmp_path):
    docs = [(5, "walking", "en", "s", 1), (900, "walked far", "en", "s", 1), (901, "Walker Gamma", "de", "s", 1)]
    table_dir(tmp_path, spark, df=spark.createDataFrame(docs, DOCS))
    folder = table_dir(tmp_path, spark, "benchmark", spark.createDataFrame([(3, "walk"), (150, "gammas")], "item_id long, text string"))
    found = {tuple(r) for r in queries_graph.e06_stem_join(spark, folder).collect()}
    assert found == {("walk", "walking"), ("walk", "walked"), ("walk", "walker"), ("gammas", "gamma")}


def test_j14_normalisers(spark):
    def capped(s):
        return s if s <= 0.85 else 0.85 + 0.15 * (s - 0.85) / (0.15 + s - 0.85)

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_discount").collect()
    found = queries_text.j14_normalisers(spark, SF).collect()
    plain = lambda pairs: sorted((k, round(float(v), 4)) for k, v in pairs)
    assert plain((r.l_orderkey, r.capped) for r in found) == plain((r.l_orderkey, capped(float(r.l_discount) * 12)) for r in rows)


def test_idf_and_scores(spark, tmp_path):
    rows = [(1, "red widget", "Brand#1", "ECONOMY", 1), (700, "red ring", "Brand#2", "ECONOMY", 2), (5000, "green lamp", "Brand#3", "LARGE", 3)]
    folder = table_dir(tmp_path, spark, "part", spark.createDataFrame(rows, PART))
    df = {r.token: (r.df, r.w) for r in queries_text.f06_idf(spark, folder).collect()}
    assert df["red"] == (2, 0.5) and df["widget"] == (1, 1.0) and df["ring"] == (1, 1.0) and df["economy"] == (2, 0.5)
    scored = queries_text.i02_heuristic_score(spark, folder).collect()
    assert sorted((r.query_id, r.id) for r in scored) == [(q, i) for q in (1, 2, 3) for i in (1, 700, 5000)]


def test_i07_source_search(spark, tmp_path):
    docs = [(i, text, "en", "s", 1) for i, text in enumerate(["zebra", "tiger", "horse", "mouse"])]
    table_dir(tmp_path, spark, df=spark.createDataFrame(docs, DOCS))
    items = [(1, "unknown " * 12 + "tiger"), (20, "unknown " * 12 + "zebra"), (199, "horse")]
    folder = table_dir(tmp_path, spark, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    found = sorted(tuple(r) for r in queries_text.i07_source_search(spark, folder).collect())
    assert found == [(1, 1, 0.5, 1), (20, 0, 0.5, 1), (199, 2, 0.82, 1)]


def test_whole_texts(spark, tmp_path):
    texts = ["Ab, " * 100, "x " * 200 + "\nArgs:\n  y"]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame([(4 * i + 3, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    clean = lambda t: "".join(c for c in t.lower().strip(" ") if c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
    assert {r.clean for r in queries_text.j06_normalised(spark, folder).collect()} == set(map(clean, texts))
    assert {tuple(r) for r in queries_text.k08_doc_style(spark, folder).collect()} == {("plain", 1), ("google", 1)}


def test_k02_naming(spark, tmp_path):
    rows = [(i, "red widget", "Brand#1", "LARGE" if i <= 620 else "SMALL", 1) for i in range(1, 921)]
    folder = table_dir(tmp_path, spark, "part", spark.createDataFrame(rows, PART))
    assert {r.language: r.n for r in queries_text.k02_naming(spark, folder).collect()} == {"LARGE": 500, "SMALL": 300}


def callers_tables(tmp_path, spark):
    """Two parts over every size filter, one of them called (on an order that seq % 3 = 0 leaves out)."""
    parts = [(1, "red widget", "Brand#3", "LARGE", 40), (2, "blue ring", "Brand#7", "LARGE", 45), (3, "old lamp", "Brand#9", "LARGE", 2)]
    for name, rows, kind in (
        ("part", parts, PART),
        ("lineitem", [(1, 1, 1, 1, 1.0, 0.0, "N", "F")],
         "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"),
        ("supplier", [(1, "Supplier1", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        ("nation", [(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        ("orders", [(1, 1, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        ("customer", [(1, 0)], "c_custkey long, c_nationkey int"),
    ):
        table_dir(tmp_path, spark, name, spark.createDataFrame(rows, kind))
    return str(tmp_path)


def test_g02_g04_callers(spark, tmp_path):
    folder = callers_tables(tmp_path, spark)
    assert {(r.class_name, r.file) for r in queries_graph.g04_allow_list(spark, folder).collect()} == {("Brand3", "NATION_10"), ("Brand7", "NATION_9"), ("Brand9", "NATION_8")}
    found = [tuple(r) for r in queries_graph.g02_callers_disambiguated(spark, folder).collect()]
    assert found == [("red_widget", "Brand3", "Supplier1", "NATION_0", 1)]
