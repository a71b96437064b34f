import os

import duckdb
from pyspark.sql import functions as F

from graphloom.llm import mixture
from tests.llm.helpers import DOCS, SMALL, awkward, table_dir


def oracle(folder):
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return sorted(con.sql(mixture.OP3_SQL).fetchall(), key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in mixture.op3_mixture(spark, folder).collect()), key=str)


def test_query(spark):
    assert got(spark, SMALL) == oracle(SMALL)


def test_awkward_and_empty(spark, tmp_path):
    folder = table_dir(tmp_path / "a", spark)
    assert got(spark, folder) == oracle(folder)
    assert got(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))) == []


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10), ("web", "en", "b", 500), ("books", "en", "c", 500), ("reference", "de", "d", 500)],
        "domain string, lang string, source string, tokens long",
    )
    plan = {r.source: r.quota for r in mixture.plan_leaves(leaves, {"web": 1, "books": 1, "reference": 1}, {}, (1, 2), 1).collect()}
    # A third of 755 each; web's leaf a can take 10 of its 125, so its sibling b takes the rest of web's share.
    assert plan == {"a": 10, "b": 241, "c": 251, "d": 251}


def test_extra_columns(spark):
    df = awkward(spark).withColumn("w", F.lit(1)).withColumn("cut", F.lit("x"))
    assert "w" in mixture.mix(df).columns and mixture.mix(df).count() > 0


def test_null_is_no_name(spark, tmp_path):
    rows = [(i, "w " * (i % 5 + 1), lang, source, 1) for i, (lang, source) in enumerate([(None, None), ("unknown", "unknown"), ("", ""), ("=", None)] * 20)]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS))
    assert got(spark, folder) == oracle(folder)
    leaves = mixture.mix(spark.read.parquet(f"{folder}/documents.parquet"), budget=(1, 1)).select("lang", "source").distinct().count()
    assert leaves == 4
