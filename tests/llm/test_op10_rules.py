import os

import duckdb
import pytest

from graphloom.llm import rules
from tests.llm.helpers import DOCS, SMALL, awkward_rows, table_dir

COLS = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"


def oracle(folder):
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return sorted(con.sql(f"SELECT {COLS} FROM ({rules.OP10_SQL})").fetchall(), key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in rules.op10_rules(spark, folder).select(*COLS.split(", ")).collect()), key=str)


def test_query(spark):
    assert got(spark, SMALL) == oracle(SMALL)


@pytest.mark.parametrize("most", [200_000, 0])
def test_frequent_lines(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(rules, "BROADCAST_LINES", most)
    common = "this very line is found in many documents of one host " * 5
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{common.upper()}\n{own(i)}", "en", "src1", 1) for i in range(60)]
    rows += [(100 + i, f"{common}\nword{i} more", "en", "src1", 1) for i in range(5)]
    rows += [(200, f"{common}\nshort", "en", "src2", 1), (201, f"{common}\nword1 more", "en", "src1", 1)]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS))
    assert got(spark, folder) == oracle(folder)
    kept = {r[0] for r in got(spark, folder) if r[-1]}
    assert kept == {*range(60)}
    out = rules.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {r.doc_id for r in out} == kept and all(r.text == own(r.doc_id) and r.n_chars == len(r.text) for r in out)


def test_short_frequent_lines(spark, tmp_path):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"All rights  reserved.\n{own(i, 60)}\nles.\n", "en", "src1", 1) for i in range(51)]
    rows += [(100, "\n".join([own(100, 48), *["les."] * 9]), "en", "src1", 1), (101, "\n".join([own(101, 50), *["les."] * 9]), "en", "src1", 1)]
    rows += [(102, "\n".join([own(102, 48), *["les."] * 9]), "en", "src2", 1)]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS))
    assert got(spark, folder) == oracle(folder)
    out = {r.doc_id: r.text for r in rules.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert out == {**{i: f"{own(i, 60)}\n" for i in range(51)}, 101: own(101, 50), 102: rows[-1][1]}


def test_awkward_and_empty(spark, tmp_path):
    folder = table_dir(tmp_path / "a", spark, df=spark.createDataFrame([r for r in awkward_rows() if r[0] not in (None, 6)], DOCS))
    assert got(spark, folder) == oracle(folder)
    assert len(got(spark, table_dir(tmp_path / "c", spark))) == 12
    assert got(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))) == []


@pytest.mark.parametrize("most", [200_000, 0])
def test_null_host_is_no_empty_host_and_copies_count(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(rules, "BROADCAST_LINES", most)
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line = "one line that is found in thirty texts of either host"
    rows = [(i, f"{line}\n{own(i)}", "en", None, 1) for i in range(30)] + [(100 + i, f"{line}\n{own(100 + i)}", "en", "", 1) for i in range(30)]
    rows += [(200 + i, f"{own(7)}\n{own(8)}", "en", "src1", 1) for i in range(51)]  # exact copies are documents too
    rows += [(300 + i, f"{line}\n{own(300 + i)}", "en", "src2", 1) for i in range(51)]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS))
    assert got(spark, folder) == oracle(folder)
    out = {r.doc_id: r.text for r in rules.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert out == {r[0]: (own(r[0]) if r[0] >= 300 else r[1]) for r in rows if not 200 <= r[0] < 300}


def test_clashing_names_and_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "s", 5, "a"), (2, None, None, 6, "b")], "doc_id long, text string, source string, `a.b` int, __host string")
    out = rules.judge_documents(df, ["doc_id", "a.b", "__host", "source"])
    assert out.columns == ["doc_id", "a.b", "__host", "source", *rules.NAMES, "cleaned"]
    assert [(r[0], r[1], r[2], r[3], r.n_words) for r in sorted(out.collect())] == [(1, 5, "a", "s", 400_000), (2, 6, "b", None, 0)]
