"""run() against a version that applies each stage's rule by brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pandas as pd

import corpus_pipeline
from graphloom.llm import bpe, mixture, rules
from tests.llm.helpers import DOCS, SMALL, awkward, table_dir
from tests.llm.test_op8_ngrams import brute as components
from tests.llm.test_op9_lines import brute as without_repeats


def judged(frame):
    con = duckdb.connect()
    con.register("documents", frame)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({rules.OP10_SQL}) WHERE kept").fetchall()}
    return frame[frame.doc_id.isin(kept)]  # no line reaches the limit in tables this small


def mixed(frame):
    con = duckdb.connect()
    con.register("documents", frame)
    return {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixture.OP3_SQL})").fetchall()}


def test_run(spark):
    frame = judged(spark.read.parquet(f"{SMALL}/documents.parquet").toPandas())
    texts = without_repeats(list(frame.itertuples(index=False, name=None)))
    frame = frame.assign(text=[texts[i] for i in frame.doc_id])
    frame = frame[[bool(re.search(r"[^\x20\x09-\x0D]", t)) for t in frame.text]]
    heads = {c for _, _, c in components(list(frame.itertuples(index=False, name=None)))}
    frame = frame[frame.doc_id.isin(heads)].reset_index(drop=True)
    copies = mixed(frame)
    model = bpe.Bpe(bpe.tokenizer_path())
    want = defaultdict(int)
    for r in frame.itertuples():
        if copies.get(r.doc_id):
            want[r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), tuple(model.encode(r.text))] += copies[r.doc_id]
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert r.n_tokens == len(r.ids) and r.n_chars == len(r.text)
        got[r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), tuple(r.ids)] += 1
    assert got == want and len(got) > 50


def test_awkward_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, table_dir(tmp_path / "a", spark)).columns[:5] == awkward(spark).columns
    empty = spark.createDataFrame(pd.DataFrame({c: [] for c in ("doc_id", "text", "lang", "source", "n_chars")}), DOCS)
    assert corpus_pipeline.run(spark, table_dir(tmp_path / "b", spark, df=empty)).count() == 0
