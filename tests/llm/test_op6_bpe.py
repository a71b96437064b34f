import hashlib
import random

from pyspark.sql import functions as F

from graphloom.llm import bpe
from tests.llm.helpers import DOCS, SMALL, awkward, awkward_rows, table_dir


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_words_as_in_the_library():
    own, lib = bpe.Bpe(bpe.tokenizer_path()), library()
    rng = random.Random(1)
    alphabet = [chr(c) for c in (*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), *range(0x300, 0x330), 0x130, 0xFB01, 0x1F600, 0x3000, 0x65E5)]
    texts = ["", "it's WE'LL <|endoftext|>x<|startoftext|> <|other|>", "ΑΣ ΣΑΣ", "a" * 5000, "12345", "é" * 200 + "\x1f\x1c a\x85b"]
    texts += ["".join(rng.choices(alphabet, k=60)) for _ in range(600)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False)
        assert own.encode(t) == want.ids, repr(t)
        assert own.decode(want.ids) == lib.decode(want.ids, skip_special_tokens=False)


def want(text, lib):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    back = lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query(spark):
    lib = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = bpe.op6_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == want(docs[r.doc_id], lib)


def test_awkward(spark, tmp_path):
    lib = library()
    got = [tuple(r) for r in bpe.op6_bpe(spark, table_dir(tmp_path / "a", spark)).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *want(r[1], lib)) for r in awkward_rows()), key=str)
    assert bpe.op6_bpe(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))).count() == 0


def test_round_trip_with_clashing_columns(spark):
    df = awkward(spark).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    rows = bpe.decode(bpe.encode(df)).collect()
    lib = library()
    for r in rows:
        assert r.decoded == lib.decode(lib.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some text", 3, "x", "y")], "doc_id long, text string, `a.b` int, __text string, given string")
    coded = bpe.encode(df, into="c0")
    assert coded.columns == [*df.columns, "c0"]
    (back,) = bpe.decode(coded, ids="c0", into="made").collect()
    assert (back["a.b"], back["__text"], back.given, back.made.strip()) == (3, "x", "y", bpe.Bpe(bpe.tokenizer_path()).decode(coded.first().c0).strip())
