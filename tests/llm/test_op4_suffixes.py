import hashlib
import random
from collections import Counter

from graphloom.llm import suffixes
from tests.llm.helpers import DOCS, SMALL, awkward_rows, table_dir


def brute(rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + 400] for _, b in texts for i in range(len(b) - 399))
    out = []
    for doc, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in suffixes.op4_suffixes(spark, folder).collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(spark, SMALL) == brute(rows)


def test_edits_and_lengths(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcd é", k=n))
    rows = []
    base = letters(3000)
    for i in range(14):  # copies with an edit here and there
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(["", "X", "YZ"])
        rows.append((i, "".join(t), "en", "s", 1))
    for i, n in enumerate((398, 399, 400, 401, 420, 600, 1000)):  # shared passages about the limit, in unlike texts
        p = letters(n).replace("é", "e")
        rows += [(100 + 2 * i, letters(rng.randrange(300)) + p + letters(50), "en", "s", 1), (101 + 2 * i, p + letters(rng.randrange(300)), "en", "s", 1)]
    rows += [(200, "ab" * 900, "en", "s", 1), (201, "x" * 1000, "en", "s", 1), (202, letters(10) + "x" * 450, "en", "s", 1), (203, base[100:700] + letters(5) + base[100:700], "en", "s", 1)]
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS).repartition(3))
    assert got(spark, folder) == brute(rows)


def test_awkward_and_empty(spark, tmp_path):
    assert got(spark, table_dir(tmp_path / "a", spark)) == brute(awkward_rows())
    assert got(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))) == []
