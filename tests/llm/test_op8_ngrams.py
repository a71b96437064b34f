import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import common, ngrams, prefixjoin, setjoin
from tests.llm.helpers import DOCS, SMALL, awkward_rows, table_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted([(r[0], len(sets[i]), low.get(root(i))) for i, r in enumerate(rows)], key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in ngrams.op8_ngrams(spark, folder).collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(spark, SMALL) == brute(rows)


def test_groups_of_near_copies(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, i = [], 0
    shared = [word() for _ in range(60)]
    for size in (2, 3, 5, 8, 40):
        base = [word() for _ in range(rng.choice((12, 60, 90)))]
        for _ in range(size):
            new = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                new[rng.randrange(len(new))] = word()
            rows.append((i, " ".join(new), "en", "src1", 1))
            i += 1
    for _ in range(40):  # one passage shared by texts that are not similar
        rows.append((i, " ".join(shared + [word() for _ in range(rng.randrange(10, 60))]), "en", "src1", 1))
        i += 1
    rng.shuffle(rows)
    folder = table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS).repartition(3))
    assert got(spark, folder) == brute(rows)
    kept = ngrams.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r[2] for r in brute(rows)})


@pytest.mark.parametrize(("tried", "block"), [(1, 4), (16, 3), (2, 1000)])
def test_chains_and_bridges(spark, tmp_path, monkeypatch, tried, block):
    """Clusters that hang together by single links, looked for with few tries in small blocks and joins by shuffle."""
    monkeypatch.setattr(ngrams, "TRIED", tried)
    monkeypatch.setattr(prefixjoin, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(tried)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for g in range(5):
        base = [word() for _ in range(rng.choice((40, 90, 600)))]
        for i in range(16):
            for _ in range(rng.choice((0, 1, len(base) // 40))):
                base[rng.randrange(len(base))] = word()
            rows.append((1000 * g + rng.randrange(1000), " ".join(base), "en", "s", 1))
    rows = list({r[0]: r for r in rows}.values())
    rng.shuffle(rows)
    assert got(spark, table_dir(tmp_path, spark, df=spark.createDataFrame(rows, DOCS).repartition(3))) == brute(rows)


def test_clashing_names_and_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    near = [*words[:20_000], "other", *words[20_001:]]
    df = spark.createDataFrame([(3, " ".join(words), 1, "x"), (5, " ".join(near), 2, "y"), (7, None, 3, "z")], "doc_id long, text string, th int, `a.b` string")
    assert {r.doc_id: r.component_id for r in ngrams.similar_components(df).collect()} == {3: 3, 5: 3, 7: 7}


def test_awkward_and_empty(spark, tmp_path):
    assert got(spark, table_dir(tmp_path / "a", spark)) == brute(awkward_rows())
    assert got(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=25), st.integers(0, 10**6))
def test_divide_skip(sets, seed):
    rng = random.Random(seed)
    query = set(sets[0])
    for s in sets[1:]:
        if rng.random() < 0.7:
            s.clear()
            s.update(query)
            for _ in range(rng.randrange(4)):
                s.discard(rng.randrange(40))
                s.add(rng.randrange(60))
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = [i for i, s in enumerate(sets) if 5 * len(s & query) >= 4 * len(s | query)]
    assert setjoin.divide_skip(np.array(sorted(query), np.uint64), arrays) == want
