"""Every pair of similar sets can be had from what the prefix join gives back."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import common, prefixjoin
from graphloom.llm.words import HASH

CLASSES = "node long, n int, parity binary, prefix binary"


def classes_of(spark, sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    counts = np.array([len(a) for a in arrays])
    parity = prefixjoin.parities(np.concatenate(arrays), counts).to_pylist()
    rows = [(i, len(a), p, prefixjoin.pack(a[: int(prefixjoin.prefix_length(len(a)))])) for i, (a, p) in enumerate(zip(arrays, parity, strict=True))]
    return spark.createDataFrame(rows, CLASSES).repartition(3)


@pytest.mark.parametrize(("limit", "seed"), [(2048, 1), (2048, 2), (4, 3), (3, 4), (10, 5)])
def test_all_similar_pairs(spark, monkeypatch, limit, seed):
    monkeypatch.setattr(prefixjoin, "LIMIT", limit)
    rng = random.Random(seed)
    sets, seen = [], set()
    while len(sets) < 260:
        s = {rng.randrange(400) + (rng.randrange(3) << HASH) for _ in range(rng.randrange(1, 40))}
        for _ in range(rng.randrange(1, 7)):
            new = frozenset(s)
            if new and new not in seen:
                seen.add(new)
                sets.append(new)
            for _ in range(rng.randrange(3)):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.randrange(400) + (rng.randrange(3) << HASH))
    stars, pairs, lists = prefixjoin.candidates(classes_of(spark, sets))
    stars, pairs = stars.collect(), {(r.a, r.b) for r in pairs.collect()}
    together = {}
    for r in lists.collect():
        for node in r.nodes:
            together.setdefault(node, set()).add(r.list)
    least, more = {r.b: r.a for r in stars}, {r.b for r in stars if r.more}
    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                assert b in least and least[b] < b
                assert least[b] == a or (b in more and ((a, b) in pairs or together.get(a, set()) & together.get(b, set())))


def test_parity_never_hides_similar_sets():
    rng = random.Random(7)
    sets = []
    for n in (10, 70, 95, 105, 110, 300, 380, 420, 450, 1500, 1700, 3000):
        base = rng.sample(range(10**6), n)
        sets += [base, base[: -(-n * 9 // 10)], [*base[: n - n // 10], *range(10**7, 10**7 + n // 10)], rng.sample(range(10**6), n)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sizes = np.array([len(a) for a in arrays])
    words = prefixjoin.parities(np.concatenate(arrays), sizes).to_pylist()
    assert [len(x) // 8 for x in words] == prefixjoin.parity_words(sizes).tolist()
    for kept in (1, 4, 16, 64):
        n, own = prefixjoin.likeness(arrays, kept)
        assert (own == prefixjoin.folded([w for w in prefixjoin.parities(np.concatenate(arrays), sizes, np.full(len(sets), 64)).to_pylist()], kept)).all()
        far = wrong = 0
        for i, s in enumerate(sets):
            found = prefixjoin.apart_of(int(n[i]), own[i], n, own)
            for j, x in enumerate(sets):
                same = len(set(s) & set(x))
                if 9 * same >= 4 * (len(s) + len(x)):
                    assert found[j] < 2**30
                elif not same and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and n[i] < 100 * kept:
                    far += 1
                    wrong += found[j] < 2**30
        assert wrong < 0.1 * far
    both = prefixjoin.overlaps(arrays[4], arrays)
    assert both.tolist() == [len(set(sets[4]) & set(x)) for x in sets]


def test_parity_tells_large_unlike_sets_apart(spark):
    rng = random.Random(11)
    sets, unlike, alike = [], [], []
    for n in (90, 390, 1500, 3000, 12_000, 30_000):
        base = rng.sample(range(10**8), n)
        sets += [base, [*base[: n - n // 10], *range(2 * 10**8, 2 * 10**8 + n // 10)], rng.sample(range(10**8), n)]
        alike.append((len(sets) - 3, len(sets) - 2))
        unlike += [(len(sets) - 3, len(sets) - 1), (len(sets) - 2, len(sets) - 1)]
    pairs = spark.createDataFrame(alike + unlike, "a long, b long")
    assert sorted(tuple(r) for r in prefixjoin.likely(pairs, classes_of(spark, sets)).collect()) == alike


def test_packing():
    tokens = np.array([0, 1, 2**56 - 1, 2**50 + 7], np.uint64)
    assert prefixjoin.unpack(prefixjoin.pack(tokens)).tolist() == tokens.tolist()
    packed = prefixjoin.packed_array(tokens, np.array([1, 0, 3]))
    assert [len(x) for x in packed.to_pylist()] == [7, 0, 21] and prefixjoin.unpack(packed[2].as_py()).tolist() == tokens[1:].tolist()


def test_rarity_tree(spark, monkeypatch):
    monkeypatch.setattr(common, "SUMMED", 2)
    texts = spark.createDataFrame([(b"x" * (i % 3),) for i in range(50)], "text binary").repartition(9)
    order = common.rarity(texts, lambda found: np.array([len(t) << 44 for t in found], np.uint64)).value
    assert order[:4].tolist() == [int(2 * np.log2(n + 1)) for n in (17, 17, 16, 0)]
    assert isinstance(pa.array(order), pa.Array)
