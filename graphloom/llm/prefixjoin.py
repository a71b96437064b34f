"""Prefix-filter search for similar sets (Jaccard >= 4/5): candidate pairs by prefix, length, position and parity.

Sets of n and m tokens in rarity order that are similar differ in at most (n + m) / 9 tokens, and have at most n / 5 tokens
that the other lacks; so their first common token stands among the first n / 5 + 1 of each, the second one among the
first n / 5 + 2, and so on. Each set is listed under its prefix tokens, and pairs that meet in a list are kept if

* the lengths allow it (5 * min >= 4 * max; lists are in the order of length, so a scan ends early),
* the places of the token allow enough overlap,
* and their parity bits (one bit per token, summed modulo 2; 64 of them or more, by the size of the set) differ in no
  more places than the sets may differ in tokens.

A list of more than LIMIT sets is dealt out again under its token together with the next prefix tokens, up to DEPTH
tokens deep. What is given back grows with the memberships, never with the pairs: every set with its likeliest lesser partner in
each list, and the lists in which three or more sets have partners, for a second look at what those partners leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, partitions, pieces, small_enough, trim
from graphloom.llm.words import HASH, mix

LIMIT = 2048
DEPTH = 3
#: Places in a prefix are kept in 16 bits; from here on the positional filter lets a pair pass.
FAR = 65_535
PIECE_BYTES = 2**20
#: Postings of one bucket aimed at.
BUCKET_ROWS = 250_000
#: Sets of each side of a second look's task.
BLOCK = 1000
FOUND = "b long, a long, far int, others int, list long, heavy boolean, nodes array<long>, places array<int>"


def misses(n):
    """Most tokens of a set of n that a similar one lacks."""
    return n // 5


def prefix_length(n):
    """Tokens of a set that are kept for listing: the prefix, and what deeper lists need."""
    return np.minimum(misses(n) + DEPTH, n)


def pack(tokens: np.ndarray) -> bytes:
    """Tokens below 2**56 in 7 bytes each."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).reshape(-1)


def packed_array(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of the packed tokens of each group."""
    offsets = np.concatenate([[0], np.cumsum(sizes * 7)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(pack(np.ascontiguousarray(tokens)))])


def heads_of(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the first `most` items of each of some groups that follow each other."""
    starts = np.cumsum(counts) - counts
    return np.repeat(starts - (np.cumsum(most) - most), most) + np.arange(most.sum())


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width]


WIDTHS = {"t": (np.uint64, 5), "d": (np.int64, 8), "n": (np.int32, 4), "p": (np.uint16, 2)} | {f"s{k}": (np.uint64, 8) for k in range(4)}


#: Most words of parity bits that a set keeps.
MOST_WORDS = 4**7


def parity_words(n):
    """Words of 64 parity bits that a set of n tokens keeps, a power of four: more tokens need more, to tell unlike sets apart.
    They take a tenth of the set's own size at most, from some hundred tokens on."""
    words = np.ones_like(np.asarray(n), dtype=np.int64)
    for k in range(7):
        words = np.where(np.asarray(n) > 80 * 4**k, 4 ** (k + 1), words)
    return words


def parities(tokens: np.ndarray, counts: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """Binary array of the parity words of some sets (none empty), as many as parity_words() says or `keep` (powers of four).
    Fewer words are the sums of more, by number modulo their count."""
    h = mix(tokens & np.uint64(2**HASH - 1))
    bits = np.uint64(1) << (h >> np.uint64(58))
    keep = parity_words(counts) if keep is None else keep
    starts = np.cumsum(keep) - keep
    out = np.zeros(keep.sum(), np.uint64)
    if len(counts):
        one = keep == 1
        whole = np.bitwise_xor.reduceat(bits, np.cumsum(counts) - counts)
        out[starts[one]] = whole[one]
        wide = np.repeat(~one, counts)
        which = np.repeat(np.arange(len(counts)), counts)[wide]
        word = ((h[wide] >> np.uint64(32)) & np.uint64(MOST_WORDS - 1)).astype(np.int64) % keep[which]
        np.bitwise_xor.at(out, starts[which] + word, bits[wide])
    offsets = np.append(starts, len(out)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def folded(raw: list[bytes], most: int) -> np.ndarray:
    """The parity words of some sets, up to `most` of them each, with zeros behind."""
    out = np.zeros((len(raw), most), np.uint64)
    sizes = np.array([len(x) // 8 for x in raw])
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        words = np.frombuffer(b"".join([raw[i] for i in mine.tolist()]), np.uint64).reshape(len(mine), size)
        if size > most:
            words = np.bitwise_xor.reduce(words.reshape(len(mine), size // most, most), axis=1)
        out[mine, : words.shape[1]] = words
    return out


def _emit(depth: int, buckets: int):
    """Packed postings by bucket: key (40 bits), node, size, place, parity. Numbers are stored as byte planes, so that high bytes
    that are alike compress away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in (part for whole in batches for part in pieces(whole, "prefix", PIECE_BYTES)):
            batch = batch.take(pa.array(np.argsort(batch.column("node").to_numpy(), kind="stable")))  # high bytes of neighbours are alike
            raw = [x.as_py() for x in batch.column("prefix")]
            sizes = np.array([len(x) // 7 for x in raw], np.int64)
            tokens = unpack(b"".join(raw))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = batch.column("n").to_numpy().astype(np.int64)
            use = place < misses(n)[row] + depth
            if depth > 1:
                use &= place > batch.column("place").to_numpy()[row]
            tokens, row, place = tokens[use], row[use], place[use]
            if depth > 1:
                tokens = tokens ^ mix(batch.column("key").to_numpy().view(np.uint64)[row])
            key = mix(tokens)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            parity = folded([x.as_py() for x in batch.column("parity")], 4)
            by = np.argsort(bucket * 2 + (parity_words(n)[row] > 1), kind="stable")  # zeros stay together
            bucket, row = bucket[by], row[by]
            columns = {
                "t": key[by] >> np.uint64(24), "d": batch.column("node").to_numpy()[row], "n": np.minimum(n, 2**31 - 1).astype(np.int32)[row],
                "p": np.minimum(place[by], FAR).astype(np.uint16), **{f"s{k}": parity[:, k][row] for k in range(4)},
            }
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(bucket))
            made = [pa.array(bucket[starts], pa.int64())]
            for c, (_, width) in WIDTHS.items():
                planes = _planes(columns[c], width)
                made.append(pa.array([planes[s:e].T.tobytes() for s, e in zip(starts, ends, strict=False)], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, ["bucket", *WIDTHS])

    return run


def _whole(blocks: pa.Table, name: str) -> np.ndarray:
    kind, width = WIDTHS[name]
    parts = [np.frombuffer(x.as_py(), np.uint8).reshape(width, -1).T for x in blocks.column(name)]
    out = np.zeros((sum(map(len, parts)), np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.concatenate(parts)
    return out.view(kind).reshape(-1)


def places_allow(n, i, m, j):
    """Sets of n and m tokens that share the token at places i and j of their orders have at most min(i, j) common tokens before
    it and as many behind it as the shorter rest holds."""
    most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    return (9 * most >= 4 * (n + m)) | (np.maximum(i, j) >= FAR)


def _meet(blocks: pa.Table) -> pa.Table:
    t, d, n, p, *s = (_whole(blocks, c) for c in WIDTHS)
    n, p = n.astype(np.int64), p.astype(np.int64)
    bucket = int(blocks.column("bucket")[0].as_py())
    by = np.lexsort((n, t))
    t, d, n, p, s = t[by], d[by], n[by], p[by], np.stack(s, 1)[by]
    folds, wide = np.bitwise_xor.reduce(s, axis=1), parity_words(n) > 1
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    sizes = np.diff(np.append(starts, len(t)))
    which = np.repeat(np.arange(len(starts)), sizes)
    end = (starts + sizes)[which]
    heavy = sizes > LIMIT
    hit = np.zeros(len(t), bool)
    # Of each entry: its likeliest lesser partner (difference in parity for its size, then place), and how many it has.
    best, lesser = np.full(len(d), 2**62), np.zeros(len(d), np.int64)
    k = 1
    act = np.flatnonzero((end - np.arange(len(t)) > 1) & ~heavy[which])
    while len(act):
        other = act + k
        fits = 5 * n[act] >= 4 * n[other]
        act, other = act[fits], other[fits]
        most = (n[act] + n[other]) // 9
        apart = np.bitwise_count(folds[act] ^ folds[other]).astype(np.int64)
        good = places_allow(n[act], p[act], n[other], p[other]) & (apart <= most)
        one, two, most, apart = act[good], other[good], most[good], apart[good]
        both = np.flatnonzero(wide[one] & wide[two])
        apart[both] = np.bitwise_count(s[one[both]] ^ s[two[both]]).sum(1)
        good = apart <= most
        one, two, far = one[good], two[good], 1000 * apart[good] // np.maximum(most[good], 1)
        hit[one] = True
        hit[two] = True
        swap = d[one] > d[two]
        less, more = np.where(swap, two, one), np.where(swap, one, two)
        np.minimum.at(best, more, far << 40 | less)
        np.add.at(lesser, more, 1)
        k += 1
        act = act[end[act] - act > k]
    later = np.flatnonzero(lesser)
    stars = np.stack([d[later], d[best[later] & (2**40 - 1)], best[later] >> 40, lesser[later]])
    b, a, far, others = np.unique(stars, axis=1) if len(later) else np.empty((4, 0), np.int64)
    hits = np.bincount(which[hit], minlength=len(starts))
    names, flags, nodes, places = [], [], [], []
    lists: set[int] = set()
    for x in np.flatnonzero((hits > 2) | heavy).tolist():
        at = np.arange(starts[x], starts[x] + sizes[x])
        if heavy[x]:
            name = (bucket << 40) ^ int(t[at[0]])
        else:
            at = at[hit[at]]
            at = at[np.argsort(d[at])]
            name = xxhash.xxh3_64_intdigest(d[at].tobytes()) - 2**63
            if name in lists:
                continue
            lists.add(name)
        for start in range(0, len(at), LIMIT):
            part = at[start : start + LIMIT]
            names.append(name)
            flags.append(bool(heavy[x]))
            nodes.append(d[part])
            places.append(p[part].astype(np.int32) if heavy[x] else None)
    few, many = [None] * len(names), [None] * len(b)
    return pa.table({
        "b": pa.array(b.tolist() + few, pa.int64()), "a": pa.array(a.tolist() + few, pa.int64()),
        "far": pa.array(far.tolist() + few, pa.int32()), "others": pa.array(others.tolist() + few, pa.int32()),
        "list": pa.array(many + names, pa.int64()), "heavy": pa.array(many + flags, pa.bool_()),
        "nodes": pa.array(many + nodes, pa.list_(pa.int64())), "places": pa.array(many + places, pa.list_(pa.int32())),
    })


def _round(listed: DataFrame, depth: int) -> DataFrame:
    total = listed.agg(F.sum(F.octet_length("prefix")) / 7).first()[0] or 0
    buckets = max(2 * partitions(listed.sparkSession), int(total // BUCKET_ROWS) + 1)
    kinds = ", ".join(f"{c} binary" for c in WIDTHS)
    blocks = listed.mapInArrow(_emit(depth, buckets), f"bucket long, {kinds}")
    return materialise(blocks.groupBy("bucket").applyInArrow(_meet, FOUND), last=True)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes: node (0 or more), n, parity, prefix (packed). From what comes back every pair of similar sets can be had:
    stars (a, b, more): each set b with lesser partners, the likeliest of them, and whether there are more (a written table);
    pairs (a, b): the likeliest partners by list, with repeats; lists (list, nodes): sets with partners, three or more."""
    narrow = ["node", "n", "parity", "prefix"]
    found = [_round(classes.select(*narrow), 1)]
    while len(found) < DEPTH and not (heavy := found[-1].filter("heavy")).isEmpty():
        member = F.arrays_zip("nodes", "places")
        members = heavy.select(F.col("list").alias("key"), F.explode(member).alias("m")).select("key", F.col("m.nodes").alias("node"), F.col("m.places").alias("place"))
        found.append(_round(members.join(classes.select(*narrow), "node"), len(found) + 1))
    columns = ["a", "b", "far", "others"]
    pairs, lists = found[0].filter("b is not null").select(*columns), found[-1].filter("heavy")
    for x in found[1:]:
        pairs = pairs.union(x.filter("b is not null").select(*columns))
    for x in found:
        lists = lists.union(x.filter("not heavy"))
    # A list that is too long even under DEPTH tokens has no partners yet: its members ask its least one.
    deep = found[-1].filter("heavy")
    if not deep.isEmpty():
        deep = deep.select("list", F.explode("nodes").alias("b"))
        heads = deep.groupBy("list").agg(F.min("b").alias("a"))
        pairs = pairs.union(deep.join(heads, "list").filter("b > a").select("a", "b", F.lit(10**6).alias("far"), F.lit(2).alias("others")))
    more = (F.max("others") > 1) | (F.min("a") < F.max("a"))
    stars = pairs.groupBy("b").agg(F.min_by("a", "far").alias("a"), more.alias("more")).select("a", "b", "more")
    return materialise(stars), pairs.select("a", "b"), lists.select("list", "nodes")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that all parity bits of classes (node, n, parity) allow."""
    one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            p, q = ([x.as_py() for x in batch.column(c)] for c in ("pa", "pb"))
            ok, width = np.zeros(len(n), bool), np.minimum(parity_words(n), parity_words(m))
            for w in np.unique(width).tolist():
                mine = np.flatnonzero(width == w)
                left, right = (folded([x[i] for i in mine.tolist()], w) for x in (p, q))
                ok[mine] = 9 * np.bitwise_count(left ^ right).sum(1, dtype=np.int64) <= (n + m)[mine]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def second_look(lists: DataFrame, roots: DataFrame, askers: DataFrame, marks: DataFrame | None, sets_for, answer, read=unpack) -> DataFrame:
    """Searches of askers (node) among the members of their lists (list, nodes). marks: node, mark of whoever has one.

    roots: node, root: lists whose least members have the same root are searched as one home. A home's members and askers are
    dealt in blocks of BLOCK, each pair of blocks is a task, and a task holds the sets of its two blocks alone. sets_for(nodes)
    gives the sets (node, tokens, or other bytes that `read` understands); answer(askers, members) is called with each side's
    nodes, marks (without one, the node) and what was read, and yields pairs (a, b)."""
    spark = lists.sparkSession
    parts = lists.dropDuplicates(["list", "nodes"])
    least = parts.groupBy("list").agg(F.min(F.array_min("nodes")).alias("node")).join(roots, "node", "left").select("list", F.coalesce("root", "node").alias("home"))
    members = materialise(parts.join(least, "list").select("home", F.explode("nodes").alias("node")).distinct())
    asks = materialise(members.join(askers.select("node"), "node"))
    asking = asks.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("pa"))
    blocks = materialise(members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("pm")).join(asking, "home"))

    def deal(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        block, across = F.pmod(F.xxhash64("node"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        rows = rows.join(blocks, "home").select("home", "node", block.alias("own"), across.alias("other"))
        pair = ("own", "other") if side else ("other", "own")
        return rows.select(F.xxhash64("home", *pair).alias("key"), "node", F.lit(side).alias("side"))

    # role 0: member alone, 1: asker alone, 2: both; each set is shipped once for a task.
    role = F.when(F.count_distinct("side") > 1, 2).otherwise(F.max("side")).alias("role")
    tasks = materialise(deal(members, "pm", "pa", 0).union(deal(asks, "pa", "pm", 1)).groupBy("key", "node").agg(role))
    sets = sets_for(tasks.select("node").distinct())
    bundles = max(2 * partitions(spark), int(tasks.count() // BLOCK) + 1)
    sets = sets.withColumn("mark", F.col("node")) if marks is None else sets.join(marks, "node", "left").withColumn("mark", F.coalesce("mark", "node"))
    few = small_enough(tasks, F.lit(64))  # then the sets need not be shuffled to meet them
    shipped = sets.join(F.broadcast(tasks) if few else tasks, "node").withColumn("bundle", F.pmod("key", F.lit(bundles).cast("long")))

    def run(table: pa.Table) -> pa.Table:
        key, node, role, mark = (table.column(c).to_numpy() for c in ("key", "node", "role", "mark"))
        tokens = table.column("tokens")
        by = np.lexsort((node, key))
        out: list[tuple[int, int]] = []
        for part in np.split(by, np.flatnonzero(key[by][1:] != key[by][:-1]) + 1):
            asks, held = role[part] > 0, role[part] != 1
            if asks.any() and held.any():
                found = [read(tokens[int(i)].as_py()) for i in part]
                sides = [(node[part[x]], mark[part[x]], [f for f, y in zip(found, x.tolist(), strict=True) if y]) for x in (asks, held)]
                out += answer(*sides)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return materialise(shipped.select("bundle", "key", "node", "role", "mark", "tokens").groupBy("bundle").applyInArrow(run, "a long, b long"), last=True)


def likeness(sets: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and parity words of some sets."""
    sizes = np.array([len(x) for x in sets])
    return sizes, folded(parities(np.concatenate(sets), sizes, np.full(len(sets), words)).to_pylist(), words)


def apart_of(size: int, words: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How far a set's parity is from others', with those out of reach at 2**30."""
    far = np.bitwise_count(words[None, :] ^ others).sum(1).astype(np.int64)
    may = (9 * far <= size + sizes) & (5 * np.minimum(size, sizes) >= 4 * np.maximum(size, sizes))
    return np.where(may, far, 2**30)


def overlaps(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Tokens that a set has in common with others."""
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    at = np.searchsorted(query, tokens)
    same = query[np.minimum(at, len(query) - 1)] == tokens
    return np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
