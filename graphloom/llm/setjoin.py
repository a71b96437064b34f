"""T-occurrence searches by DivideSkip over inverted lists of token sets (Jaccard >= 4/5), and connected components.

`Index.similar` divides the lists of a query's tokens: the long ones are set aside, the short ones are merged with a heap
that skips members which can not reach the bar, and what is left is looked up in the long ones by binary probes, dropping
members on the way whose overlap has become out of reach.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import prefixjoin
from graphloom.llm.common import BROADCAST_BYTES, discard, materialise, partitions

#: Candidates that share a task with the set that asks among them.
PER_TASK = 2000


def may_be_similar(n, m):
    """Length filter."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


class Index:
    """Inverted lists over some sets (sorted token arrays), for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[by], owner[by]
        self.starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens = tokens[self.starts]
        self.ends = np.concatenate([self.starts[1:], [len(tokens)]])

    def similar(self, query: np.ndarray) -> list[int]:
        """Members whose Jaccard similarity with the query is at least 4/5, by DivideSkip."""
        n = len(query)
        fits = may_be_similar(self.sizes, n)
        if not fits.any():
            return []
        wanted = -(-4 * (n + self.sizes) // 9)
        least = int(wanted[fits].min())
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < least:
            return []
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        longest = int(self.ends[at[-1]] - self.starts[at[-1]])
        apart = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)), len(at) - 1)
        short, long = at[: len(at) - apart], at[len(at) - apart :]
        bar = least - apart
        found = merge_skip([self.owner[self.starts[x] : self.ends[x]].tolist() for x in short], bar)
        members, counts = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        kept = fits[members]
        members, counts = members[kept], counts[kept]
        # Binary probes into the long lists, each for all members that can still reach their overlap.
        for left, x in zip(range(len(long), 0, -1), long, strict=True):
            able = counts + left >= wanted[members]
            members, counts = members[able], counts[able]
            if not len(members):
                return []
            entries = self.owner[self.starts[x] : self.ends[x]]
            k = np.searchsorted(entries, members)
            counts = counts + (entries[np.minimum(k, len(entries) - 1)] == members)
        return np.sort(members[counts >= wanted[members]]).tolist()


def merge_skip(lists: list[list[int]], bar: int) -> dict[int, int]:
    """Heap merge of sorted lists: members found in at least `bar` of them, with their counts; stretches of members that
    can not reach the bar are skipped."""
    found: dict[int, int] = {}
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    place = [0] * len(lists)
    while len(heap) >= bar:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= bar:
            found[top] = len(popped)
            goal = top + 1
        else:
            while heap and len(popped) < bar - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = max(heap[0][0], top + 1)
        for i in popped:
            x = lists[i]
            k = place[i] = bisect_left(x, goal, place[i])
            if k < len(x):
                heapq.heappush(heap, (x[k], i))
    return found


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    return Index(sets).similar(query)


def search(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. sets: node, tokens (packed). Each a asks among its b, at most about PER_TASK of
    them in one task, so each of its sets is shipped once for that task; tasks are bundled into groups."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / PER_TASK)))
    n = pairs.count()
    bundles = max(4 * partitions(spark), int(n // PER_TASK) + 1)
    asks = dealt.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("mark")).distinct()
    members = asks.union(dealt.select("a", "part", F.col("b").alias("node"), F.lit(1)))
    bundle = F.pmod(F.xxhash64("a", "part", F.lit(3)), F.lit(bundles).cast("long")).alias("bundle")
    # Members are narrow: where they are few, the sets need not be shuffled to meet them.
    members = F.broadcast(members) if 128 * n <= BROADCAST_BYTES else members
    shipped = sets.select("node", "tokens").join(members, "node").select(bundle, "a", "part", "node", "mark", "tokens")

    def run(table: pa.Table) -> pa.Table:
        a, part, node, mark = (table.column(c).to_numpy() for c in ("a", "part", "node", "mark"))
        tokens = table.column("tokens")
        by = np.lexsort((node, mark, part, a))
        new = (a[by][1:] != a[by][:-1]) | (part[by][1:] != part[by][:-1])
        one, two = [], []
        for mine in np.split(by, np.flatnonzero(new) + 1):
            query, *members = (prefixjoin.unpack(tokens[int(i)].as_py()) for i in mine)
            found = Index(members).similar(query) if members else []
            one += [int(a[mine[0]])] * len(found)
            two += [int(node[mine[j + 1]]) for j in found]
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return shipped.groupBy("bundle").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, mark: the least node of its connected component, for every node of an edge (a, b).

    Rounds of minimum label propagation with pointer jumping; each round is a written table."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("mark")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "mark"), "b").groupBy("a").agg(F.min("mark").alias("m"))
        low = labels.select("node", "mark").join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("mark").alias("old"), F.least("mark", "m").alias("mark"))
        jump = labels.select(F.col("node").alias("mark"), F.col("mark").alias("up"))
        new = materialise(low.join(jump, "mark", "left").select("node", "old", F.least("mark", F.coalesce("up", "mark")).alias("mark")))
        last, labels = labels, new
        discard(last)
        if new.filter("mark <> old").isEmpty():
            discard(both)
            return new.select("node", "mark")
