"""Operator 4: exact removal of repeated passages by a distributed sort of suffixes.

A byte goes if it lies in a 400-byte string (window) that also starts anywhere else. Window starts are sorted as suffixes of
400 bytes, coarse to fine, so that few of them need to be moved one by one:

1. Every window holds a canonical anchor: the least 64-byte gram (by hash, leftmost). It depends on the window's bytes
   alone, so equal windows have it at the same offset. Consecutive starts with one anchor form a run; a run is sorted as
   the token sequence (gram, whole stretch of the run's windows).
2. Runs whose gram occurs elsewhere but whose stretch does not are cut into blocks of STEP starts with tokens
   (common part of the block's windows, stretch of the block).
3. Blocks left open in the same way are cut into windows with tokens (halves of the fingerprint of the 400 bytes).

Each level is one suffix sort: splitters sampled from the rows range-partition them by their leading tokens (and then all
columns, so equal suffixes may lie in several ranges), each range sorts by multikey quicksort, i.e. token by token, going
on only inside groups of equal tokens, and what touches the first or last group of a range is compared with its
neighbours' ends. A suffix equal to a neighbour is repeated; a first token without a second occurrence ends the matter.
One suffix of each repeated class goes on to the next level, as the partner of those left open.
Tokens are 64-bit (first) and 128-bit (whole) polynomial fingerprints of the bytes they stand for.

Texts are read in whole, as UTF-8; null is empty; texts under 400 bytes lose nothing. Rows are told apart by doc_id and
text: repeated rows are documents of their own and get equal results. Very long texts are read in pieces of PIECE starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise, partitions, text_of

SPAN = 400
GRAM = 64
STEP = 16
PIECE = 2**19
#: Rows of one sorted range aimed at.
RANGE_ROWS = 500_000

_rng = np.random.default_rng(20240517)
BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 2)]
TABLES = [_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in BASES]
SALT = [np.uint64(int(x) | 1) for x in _rng.integers(2**62, 2**63, 4)]


def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    up, down = [], []
    for base in BASES:
        for out, b in ((up, base), (down, pow(base, -1, 2**64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
    return up, down


class Prints:
    """Fingerprints of the substrings of some bytes."""

    room = 0
    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    def __init__(self, b: np.ndarray, kinds: int = 2):
        n = len(b)
        if Prints.room < n + 1:
            Prints.room = max(2 * n, 2**16)
            Prints.up, Prints.down = _powers(Prints.room)
        self.sums = []
        for k in range(kinds):
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(TABLES[k][b] * Prints.up[k][:n], out=c[1:])
            self.sums.append(c)

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[k][end] - self.sums[k][start]) * Prints.down[k][start]
        x = x + (end - start).astype(np.uint64) * SALT[k]
        x ^= x >> np.uint64(31)
        x *= SALT[2 + k]
        return x ^ (x >> np.uint64(29))


def runs_of(b: np.ndarray, prints: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of the runs of b's windows."""
    n = len(b) - GRAM + 1
    width = SPAN - GRAM + 1
    at = np.arange(n)
    key = (prints.of(0, at, at + GRAM) & ~np.uint64(2**21 - 1)) | at.astype(np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = len(b) - SPAN + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    anchor = (least & np.uint64(2**21 - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    return anchor[first], first, last


COLUMNS = ["t0", "t1", "t2", "doc_id", "crc", "anchor", "lo", "hi"]
SCHEMA = "t0 long, t1 long, t2 long, doc_id long, crc long, anchor long, lo long, hi long"
KINDS = [pa.int64()] * 8


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """parts: (tokens..., doc_id, crc, anchor, lo, hi), doc_id and crc one value each."""
    if not parts:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, COLUMNS)
    cols = [np.concatenate([p[i] for p in parts]) for i in range(3)]
    sizes = [len(p[0]) for p in parts]
    doc = pa.array([p[3] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
    rest = [np.repeat([p[4] for p in parts], sizes), *(np.concatenate([p[i] for p in parts]) for i in (5, 6, 7))]
    return pa.RecordBatch.from_arrays([*(pa.array(_signed(c)) for c in cols), doc, *(pa.array(r.astype(np.int64)) for r in rest)], COLUMNS)


def _level_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for doc, crc, text in zip(batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist(), batch.column("text"), strict=True):
            whole = np.frombuffer(text.as_py(), np.uint8)
            for off in range(0, len(whole) - SPAN + 1, PIECE):
                b = whole[off : off + PIECE + SPAN - 1]
                prints = Prints(b)
                anchor, lo, hi = runs_of(b, prints)
                tokens = prints.of(0, anchor, anchor + GRAM), prints.of(0, lo, hi + SPAN), prints.of(1, lo, hi + SPAN)
                parts.append((*tokens, doc, crc, anchor + off, lo + off, hi + off))
        yield _rows(parts)


def _finer(blocks: bool):
    """Rows of the next level from a document's open rows: blocks of STEP starts, or single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, crc, text, opened in zip(
                batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist(), batch.column("text"), batch.column("opened"), strict=True
            ):
                whole = np.frombuffer(text.as_py(), np.uint8)
                flat = np.array([[x["anchor"], x["lo"], x["hi"]] for x in opened.as_py()], np.int64)
                flat = flat[np.argsort(flat[:, 1], kind="stable")]
                parts, i = [], 0
                while i < len(flat):  # rows that start within one piece share its fingerprints
                    off = int(flat[i, 1])
                    j = int(np.searchsorted(flat[:, 1], off + PIECE))
                    anchor, lo, hi = flat[i:j].T - off
                    i = j
                    prints = Prints(whole[off : off + int(hi.max()) + SPAN])
                    if blocks:
                        j0, j1 = (anchor - hi) // STEP, (anchor - lo) // STEP
                        n = j1 - j0 + 1
                        row = np.repeat(np.arange(len(n)), n)
                        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + j0[row]
                        a = anchor[row]
                        common = a - STEP * k
                        lo2, hi2 = np.maximum(lo[row], common - STEP + 1), np.minimum(hi[row], common)
                        tokens = prints.of(0, common, common + SPAN - STEP + 1), prints.of(0, lo2, hi2 + SPAN), prints.of(1, lo2, hi2 + SPAN)
                    else:
                        n = hi - lo + 1
                        row = np.repeat(np.arange(len(n)), n)
                        lo2 = hi2 = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        a = anchor[row]
                        t = prints.of(0, lo2, lo2 + SPAN)
                        tokens = t, prints.of(1, lo2, lo2 + SPAN), np.zeros(len(t), np.uint64)
                    parts.append((*tokens, doc, crc, a + off, lo2 + off, hi2 + off))
                yield _rows(parts)

    return run


def multikey_sort(tokens: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the token sequences and, for each depth, the start of each row's group of equal tokens so far."""
    n = len(tokens[0])
    order = np.argsort(tokens[0], kind="quicksort")
    new = np.concatenate([[True], tokens[0][order][1:] != tokens[0][order][:-1]]) if n else np.zeros(0, bool)
    groups = []
    for depth, token in enumerate(tokens):
        if depth:
            group = groups[-1]
            inside = np.zeros(n, bool)
            same = ~new[1:]
            inside[1:] |= same
            inside[:-1] |= same
            active = np.flatnonzero(inside)
            by = np.lexsort((token[order[active]], group[active]))
            order[active] = order[active][by]
            new[1:] |= token[order][1:] != token[order][:-1]
        groups.append(np.maximum.accumulate(np.where(new, np.arange(n), 0)))
    return order, groups


OUT = SCHEMA + ", pid int, kind int, repeated boolean, more boolean, lead boolean, mixed boolean"


def _sort_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one range. kind 0: rows that may matter; kind 1: the first and last tokens of the range."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, COLUMNS)])
    n = table.num_rows
    if not n:
        return
    t = [table.column(c).to_numpy() for c in COLUMNS[:3]]
    order, groups = multikey_sort(t)
    size = lambda g: np.bincount(g, minlength=n)[g]
    first, whole = groups[0], groups[-1]
    n0, n2 = size(first), size(whole)
    lead = whole == np.arange(n)
    heads = np.bincount(first[lead], minlength=n)[first]
    edge = (first == first[0]) | (first == first[-1])
    keep = (n0 > 1) | edge
    flags = [n2 > 1, n0 > 1, lead, (heads > 1) | edge]
    picked = table.take(pa.array(order[keep]))
    ends = table.take(pa.array([order[0], order[-1]]))
    for part, kind, marks in ((picked, 0, [f[keep] for f in flags]), (ends, 1, [np.zeros(2, bool)] * 4)):
        m = part.num_rows
        cols = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns)]
        cols += [pa.array(np.full(m, pid, np.int32)), pa.array(np.full(m, kind, np.int32)), *(pa.array(x) for x in marks)]
        names = COLUMNS + ["pid", "kind", "repeated", "more", "lead", "mixed"]
        yield from pa.table(cols, names=names).to_batches(max_chunksize=50_000)


def suffix_sort(rows: DataFrame) -> DataFrame:
    """One level: doc_id, crc, anchor, lo, hi, repeated (the whole suffix occurs elsewhere), onward (to the next level)."""
    rows = materialise(rows)
    ranges = max(partitions(rows.sparkSession), int(rows.count() // RANGE_ROWS) + 1)
    split = rows.repartitionByRange(ranges, "t0", "t1", "t2", "doc_id", "crc", "lo")
    out = materialise(split.mapInArrow(_sort_range, OUT))
    discard(rows)
    ends = out.filter("kind = 1")
    # One row per range end: tokens that end one range and begin another.
    over0 = ends.groupBy("t0").agg((F.count_distinct("pid") > 1).alias("x0")).filter("x0")
    over2 = ends.groupBy("t0", "t1", "t2").agg((F.count_distinct("pid") > 1).alias("x2")).filter("x2")
    met = out.filter("kind = 0").join(F.broadcast(over0), "t0", "left").join(F.broadcast(over2), ["t0", "t1", "t2"], "left")
    repeated = F.col("repeated") | F.coalesce("x2", F.lit(False))
    more = F.col("more") | F.coalesce("x0", F.lit(False))
    return met.select(
        "doc_id", "crc", "anchor", "lo", "hi", repeated.alias("repeated"),
        ((more & ~repeated) | (repeated & F.col("lead") & F.col("mixed"))).alias("onward"),
    ).filter("repeated or onward")


def _with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    opened = found.filter("onward").groupBy("doc_id", "crc").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("opened"))
    opened = opened.withColumnsRenamed({"doc_id": "o_id", "crc": "o_crc"})
    return docs.join(opened, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("crc") == F.col("o_crc"))).select("doc_id", "crc", "text", "opened")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_py()
            merged: list[list[int]] = []
            for x in sorted((s["lo"], s["hi"] + SPAN) for s in spans.as_py() or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            rows.append((len(raw), sum(h - x for x, h in merged), merged, b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([[{"lo": x, "hi": h} for x, h in r[2]] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                pa.array([r[3] for r in rows], pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (array of the maximal removed runs [lo, hi)), kept (bytes) of every row."""
    text = text_of().cast("binary")
    base = docs.select("doc_id", F.crc32(text).alias("crc"), text.alias("text"))
    long = base.filter(F.octet_length("text") >= SPAN)
    runs = materialise(suffix_sort(long.mapInArrow(_level_runs, SCHEMA)))
    blocks = materialise(suffix_sort(_with_text(runs, long).mapInArrow(_finer(True), SCHEMA)))
    windows = suffix_sort(_with_text(blocks, long).mapInArrow(_finer(False), SCHEMA))
    spans = [x.filter("repeated").select("doc_id", "crc", "lo", "hi") for x in (runs, blocks, windows)]
    found = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "s_id", "crc": "s_crc"})
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("crc") == F.col("s_crc")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, removed array<struct<lo:long,hi:long>>, kept binary"
    )


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
