r"""Operator 8: exact n-gram Jaccard join of documents.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased; a document's set holds its distinct 5-word shingles (its
whole word sequence where it has fewer words). Documents link when 100 * |intersection| >= 80 * |union|; a component is
what links reach. Equal sets are one class. prefixjoin brings candidates together, and every candidate is decided by a
DivideSkip T-occurrence search over the inverted lists of whole sets (setjoin). First each class is asked for by its
likeliest candidate; then, in lists whose members are not in one component yet, those apart from the least member's
component look for likely members of other components, block by block: by parity bits alone, and where there are any, on whole
sets until a link is found. So groups of copies never expand into all pairs, and no link between components is lost. Components come from label propagation.

Sets are compared by 50-bit hashes of their shingles and classes by 128-bit names, so a wrong result needs a collision.
Texts without words, and null texts, have an empty set and stay alone. Null or repeated doc_ids are allowed (a component's
id is the least non-null one, null if there is none), ties and repeated rows are rows of one class, very long texts are
sets like others, an empty table gives an empty result; other columns are ignored under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import prefixjoin, setjoin
from graphloom.llm.common import discard, materialise, pieces, rarity, scratch, small_enough, text_of, trim
from graphloom.llm.words import Words, mix, names_of, ranked, sets_of

WORDS = 5
#: Candidates that are searched at once in a second look.
TRIED = 16
#: Odd multiplier of the polynomial over word hashes (fixed, so that all executors agree).
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' shingles, with repeats, text by text, and their number per text."""
    w = Words(texts)
    h, words = w.hashes, np.diff(w.bounds)
    m = max(len(h) - WORDS + 1, 0)
    out = h[:m].copy()
    for k in range(1, WORDS):
        out *= MIX
        out += h[k : k + m]
    out = mix(out)
    inside = w.text[:m] == w.text[WORDS - 1 :] if m else np.zeros(0, bool)
    sizes = np.maximum(words - WORDS + 1, 0)
    out = out[inside]
    few = np.flatnonzero((words > 0) & (words < WORDS))
    if len(few):
        whole = np.empty(len(few), np.uint64)
        for i, t in enumerate(few.tolist()):
            x = np.full(1, words[t], np.uint64)
            for k in range(w.bounds[t], w.bounds[t + 1]):
                x = mix(x * MIX + h[k])
            whole[i] = x[0]
        out = np.insert(out, np.cumsum(sizes)[few], whole)
        sizes[few] = 1
    return out, sizes


def shingle_hashes(texts: list[bytes]) -> np.ndarray:
    return shingles(texts)[0]


def token_sets(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingles as tokens, the rarest first, and their number per text."""
    found, sizes = shingles(texts)
    return sets_of(ranked(found, rank), sizes)


ROWS = "doc_id long, th long, s1 long, s2 long, n int, parity binary, prefix binary"


def _rows(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        rank = order.value
        for batch in (part for whole in batches for part in pieces(whole, "text", prefixjoin.PIECE_BYTES)):
            tokens, counts = token_sets([x.as_py() for x in batch.column("text")], rank)
            s1, s2 = (np.zeros(len(counts), np.int64) for _ in range(2))
            full = counts > 0
            s1[full], s2[full] = names_of(tokens, counts[full])
            at = np.where(full, np.cumsum(full) - 1, -1)
            parity = prefixjoin.parities(tokens, counts[full]).take(pa.array(at, pa.int64(), mask=~full))
            most = prefixjoin.prefix_length(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(s1), pa.array(s2), pa.array(counts, pa.int32()), parity,
                    prefixjoin.packed_array(tokens[prefixjoin.heads_of(counts, most)], most),
                ],
                [x.split()[0] for x in ROWS.split(", ")],
            )

    return run


def _ship(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text", prefixjoin.PIECE_BYTES)):
            tokens, counts = token_sets([x.as_py() for x in batch.column("text")], order.value)
            yield pa.RecordBatch.from_arrays([batch.column("node"), prefixjoin.packed_array(tokens, counts)], ["node", "tokens"])

    return run


def ship(docs: DataFrame, wanted: DataFrame, order) -> DataFrame:
    """node, tokens (packed) of some classes (node, first), each recomputed from one of its documents."""
    wanted = materialise(wanted.select("node", F.col("first.doc_id").alias("w_id"), F.col("first.th").alias("w_th")))
    few = small_enough(wanted, F.lit(64))
    found = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["w_id"]) & (docs["th"] == wanted["w_th"]))
    sets = found.select("node", "text").mapInArrow(_ship(order), "node long, tokens binary")
    return materialise(sets.dropDuplicates(["node"]), last=True)


def _links(askers: tuple, members: tuple) -> list[tuple[int, int]]:
    """(asker, member): for each asker and component other than its own, one similar member of that component if there is one."""
    nodes, marks, sets = members
    sizes, words = prefixjoin.likeness(sets, 64)
    out = []
    for node, mark, query, size, own in zip(askers[0].tolist(), askers[1].tolist(), askers[2], *prefixjoin.likeness(askers[2], 64), strict=True):
        far = prefixjoin.apart_of(size, own, sizes, words)
        far[marks == mark] = 2**30
        for other in np.unique(marks[far < 2**30]).tolist():
            mine = np.flatnonzero((marks == other) & (far < 2**30))
            mine = mine[np.argsort(far[mine], kind="stable")]
            for at in range(0, len(mine), TRIED):  # likeliest first; one link joins the components
                some = mine[at : at + TRIED]
                found = setjoin.Index([sets[i] for i in some.tolist()]).similar(query)
                if found:
                    out.append((node, int(nodes[some[found[0]]])))
                    break
    return out


def _size_and_parity(raw: bytes) -> tuple[int, bytes]:
    return int.from_bytes(raw[:8], "big"), raw[8:]


def _likely(askers: tuple, members: tuple) -> list[tuple[int, int]]:
    """(node, node) of every asker and member that parity alone lets be similar to one of the other side in another component."""
    nodes, marks, sketches = members
    sizes = np.array([n for n, _ in sketches])
    widths, at = prefixjoin.parity_words(sizes), {}
    out, met = [], np.zeros(len(nodes), bool)
    for node, mark, (size, raw) in zip(askers[0].tolist(), askers[1].tolist(), askers[2], strict=True):
        far = np.full(len(nodes), 2**30)
        width = np.minimum(prefixjoin.parity_words(size), widths)
        for w in np.unique(width).tolist():
            if w not in at:  # all members that have so many words or more, folded to that many
                whole = np.flatnonzero(widths >= w)
                at[w] = whole, prefixjoin.folded([sketches[i][1] for i in whole.tolist()], w)
            mine, words = at[w]
            use = (width[mine] == w) & (marks[mine] != mark)
            if use.any():
                far[mine[use]] = prefixjoin.apart_of(size, prefixjoin.folded([raw], w)[0], sizes[mine[use]], words[use])
        near = far < 2**30
        if near.any():
            met |= near
            out.append((node, node))
    return out + [(int(x), int(x)) for x in nodes[met]]


def class_labels(docs: DataFrame, classes: DataFrame, order) -> DataFrame:
    """node, mark (least node of its component) of every class that has a similar one."""
    stars, pairs, lists = prefixjoin.candidates(classes)
    both = F.explode(F.array("a", "b")).alias("node")
    firsts = classes.select("node", "first")
    close = materialise(prefixjoin.likely(stars.select("a", "b"), classes))
    shipped = ship(docs, firsts.join(close.select(both).distinct(), "node"), order)

    def sets_for(nodes: DataFrame) -> DataFrame:
        more = materialise(nodes.join(shipped, "node", "left_anti"))
        return shipped if more.isEmpty() else shipped.union(ship(docs, firsts.join(more, "node"), order))

    links = [materialise(setjoin.search(close, shipped), last=True)]
    labels = setjoin.components(links[0])
    # Lists whose members are in several components: those apart from the least member's component ask.
    members = lists.dropDuplicates(["list", "nodes"]).select("list", F.explode("nodes").alias("node"))
    marked = materialise(members.join(labels, "node", "left").select("list", "node", F.coalesce("mark", "node").alias("mark")))
    home = marked.groupBy("list").agg(F.min(F.struct("node", "mark")).alias("h"), F.max("mark").alias("most"), F.min("mark").alias("least"))
    home = materialise(home.filter("least < most").select("list", F.col("h.mark").alias("home")))
    askers = materialise(marked.join(home, "list").filter("mark <> home").select("node").distinct())
    open_lists = lists.join(home.select("list"), "list", "left_semi")
    one, two = (labels.select(F.col("node").alias(x), F.col("mark").alias(f"mark_{x}")) for x in "ab")
    direct = pairs.distinct().join(stars, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    direct = direct.filter("coalesce(mark_a, a) <> coalesce(mark_b, b)").select("a", "b")
    direct = materialise(prefixjoin.likely(direct, classes))
    if not direct.isEmpty():
        links.append(materialise(setjoin.search(direct, sets_for(direct.select(both).distinct())), last=True))
    if not askers.isEmpty():
        # By parity alone first; whoever has a likely partner in another component is searched on whole sets.
        roots = labels.select("node", F.col("mark").alias("root"))
        sketches = classes.select("node", "n", "parity")
        sketch = lambda nodes: nodes.join(sketches, "node").select("node", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "parity").alias("tokens"))
        found = prefixjoin.second_look(open_lists, roots, askers, labels, sketch, _likely, _size_and_parity)
        near = materialise(found.select(F.col("a").alias("node")).distinct())
        if not near.isEmpty():
            part = F.pmod(F.xxhash64("node"), F.lit(64).cast("long"))  # a list may be long
            kept = marked.join(near, "node", "left_semi").groupBy("list", part).agg(F.collect_set("node").alias("nodes")).select("list", "nodes")
            kept = materialise(kept)
            links.append(prefixjoin.second_look(kept, roots, askers.join(near, "node", "left_semi"), labels, sets_for, _links))
    if len(links) > 1:
        whole = links[0]
        for x in links[1:]:
            whole = whole.union(x)
        labels = setjoin.components(whole)
    return labels


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, component, head (whether the row has the least id, then text, of its component) of every row."""
    with scratch(docs.sparkSession) as keep:
        narrow, ids = (keep(x) for x in _narrow_and_ids(docs))
    return narrow.join(ids, ["s1", "s2"], "left").select(
        "doc_id", "th", "n", F.coalesce("least.doc_id", "doc_id").alias("component"), (F.col("least").isNull() | F.col("least").eqNullSafe(_place())).alias("head")
    )


def _place():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")


def _narrow_and_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id, th, s1, s2, n of every row; s1, s2, least (place of the component's first row) of every set."""
    text = text_of().cast("binary")
    base = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    order = rarity(base.select("text"), shingle_hashes)
    rows = materialise(base.mapInArrow(_rows(order), ROWS))
    grouped = rows.filter("n > 0").groupBy("s1", "s2").agg(
        F.min(_place()).alias("first"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix")
    )
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), last=True)
    narrow = materialise(rows.select("doc_id", "th", "s1", "s2", "n"))
    discard(rows)
    labels = class_labels(base, classes, order)
    named = classes.select("s1", "s2", "node", "first")
    marked = materialise(named.join(labels, "node"))
    least = marked.groupBy("mark").agg(F.min("first").alias("least"))
    linked = marked.join(least, "mark").select("s1", "s2", "least")
    alone = named.join(labels, "node", "left_anti").select("s1", "s2", F.col("first").alias("least"))
    return narrow, materialise(linked.union(alone))


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return _components(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_ngrams(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id, then text, stays; one of its rows, if it repeats."""
    found = materialise(_components(docs).groupBy("doc_id", "th", "head").agg(F.count("*").alias("rows")).filter("rows > 1 or not head"))
    few = small_enough(found, F.lit(64))
    marks = found.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "head")
    same = docs["doc_id"].eqNullSafe(F.col("k_id")) & (F.xxhash64(text_of().cast("binary")) == F.col("k_th"))
    marked = docs.join(F.broadcast(marks) if few else marks, same, "left").select("doc_id", "text", "lang", "source", "n_chars", "head")
    # Unmarked rows are heads that occur once; of those that repeat, one stays.
    once, repeated = marked.filter("head is null").drop("head"), marked.filter("head").drop("head")
    return once.union(repeated.dropDuplicates(["doc_id", "text"]))
