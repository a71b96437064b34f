"""Ranked retrieval: inverted index, weights, heuristic score, vectors, fusion, expansion and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import paths
from graphloom.functions.text import bound, soft_cap, source_tokens, split_tokens, stem_match
from graphloom.operators.callers import checkpointed

PRUNE = 0.3
PRUNED_TOKENS = 100_000


def postings(sources: DataFrame) -> DataFrame:
    """token, fn_id, without tokens that more than PRUNE of the sources hold. Texts are tokenised once, into a checkpoint.

    There are no more pruned tokens than distinct tokens of a source on average over PRUNE, so they may be broadcast up to
    PRUNED_TOKENS; more are joined by shuffle."""
    rows = checkpointed(sources.select("fn_id", F.explode(F.array_distinct(source_tokens("source"))).alias("token")))
    most = PRUNE * sources.count()
    pruned = checkpointed(rows.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > most).select("token"))
    return rows.join(F.broadcast(pruned) if pruned.count() <= PRUNED_TOKENS else pruned, "token", "left_anti").select("token", "fn_id")


def weights(queries: DataFrame, symbols: DataFrame, source_vocabulary: DataFrame) -> DataFrame:
    """Weight of every distinct query token: max(0.5, ln(N/df)/ln(max(N, 2))); unknown ones 0.6 or 0.3.

    queries: token; symbols: id, name_tokens, doc_tokens; source_vocabulary: token. A symbol counts by an exact token of its
    name or doc, else by a stem match with a name token (joined on the first four characters)."""
    q = queries.select("token").distinct()
    exact = symbols.select("id", F.explode(F.array_union("name_tokens", "doc_tokens")).alias("token")).distinct().join(F.broadcast(q), "token")
    names = symbols.select("id", F.explode("name_tokens").alias("nt")).distinct().withColumn("k", F.left("nt", F.lit(4)))
    stems = names.join(F.broadcast(q.withColumn("k", F.left("token", F.lit(4)))), "k").filter(stem_match("token", "nt")).select("token", "id")
    df = exact.select("token", "id").union(stems).groupBy("token").agg(F.count_distinct("id").alias("df"))
    total = symbols.agg(F.count("*").alias("n"))
    vocabulary = source_vocabulary.select("token").distinct().withColumn("there", F.lit(True))
    rows = q.join(df, "token", "left").join(vocabulary, "token", "left").crossJoin(F.broadcast(total))
    idf = F.greatest(F.lit(0.5), F.log(F.col("n") / F.col("df")) / F.log(F.greatest(F.col("n"), F.lit(2))))
    w = F.when(F.col("df") > 0, idf).when(F.col("there"), 0.6).otherwise(0.3)
    return rows.select("token", F.coalesce("df", F.lit(0)).alias("df"), w.alias("w"))


def _sum(tokens: Column, f) -> Column:
    return F.aggregate(F.transform(tokens, f), F.lit(0.0).cast("double"), lambda a, x: a + x)


def heuristic_score(name: Column, doc: Column, path: Column, query: Column, terms: Column) -> Column:
    """terms: array of struct(t, w) of the query's tokens. 0.55 name, 0.20 docstring and 0.25 path, then penalties and cap."""
    folders = lambda p: F.flatten(F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), split_tokens))
    words = F.regexp_extract_all(F.lower(doc), F.lit("([a-z]{3,})"), 1)
    parts = {"names": split_tokens(name), "low_doc": F.lower(doc), "words": words, "path_tokens": split_tokens(path), "dirs": folders(paths.parts(path))}
    # Tokens are taken once for a symbol; the lambdas over terms would take them again for each term.
    return bound(F.struct(*[c.alias(k) for k, c in parts.items()]), lambda s: _heuristic_score(name, path, query, terms, *[s[k] for k in parts]))


def _heuristic_score(name: Column, path: Column, query: Column, terms: Column, names: Column, low_doc: Column, words: Column, path_tokens: Column, dirs: Column) -> Column:
    total = F.greatest(_sum(terms, lambda x: x["w"]), F.lit(1e-9))
    stem = lambda list_, t: F.exists(list_, lambda n: stem_match(t, n))
    hits = F.filter(terms, lambda x: F.array_contains(names, x["t"]))
    inside = lambda t: F.exists(names, lambda n: n.contains(t) | t.contains(n))
    contained = _sum(terms, lambda x: F.when(F.array_contains(names, x["t"]), x["w"]).when(inside(x["t"]), 0.6 * x["w"]).when(stem(names, x["t"]), 0.5 * x["w"]).otherwise(0.0)) / total
    floor = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda x: x["w"])) * F.greatest(F.lit(0.35), F.size(hits) / F.size(names))).otherwise(0.0)
    whole = F.when((query != "") & F.lower(name).contains(query), 0.9).otherwise(0.0)
    name_score = F.greatest(contained, floor, whole)
    doc_score = _sum(terms, lambda x: F.when(low_doc.contains(x["t"]), x["w"]).when(stem(words, x["t"]), 0.7 * x["w"]).otherwise(0.0)) / total
    by = lambda list_: _sum(terms, lambda x: F.when(F.array_contains(list_, x["t"]), x["w"]).when(stem(list_, x["t"]), 0.5 * x["w"]).otherwise(0.0)) / total
    path_score = F.greatest(by(path_tokens), 1.3 * by(dirs))
    score = 0.55 * name_score + 0.20 * doc_score + 0.25 * path_score
    odd = F.size(F.filter(terms, lambda x: x["w"] <= 0.3)) / F.greatest(F.size(terms), F.lit(1))
    score = F.when(odd > 0.5, score * (1 - 0.5 * odd)).otherwise(score)
    tests = F.exists(paths.parts(F.lower(path)), lambda p: p.isin(paths.SCORED_TEST_DIRS) | p.startswith("test_"))
    return soft_cap(F.when(tests, 0.7 * score).otherwise(score))


def caller_bonus(score: Column, callers: Column) -> Column:
    more = F.least(F.lit(0.12), 0.02 * F.log2(1 + callers))
    return F.when((callers > 0) & (score > 0.15), F.least(F.lit(1.0), score + more)).otherwise(score)


def source_search(index: DataFrame, terms: DataFrame, top: int = 20) -> DataFrame:
    """index: token, fn_id; terms: query_id, token, w. Exact postings count w; a token without postings takes those of its
    first stem match (in order) at 0.7 w; score = least(.82, sum / sum of weights), over .10, the best `top` per query."""
    vocabulary = index.select("token").distinct()
    exact = terms.join(vocabulary, "token", "left_semi").select("query_id", "token", "w", F.col("token").alias("use"))
    missing = terms.join(vocabulary, "token", "left_anti").withColumn("k", F.left("token", F.lit(4)))
    near = missing.join(vocabulary.select(F.col("token").alias("v"), F.left("token", F.lit(4)).alias("k")), "k").filter(stem_match("token", "v"))
    near = near.groupBy("query_id", "token", "w").agg(F.min("v").alias("use")).select("query_id", "token", (0.7 * F.col("w")).alias("w"), "use")
    total = terms.groupBy("query_id").agg(F.sum("w").alias("total"))
    hits = exact.union(near).join(index.select(F.col("token").alias("use"), "fn_id"), "use").groupBy("query_id", "fn_id").agg(F.sum("w").alias("s"))
    scored = hits.join(total, "query_id").withColumn("score", F.least(F.lit(0.82), F.round(F.col("s") / F.col("total"), 6))).filter("score > 0.10")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fn_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "fn_id", "score", "rank")


def function_document(name: Column, owner: Column, file: Column, doc: Column, tokens: Column) -> Column:
    head = F.concat(F.coalesce(F.concat(owner, F.lit(".")), F.lit("")), name, F.lit(" in "), paths.basename(file))
    return F.substring(F.concat(head, F.lit(": "), F.substring(doc, 1, 100), F.lit(". "), F.array_join(F.slice(F.array_distinct(tokens), 1, 20), " ")), 1, 256)


def file_documents(functions: DataFrame) -> DataFrame:
    """file, document: last three path parts, up to 15 names and 5 docs (60 characters), in order."""
    first = lambda c, k: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), 1, k)
    rows = functions.withColumn("doc60", F.substring("docstring", 1, 60))
    grouped = rows.groupBy("file").agg(first("name", 15).alias("names"), first("doc60", 5).alias("docs"))
    p = paths.parts("file")
    tail = F.array_join(F.slice(p, F.greatest(F.size(p) - 2, F.lit(1)), F.lit(3)), "/")
    return grouped.select("file", F.substring(F.concat(tail, F.lit(": "), F.array_join("names", ", "), F.lit(". "), F.array_join("docs", " ")), 1, 512).alias("document"))


def fingerprint(functions: DataFrame) -> DataFrame:
    """First 16 hex digits of the sha256 over the ordered `name:file:class` lines; digests of ranges first, so that no row
    holds all lines."""
    line = F.concat_ws(":", "name", "file", F.coalesce("class_name", F.lit("")))
    part = functions.select(F.call_function("div", F.col("seq"), F.lit(10_000)).alias("block"), "seq", line.alias("line"))
    blocks = part.groupBy("block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n"), 256).alias("h"))
    return blocks.agg(F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ""), 256), F.lit(16)).alias("fingerprint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


#: Rows of a block of vectors and of a block of queries: a pair of blocks is one task's matter.
VECTORS, QUERIES = 32_768, 16_384


def vector_top(vectors: DataFrame, query: DataFrame, least: float, top: int) -> DataFrame:
    """vectors: id, v; query: query_id, q: id, score, rank with cosine of unit vectors >= least.

    Every query meets every vector, block by block: matrix products name those that can be among a block's best, whose sums
    are then taken again in order, so that scores are those of the plain sum."""
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    v, q = vectors.select("id", "v").filter(whole("v")), query.select("query_id", "q").filter(whole("q"))
    most = [max(1, -(-df.count() // size)) for df, size in ((v, VECTORS), (q, QUERIES))]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("id", "v", F.pmod(F.hash("id"), F.lit(most[0])).alias("vb"), every(most[1]).alias("qb"))
    q = q.select("query_id", "q", F.pmod(F.hash("query_id"), F.lit(most[1])).alias("qb"), every(most[0]).alias("vb"))
    schema = f"query_id {query.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, dot double"
    rows = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(_block_best(least, top), schema)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("dot")), 6)).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "id", "score", "rank")


def _block_best(least: float, top: int):
    """f(vectors, queries): for each query the `top` vectors of the block by score in millionths (ties to the smaller id)."""

    def best(vectors, queries):
        from decimal import ROUND_HALF_UP, Decimal

        import numpy as np
        import pandas as pd

        def millionths(dots):
            x = np.fmin(dots, 1.0) * 1e6
            s = np.rint(x)
            for i in np.flatnonzero(np.abs(np.abs(x - np.floor(x)) - 0.5) < 1e-4):
                s[i] = int(Decimal(repr(float(x[i] if np.isnan(dots[i]) else min(dots[i], 1.0)))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
            return s

        out = []
        vectors = vectors.sort_values("id", kind="stable")
        v_len, q_len = vectors["v"].map(len).to_numpy(), queries["q"].map(len).to_numpy()
        for n in np.unique(q_len):
            here, asked = vectors[v_len == n], queries[q_len == n]
            if not len(here):
                continue
            ids, v = here["id"].to_numpy(), np.stack(here["v"].to_numpy()).astype(float)
            far = np.linalg.norm(v, axis=1).max()
            for at in range(0, len(asked), 512):
                part = asked.iloc[at : at + 512]
                names, q = part["query_id"].to_numpy(), np.stack(part["q"].to_numpy()).astype(float)
                slack = 1e-9 + (n + 2) * 2.3e-16 * far * np.linalg.norm(q, axis=1).max()
                limit = np.full(len(q), least - 1e-6 - slack)
                row, who, score, dot = (np.empty(0, t) for t in (np.int64, ids.dtype, float, float))
                for start in range(0, len(v), 4096):
                    block = v[start : start + 4096]
                    r, c = np.nonzero(~(q @ block.T < limit[:, None]))
                    other = ids[start + c] != names[r]
                    r, c = r[other], c[other]
                    if not len(r):
                        continue
                    sums = np.zeros(len(r))
                    for k in range(n):
                        sums += block[c, k] * q[r, k]
                    row, who, dot = np.concatenate([row, r]), np.concatenate([who, ids[start + c]]), np.concatenate([dot, sums])
                    score = np.concatenate([score, millionths(sums)])
                    order = np.lexsort((who, -score, row))
                    first = np.searchsorted(row[order], row[order])
                    order = order[np.arange(len(order)) - first < top]
                    row, who, score, dot = row[order], who[order], score[order], dot[order]
                    count = np.bincount(row, minlength=len(q))
                    last = np.cumsum(count)[count >= top] - 1
                    # Later ids lose ties, so only a better score comes in; nothing is better than 1.
                    limit[count >= top] = np.maximum(limit[count >= top], np.where(score[last] >= 1e6, np.inf, (score[last] + 0.5) * 1e-6 - slack))
                out.append(pd.DataFrame({"query_id": names[row], "id": who, "dot": dot}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "dot": []}).astype({"query_id": "int64", "id": "int64", "dot": float})

    return best


def quota_merge(results: DataFrame, n: int) -> DataFrame:
    """results: name, kind, file, score. Each kind has a quota, the rest is filled best first; duplicates by key once."""
    quota = F.when(F.col("kind") == "file", max(2, n // 5)).otherwise(max(3, n // 3))
    # Equals of several kinds stay in the order in which the kinds are handed in: functions, classes, files.
    order = [F.desc("score"), "name", "file", F.when(F.col("kind") == "function", 0).when(F.col("kind") == "class", 1).otherwise(2), "kind"]
    best = results.groupBy("name", "kind", "file").agg(F.max("score").alias("score"))
    # No more than n of a kind can be picked; the filter on the rank lets every task drop the rest before they meet.
    ranked = best.withColumn("kr", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("kr") <= n).withColumn("inside", F.col("kr") <= quota)
    place = F.row_number().over(Window.orderBy(F.desc("inside"), *order))
    picked = ranked.orderBy(F.desc("inside"), *order).limit(n)
    return picked.withColumn("place", place).select("name", "kind", "file", "score", "place")


def fuse(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Both keyed by id: vectors over 0.20 raise keyword scores, vector-only hits need more than 0.30."""
    k = keyword.select("id", F.col("score").alias("k"))
    v = vector.select("id", F.col("score").alias("v"))
    rows = k.join(v, "id", "full")
    both = F.when(F.col("k").isNull(), F.when(F.col("v") > 0.30, F.col("v"))).when(F.col("v") > 0.20, F.greatest("k", "v")).otherwise(F.col("k"))
    return rows.select("id", both.alias("score")).filter("score is not null")


def gated(results: DataFrame, tokens: DataFrame, symbols: DataFrame, vocabulary: DataFrame, nonsense: DataFrame) -> DataFrame:
    """results with scores of at most 0.35 for questions that are taken for nonsense, have no token that equals or shares its stem
    with a symbol's, and fewer than two tokens in the sources.

    results: query_id, score; tokens: query_id, token; symbols, vocabulary: token; nonsense: query_id."""
    asked = tokens.select("query_id", "token").distinct().withColumn("k", F.left("token", F.lit(4)))
    known = symbols.select(F.col("token").alias("s")).distinct().withColumn("k", F.left("s", F.lit(4)))
    named = asked.join(known, "k").filter((F.col("token") == F.col("s")) | stem_match("token", "s")).select("query_id").distinct()
    found = asked.join(vocabulary.select("token").distinct(), "token", "left_semi").groupBy("query_id").count().filter("count >= 2").select("query_id")
    cut = nonsense.select("query_id").distinct().join(named.union(found).distinct(), "query_id", "left_anti").withColumn("cut", F.lit(True))
    return results.join(cut, "query_id", "left").withColumn("score", F.when(F.col("cut"), F.least("score", F.lit(0.35))).otherwise(F.col("score"))).drop("cut")


def with_expansion(primary: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """Expansions take up to n/2 places (three stay for primary hits) and come after them, whatever their score."""
    slots = min(n // 2, max(0, n - 3))
    extra = more.join(primary.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(slots).withColumn("tier", F.lit(2))
    head = primary.orderBy(F.desc("score"), "id").limit(n - slots).withColumn("tier", F.lit(1))
    rows = head.unionByName(extra)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))


def numbered(rows: DataFrame, order: list, into: str) -> DataFrame:
    """rows with their place (from 1) in a global order: sorted ranges are numbered on their own, and only the ranges' sizes meet."""
    at = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    joined = at.withColumn("part", part).join(F.broadcast(sizes), "part")
    return joined.withColumn(into, F.col("before") + local + 1).drop("_at", "part", "before")


def low_confidence(results: DataFrame) -> DataFrame:
    best = results.agg((F.max("score") < 0.55).alias("low_confidence"))
    return results.crossJoin(F.broadcast(best))


def directory_cap(files: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` files of a directory first; what exceeds that follows. files: path, score."""
    rank = F.row_number().over(Window.partitionBy(paths.directory("path")).orderBy(F.desc("score"), "path"))
    return numbered(files.withColumn("over", (rank > most).cast("int")), ["over", F.desc("score"), "path"], "place")


def file_scores(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Best symbol over 0.15 of each file against 0.6 of the file name's score. symbols: file, score; names: file, score."""
    best = symbols.filter("score > 0.15").groupBy("file").agg(F.max("score").alias("s"), F.count("*").alias("n_symbols"))
    rows = best.join(names.select("file", (0.6 * F.col("score")).alias("f")), "file", "full")
    return rows.select("file", F.round(F.greatest(F.coalesce("s", F.lit(0.0)), F.coalesce("f", F.lit(0.0))), 6).alias("score"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))
