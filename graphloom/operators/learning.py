"""Feature vectors, small networks, splits and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graphloom.functions import paths
from graphloom.functions.text import bigrams, bound, jaccard, marked_bigrams, normalised, saturating, short_tokens

ALPHABET = 29  # a-z, ^, $ and space: 841 pairs


def caller_features(rows: DataFrame) -> DataFrame:
    """Serve-time vector of the caller disambiguator: receiver and class names, files, counts. Reserved places hold 0.

    rows: receiver, class_name, callee, caller_file, class_file, has_dot, trusted, same_class, imported, n_classes, n_callers."""
    b = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    r, c = short_tokens("receiver"), short_tokens("class_name")
    shared = F.size(F.array_intersect(paths.parts(paths.directory("caller_file")), paths.parts(paths.directory("class_file"))))
    deepest = F.greatest(F.size(paths.parts(paths.directory("caller_file"))), F.size(paths.parts(paths.directory("class_file"))), F.lit(1))
    values = [
        jaccard(r, c), jaccard(bigrams("receiver"), bigrams("class_name")), F.lower(F.col("receiver")).eqNullSafe(F.lower("class_name")).cast("double"),
        F.arrays_overlap(r, c).cast("double"), (F.size(r) > 0).cast("double"), b("has_dot"), b("trusted"), b("same_class"), b("imported"),
        F.col("caller_file").eqNullSafe(F.col("class_file")).cast("double"), shared / deepest, 1 / F.greatest(b("n_classes"), F.lit(1.0)),
        (b("n_classes") == 1).cast("double"), saturating(b("n_callers"), 20), saturating(F.size(short_tokens("callee")), 5),
    ]
    zeros = [F.lit(0.0)] * (25 - len(values))
    return rows.withColumn("features", F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values + zeros]))


def importance_features(rows: DataFrame) -> DataFrame:
    """Serve-time vector of symbol importance. rows: name, file, n_callers, n_files, n_importers, n_methods."""
    deep = F.size(F.filter(paths.parts("file"), lambda p: p != ""))
    api = F.lower("file").rlike(r"(^|/)(api|routes|endpoints|views|controllers)(/|\.)")
    values = [
        saturating("n_callers", 20), saturating("n_files", 10), api.cast("double"), F.col("name").isin("main", "__main__", "app").cast("double"),
        saturating("n_importers", 20), saturating("n_methods", 20), paths.is_test("file").cast("double"), saturating(deep, 8), saturating(F.length("name"), 30),
    ]
    return rows.withColumn("features", F.array(*[v.cast("double") for v in values], *[F.lit(0.0)] * 9))


def importance_fallback(callers: Column, importers: Column) -> Column:
    return F.least((callers + importers) / 50, F.lit(1.0))


def proxy_importance(rows: DataFrame) -> DataFrame:
    """Label 1 from .5 on. rows: in_readme, in_api, n_files, n_subclasses, in_all."""
    score = (
        0.30 * F.col("in_readme").cast("int") + 0.25 * F.col("in_api").cast("int") + 0.15 * (F.col("n_files") > 10).cast("int")
        + 0.10 * (F.col("n_subclasses") > 0).cast("int") + 0.10 * (F.col("n_files") > 3).cast("int") + 0.10 * F.col("in_all").cast("int")
    )
    return rows.withColumn("score", F.round(score, 6)).withColumn("label", (F.round(score, 6) >= 0.5).cast("int"))


def meta_features(text: Column, log_prob: Column) -> Column:
    """Eight signs of gibberish. log_prob: the mean log-probability of the marked bigrams."""
    return bound(normalised(text), lambda s: _meta_features(text, s, log_prob))


def _meta_features(text: Column, s: Column, log_prob: Column) -> Column:
    n = F.greatest(F.length(s), F.lit(1))
    chars = F.array_distinct(F.split(s, ""))
    entropy = -F.aggregate(
        F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n), F.lit(0.0).cast("double"),
        lambda a, p: a + p * F.log2(p),
    )
    letters = F.regexp_replace(s, "[^a-z]", "")
    vowels = F.length(F.regexp_replace(letters, "[^aeiou]", ""))
    runs = F.array_max(F.transform(F.split(letters, "[aeiou]"), lambda x: F.length(x)))
    return F.array(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (log_prob + 10) / 7)), entropy / 4.7, vowels / F.greatest(F.length(letters), F.lit(1)), F.least(F.lit(1.0), runs / 6),
        F.log(F.length(s) + 1) / F.log(F.lit(50.0)), text.contains("_").cast("double"), text.rlike("[A-Z]").cast("double"), F.least(F.lit(1.0), F.size(F.split(F.trim(s), " +")) / 5),
    )


def bigram_vector(text: Column) -> Column:
    """Sparse part of the gibberish vector: index -> count / norm over the marked bigrams' 841 places."""
    place = lambda c: F.when(c == "^", 26).when(c == "$", 27).when(c == " ", 28).otherwise(F.ascii(c) - 97)
    index = F.transform(marked_bigrams(text), lambda g: place(F.substring(g, 1, 1)) * ALPHABET + place(F.substring(g, 2, 1)))
    kept = F.sort_array(F.filter(index, lambda i: (i >= 0) & (i < ALPHABET * ALPHABET)))
    # Equal places lie side by side: a run's length is the way to the start of the next one.
    starts = lambda k: F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda p: (p == 0) | (F.get(k, p) != F.get(k, p - 1)))
    end = lambda k, at, n: F.coalesce(F.get(at, n + 1), F.size(k))
    runs = lambda k: bound(starts(k), lambda at: F.transform(at, lambda p, n: F.struct(F.get(k, p).alias("i"), (end(k, at, n) - p).cast("double").alias("c"))))
    norm = lambda rows: F.sqrt(F.aggregate(rows, F.lit(0.0).cast("double"), lambda a, x: a + x["c"] * x["c"]))
    scaled = lambda rows: bound(norm(rows), lambda all_: F.transform(rows, lambda x: F.struct(x["i"].alias("i"), (x["c"] / all_).alias("v"))))
    return bound(kept, lambda k: bound(F.when(F.size(k) > 0, runs(k)).otherwise(F.array().cast("array<struct<i:int,c:double>>")), scaled))


class Mlp:
    """ReLU network with a sigmoid output; weights as lists of (W, b)."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return 1 / (1 + np.exp(-np.clip(x[:, 0], -20, 20)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (32, 16), epochs: int = 60, rate: float = 5e-3, seed: int = 0) -> Mlp:
        """Adam on binary cross-entropy, in batches of 256, on a bounded sample that the caller has gathered."""
        rng = np.random.default_rng(seed)
        sizes = [x.shape[1], *hidden, 1]
        params = [p for a, b in zip(sizes, sizes[1:]) for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                acts = [x[part]]
                for i in range(0, len(params), 2):
                    z = acts[-1] @ params[i] + params[i + 1]
                    acts.append(np.maximum(z, 0) if i + 2 < len(params) else 1 / (1 + np.exp(-np.clip(z, -20, 20))))
                d, grads = (acts[-1] - y[part, None]) / len(part), []
                for i in range(len(params) - 2, -1, -2):
                    a = acts[i // 2]
                    grads = [a.T @ d, d.sum(0), *grads]
                    d = (d @ params[i].T) * (a > 0)
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls([(params[i], params[i + 1]) for i in range(0, len(params), 2)])


def predict(rows: DataFrame, model: Mlp, into: str = "score") -> DataFrame:
    """Arrow-batched inference over the `features` array."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(np.stack(s.to_numpy()).astype(float)) if len(s) else [])

    return rows.withColumn(into, score("features"))


def weights_table(spark, name: str, model: Mlp) -> DataFrame:
    rows = [(name, i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(model.layers)]
    return spark.createDataFrame(rows, "model string, layer int, w array<array<double>>, b array<double>")


def hash_split(key: Column) -> Column:
    """80/10/10 by a hash that any engine can repeat."""
    bucket = F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(10).cast("long"))
    return F.when(bucket < 8, "train").when(bucket == 8, "valid").otherwise("test")


def eval_pairs(functions: DataFrame, most: int = 200) -> DataFrame:
    """query, expected from public functions with a first sentence of 5 to 25 words. functions: repo, name, docstring, file, seq."""
    from pyspark.sql.window import Window

    from graphloom.functions.text import first_sentence

    rows = functions.filter(~F.col("name").startswith("_") & ~paths.is_test("file")).withColumn("query", first_sentence("docstring"))
    n = F.size(F.split("query", r"\s+"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("seq"))
    return rows.filter((n >= 5) & (n <= 25)).withColumn("r", rank).filter(F.col("r") <= most).select("repo", "query", F.col("name").alias("expected"), "file")
