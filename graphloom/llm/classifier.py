"""Operator 7: quality classifier by nearest-neighbour voting in a latent-semantic space.

Features of a text: hashed byte trigrams (log counts times inverse document frequency, unit length) and indicator bins of its
form (capitals, digits, symbols, repeated words, word and line lengths), which hold 45 % of a vector's squared length. A
singular value decomposition of the labelled sample's feature matrix gives the latent space; the labelled vectors (at most
MAX_LABELLED x DIM doubles, 2 MB) are broadcast, every document's exact cosine products with all of them are computed in
blocks, and its NEIGHBOURS nearest labels vote with weight similarity ** POWER.

Fit: rows of `labels` whose crc32(doc_id as text) mod 5 is not 0, at most MAX_LABELLED of them (the documented bound on the
only sample taken): those with the least hash of doc_id, in that order, so the fit depends on the rows alone and not on
their layout. No label, language, source or id is an input of a score. Null texts count as empty; null labels and ids are
not learned from; labels without a document are passed over; without any usable label every score is 0.5. Texts of any
length are read whole, one at a time. Repeated rows and ties get equal scores, an empty table gives an empty result, and
further columns are ignored under any name. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import text_of

MAX_LABELLED = 4000
GRAMS = 2048
DIM = 64
NEIGHBOURS = 9
POWER = 40.0
THRESHOLD = 0.3
BLOCK = 256
#: Weight of one form indicator beside the unit-length trigram part.
FORM_WEIGHT = 0.3
FORMS, BINS = 9, 8
WIDTH = GRAMS + FORMS * BINS


def form(raw: bytes) -> list[float]:
    """Shares in 0..1 that describe how a text is written rather than what it says."""
    n = max(len(raw), 1)
    words = raw.split()
    m = max(len(words), 1)
    letters = max(len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")), 1)
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>{}[]()=_~^@!"))
    lines = [x for x in raw.split(b"\n") if x]
    short = sum(len(w) <= 2 for w in words)
    return [
        capitals / letters, min(1.0, 5 * digits / n), min(1.0, 5 * symbols / n), len(set(words)) / m,
        1 - len(set(lines)) / max(len(lines), 1), min(1.0, len(raw) / m / 20), short / m,
        min(1.0, np.log10(m + 1) / 5), min(1.0, 2.5 * sum(map(bytes.__eq__, words, words[1:])) / m),
    ]


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log trigram counts (GRAMS) and form indicators (FORMS * BINS)."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(GRAMS, np.float32)
    if len(b) > 2:
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(21)
        counts = np.log1p(np.bincount(code, minlength=GRAMS)).astype(np.float32)
    marks = np.zeros(FORMS * BINS, np.float32)
    for i, x in enumerate(form(raw)):
        marks[i * BINS + min(BINS - 1, int(x * BINS))] = 1
    return counts, marks


def matrix(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, raw in enumerate(texts):
        counts, marks = features(raw)
        counts = counts * idf
        out[i, :GRAMS] = counts / max(float(np.linalg.norm(counts)), 1e-9)
        out[i, GRAMS:] = FORM_WEIGHT * marks
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Projection to the latent space and the labelled vectors in it."""

    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            block = unit(matrix(texts[at : at + BLOCK], self.idf).astype(np.float64) @ self.basis)
            # Rounded, so that equal texts get equal scores whatever block they are in.
            near = np.round(block @ self.vectors.T, 9)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1), 1e-3) ** POWER
            out[at : at + BLOCK] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.clip(np.round(out, 9), 0.0, 1.0)


def _raw_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()) for t in batch.column("text")]
        blobs = [np.concatenate(m).tobytes() for m in made]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "doc_id", "quality")), pa.array(blobs, pa.binary())], ["h", "doc_id", "quality", "blob"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Learns from at most MAX_LABELLED labels, those with the least hash of doc_id."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.xxhash64("doc_id", F.lit(7)).alias("h"), "doc_id", F.col("quality").cast("int").alias("quality")
    )
    chosen = usable.distinct().orderBy("h", "doc_id", "quality").limit(MAX_LABELLED)
    rows = docs.select("doc_id", text_of().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("h", "doc_id", "quality", "text").mapInArrow(_raw_features, "h long, doc_id long, quality int, blob binary")
    # Rows that share an id may be more than the labels: the bound holds for them too.
    got = found.orderBy("h", "doc_id", "quality", "blob").limit(MAX_LABELLED).toPandas()
    if not len(got):
        return Model(np.ones(GRAMS, np.float32), np.zeros((WIDTH, DIM), np.float32), np.zeros((0, DIM), np.float32), np.zeros(0))
    raw = np.stack([np.frombuffer(x, np.float32) for x in got["blob"]])
    seen = (raw[:, :GRAMS] > 0).sum(0)
    idf = np.log((1 + len(raw)) / (1 + seen)).astype(np.float32) + 1
    x = np.zeros_like(raw)
    grams = raw[:, :GRAMS] * idf
    x[:, :GRAMS] = grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    x[:, GRAMS:] = FORM_WEIGHT * raw[:, GRAMS:]
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIM])
    return Model(idf, basis, unit(x.astype(np.float64) @ basis), got["quality"].to_numpy(np.float64))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, text = batch.columns
            scores = model.score([t.as_py() for t in text])
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns and the score (0 to 1) of every document."""
    own = [docs.schema[c] for c in keep]
    rows = docs.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)), text_of().cast("binary").alias("text"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)]).add("score", T.DoubleType())
    return rows.mapInArrow(_scorer(model), schema).toDF(*keep, "score")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5).cast("long")) == 0, F.lit(False))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out())
    model = fit(docs, labels)
    return score_documents(docs, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
