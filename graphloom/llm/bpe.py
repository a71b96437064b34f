"""Operator 6: BPE encoding and decoding, equal to the tokenizers library on word_bpe_49k.json.

Encoding a word: its byte symbols form a doubly linked list, a priority queue holds (merge rank, position) of adjacent
pairs; the least one is merged, its two neighbours are queued again and entries whose symbols have changed since are
skipped. Decoding joins the vocabulary strings of the ids by one space, as the file (it names no decoder) asks for.
Text is first cut at the added tokens, then NFC-normalised, white space collapsed, lower-cased character by character
and split by the file's pattern.

Whole texts are read, null ones as empty; documents are independent, so nothing is shuffled and one row's cost is linear
in its text up to the queue's logarithm. Words are remembered per task in a table of at most CACHE entries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import pieces, text_of, trim

CACHE = 200_000
LONGEST = 64
#: Texts are encoded in pieces of this size, which bounds the lists of ids beside them.
PIECE_BYTES = 2**21
_WS = "\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte (the byte-level convention)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.suffix = model["end_of_word_suffix"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = byte_alphabet()
        self.first = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_WS}")
        self.pieces = regex.compile(pattern)
        self.space = re.compile(f"[{_WS}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[str, int, str]] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        merges = self.merges
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue  # stale: one of the two symbols has changed
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = prv[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return self.pieces.findall(text.replace("Σ", "σ").lower())

    def entry(self, word: str) -> tuple[str, int, str]:
        ids = self.merge(word)
        made = (" ".join(map(str, ids)), len(ids), " ".join([self.strings[i] for i in ids]))
        if len(word) <= LONGEST:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = made
        return made

    def parts(self, text: str) -> list[tuple[str, int, str]]:
        """(ids, their number, their strings) of each word and added token in order."""
        out: list[tuple[str, int, str]] = []
        known, entry = self.known, self.entry
        for piece in self.cut.split(text) if "<|" in text else (text,):
            if piece in self.added:
                out.append((str(self.added[piece]), 1, piece))
            elif piece:
                out += [known.get(w) or entry(w) for w in self.words(piece)]
        return out

    def encode(self, text: str) -> list[int]:
        return np.fromstring(" ".join([p[0] for p in self.parts(text)]), np.int32, sep=" ").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _per_text(path: str | None, make: Callable, names: list[str], kinds: list[pa.DataType], column: str, text: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        bpe = Bpe(path or tokenizer_path())
        split = pieces if text else lambda whole, *_: (whole.slice(i, 500) for i in range(0, whole.num_rows, 500))
        for batch in (part for whole in batches for part in split(whole, column, PIECE_BYTES)):
            at = batch.schema.get_field_index(column)
            made = [make(bpe, x.as_py()) for x in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if i != at]
            cols = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *cols], [*(batch.schema.names[i] for i in kept), *names])

    return run


def _by_number(df: DataFrame, without: list[str], value: Column, into: str, kind: T.DataType, run) -> DataFrame:
    """df but for some columns, and last what `run` makes of `value`. Callers' columns go by number, so that no name can clash."""
    own = [f for f in df.schema.fields if f.name not in (*without, into)]
    rows = df.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)), value.alias("given"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)), T.StructField("made", kind)])
    return rows.mapInArrow(run, schema).toDF(*(f.name for f in own), into)


def encode(docs: DataFrame, path: str | None = None, into: str = "ids") -> DataFrame:
    """docs without `into`, plus the ids of its text. path: a tokenizer file that the executors can read."""
    run = _per_text(path, lambda b, t: (b.encode(t),), ["made"], [pa.list_(pa.int32())], "given")
    return _by_number(docs, [], text_of(), into, T.ArrayType(T.IntegerType()), run)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows without ids, plus the decoded text; null ids decode to an empty text."""
    run = _per_text(path, lambda b, x: (b.decode(x or []),), ["made"], [pa.string()], "given", text=False)
    return _by_number(rows, [ids], F.col(f"`{ids}`"), into, T.StringType(), run)


def _digests(bpe: Bpe, text: str) -> tuple[int, str, str]:
    parts = bpe.parts(text)
    hashed = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return sum([p[1] for p in parts]), hashed(" ".join([p[0] for p in parts])), hashed(" ".join([p[2] for p in parts]))


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with the number of tokens and digests of ids and decoded text, in one pass."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    run = _per_text(path, _digests, names, [pa.int64(), pa.string(), pa.string()], "__text")
    rows = docs.select("doc_id", text_of().alias("__text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its token ids and their number."""
    rows = encode(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))
