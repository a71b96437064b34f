r"""Operator 10: quality rules with cross-document line frequency.

A line is normalised (A-Z lower-cased, white space collapsed) and hashed; lines without a word are never counted or
removed. For each host (`source`) the documents that hold a line, once or more, are counted; lines in more than LIMIT of them
are removed. A document is rejected if it fails the base rules
(fewer than 50 words, or over half of its words in repeated 3-word windows) or is depleted: fewer than 50 words or less
than DEPLETED of its words are left.

Counting is a shuffle of narrow (host, line hash) rows with partial aggregation, so a hot host or line is no hot task.
The lines over the limit are sent to the executors if there are at most BROADCAST_LINES (12 MB); otherwise they are joined to
the documents that hold them, with the same result.

Null text: no words, rejected. Null source: a host of its own, apart from ''. Each row is a document; repeated rows and ties get
equal verdicts. Texts of any length are read whole, one at a time; an empty table gives an empty result; the columns asked
for pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialise, text_of

LIMIT = 50
DEPLETED = 0.3
MIN_WORDS = 50
BROADCAST_LINES = 200_000
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
NAMES = [x.split()[0] for x in METRICS.split(", ")]


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def count_repeats(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = seq[:-1] * v + seq[1:]
    if v < 2**21:
        tri = pair[:-1] * v + seq[2:]
    else:
        tri = np.unique(pair, return_inverse=True)[1][:-1] * v + seq[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order][1:] == tri[order][:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def base_metrics(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(text.translate(None, _NOT_COUNTED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    lines = [x for x in lines if x.split(None, 1)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), count_repeats(words)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [list({line_hash(w) for x in text.as_py().lower().split(b"\n") if (w := x.split())}) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "lines"])


def frequent_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """host, line: the hashes of lines found in more than `limit` documents of the host."""
    lines = docs.select(F.col("source").alias("host"), text_of().cast("binary").alias("text")).mapInArrow(_lines_of, "host string, lines array<long>")
    counted = lines.select("host", F.explode("lines").alias("line")).groupBy("host", "line").count()
    return counted.filter(F.col("count") > limit).select("host", "line")


def _judge(frequent: dict[str, set[int]] | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("lines") if frequent is None else None
            cols: list[list] = [[] for _ in range(7)]
            texts = []
            for i, (host, text) in enumerate(zip(batch.column("host"), batch.column("text"), strict=True)):
                raw = text.as_py()
                values = base_metrics(raw)
                n, repeat = values[0], values[4]
                failed = n < MIN_WORDS or 100 * repeat > 50 * n
                bad = (frequent.get(host.as_py()) if own is None else set(own[i].as_py() or ())) or ()
                kept = not failed
                if bad and kept:
                    left, out = 0, []
                    for line in raw.split(b"\n"):
                        words = line.lower().split()
                        if words and line_hash(words) in bad:
                            continue
                        left += len(words)
                        out.append(line)
                    kept = left >= MIN_WORDS and left >= DEPLETED * n
                    if kept and left < n:
                        raw = b"\n".join(out)
                texts.append(raw.decode())
                for c, v in zip(cols, (*values, failed, kept), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            mine = [c for c in batch.schema.names if c[0] == "c"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in mine), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(texts, pa.string())],
                [*mine, *NAMES, "cleaned"],
            )

    return judge


def judge_documents(docs: DataFrame, keep: list[str], limit: int = LIMIT, cleaned: bool = True) -> DataFrame:
    """`keep` columns of every document with the metrics, the verdict and, if asked for, the text without frequent lines."""
    frequent = materialise(frequent_lines(docs, limit))
    # Callers' columns go by number, so that no name of theirs can clash.
    own = [docs.schema[c] for c in keep]
    mine = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)]
    text = text_of().cast("binary")
    rows = docs.select(*mine, F.col("source").alias("host"), text.alias("text"))
    held = None
    if frequent.count() <= BROADCAST_LINES:
        held = {}
        for r in frequent.toLocalIterator():
            held.setdefault(r["host"], set()).add(r["line"])
    else:
        # Equal texts of a host hold the same lines, so hash and length of the text name them.
        key = [F.col("source").alias("host"), F.xxhash64(text).alias("th"), F.crc32(text).alias("tc")]
        lines = docs.select(*key, text.alias("text")).mapInArrow(_lines_of, "host string, th long, tc long, lines array<long>")
        lines = lines.select("host", "th", "tc", F.explode("lines").alias("l"))
        found = lines.join(frequent.select(F.col("host").alias("fh"), "line"), F.col("host").eqNullSafe(F.col("fh")) & (F.col("l") == F.col("line")))
        found = found.groupBy("host", "th", "tc").agg(F.collect_set("line").alias("lines")).withColumnsRenamed({"host": "fh", "th": "fth", "tc": "ftc"})
        tagged = docs.select(*mine, *key, text.alias("text"))
        same = F.col("host").eqNullSafe(F.col("fh")) & (F.col("th") == F.col("fth")) & (F.col("tc") == F.col("ftc"))
        rows = tagged.join(found, same, "left").drop("fh", "fth", "ftc", "th", "tc")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)])
    for name, kind in (x.split() for x in f"{METRICS}, cleaned string".split(", ")):
        schema = schema.add(name, kind)
    out = rows.mapInArrow(_judge(held), schema)
    return (out if cleaned else out.drop("cleaned")).toDF(*keep, *NAMES, *["cleaned"] * cleaned)


def op10_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_documents(docs, ["doc_id"], cleaned=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, frequent lines are taken out of the rest."""
    out = judge_documents(docs, ["doc_id", "lang", "source"])
    return out.filter("kept").select(
        "doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars")
    )


_W = r"[^\x20\x09-\x0D]+"
OP10_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source AS host, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
  tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
  lw AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS lws FROM l WHERE regexp_matches(line, '{_W}')),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
  norm AS (SELECT doc_id, host, text, array_to_string(lws, ' ') AS line, len(lws) AS n FROM lw),
  freq AS (SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT doc_id) > {LIMIT}),
  gone AS (SELECT doc_id, sum(n) AS gone FROM norm JOIN freq ON norm.line = freq.line AND norm.host IS NOT DISTINCT FROM freq.host GROUP BY doc_id),
  m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS gone
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
  f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_words - gone >= {MIN_WORDS} AND n_words - gone >= {DEPLETED} * n_words AS kept FROM f"""
