"""Corpus pipeline over `documents`: quality rules, line dedup, near-duplicate removal, mixing, tokens.

Each stage is one operator applied to all that the stage before has kept. Every stage but the last returns the columns of
`documents`; the last adds the token ids and their number. run() writes each stage to the shared folder and reads it back.
"""

from graphloom.llm import bpe, lines, mixture, ngrams, rules
from graphloom.llm.common import materialise

STAGES = [
    ("quality rules", rules.stage),
    ("line dedup", lines.stage),
    ("n-gram Jaccard join", ngrams.stage),
    ("mixing sources to target weights", mixture.stage),
    ("BPE encoding", bpe.stage),
]

#: Line dedup, n-gram join and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
