"""Fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import os

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

BASE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a very old tree near the cold river "


def awkward_rows():
    rows = [
        (1, "Hello world, this is a plain text.\nWith two lines.", "en", "src1", 10),
        (2, None, "en", "src1", 0),
        (3, "", None, None, None),
        (4, "word " * 3000, "de", "src0", 5),
        (5, BASE * 5, "en", "src0", 5),
        (6, BASE * 5, "en", "src0", 5),
        (6, BASE * 5, "en", "src0", 5),
        (7, (BASE * 5).replace("cold", "warm", 1), "en", "src2", 5),
        (None, "no id here but some text to keep", "fr", "src3", 3),
        (8, "É" * 500 + " ünï", "fr", "src3", 3),
        (9, "\n\n \t \n", "fr", "src3", 3),
        (10, "same line here with words\nsame line here with words\n# $ % & | < >", "es", "src4", 3),
    ]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def table_dir(tmp_path, spark, name="documents", df=None):
    (awkward(spark) if df is None else df).write.mode("overwrite").parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
    return str(tmp_path)
