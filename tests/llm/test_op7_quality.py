import zlib

import numpy as np
import pytest

from graphloom.llm import classifier
from tests.llm.helpers import DOCS, SMALL, awkward_rows, table_dir

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int"


def scores(spark, folder):
    return {r.doc_id: r for r in classifier.op7_quality(spark, folder).collect()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def vote(texts, labelled, asked):
    """Brute force: dense features, the projection from a full SVD, every cosine on its own."""
    marks = [classifier.features(t) for t in labelled]
    idf = np.log((1 + len(marks)) / (1 + sum((g > 0).astype(int) for g, _ in marks))) + 1

    def row(found):
        g = found[0].astype(float) * idf
        return np.concatenate([g / max(np.linalg.norm(g), 1e-9), classifier.FORM_WEIGHT * found[1]])

    space = np.stack([row(m) for m in marks])
    basis = np.linalg.svd(space, full_matrices=False)[2][: classifier.DIM].T
    known = [v / max(np.linalg.norm(v), 1e-9) for v in space @ basis]
    out = []
    for t in asked:
        v = row(classifier.features(t)) @ basis
        v = v / max(np.linalg.norm(v), 1e-9)
        near = sorted(((round(float(v @ k), 9), i) for i, k in enumerate(known)), reverse=True)[: classifier.NEIGHBOURS]
        weight = [max(s, 1e-3) ** classifier.POWER for s, _ in near]
        out.append(sum(w * texts[i] for w, (_, i) in zip(weight, near)) / sum(weight))
    return out


def test_scores_are_the_brute_force_vote(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality is not None and not held_out(r.doc_id)]
    labels = [(i, q) for i, q in labels if i in docs]
    ids = sorted(docs)
    want = vote([q for _, q in labels], [docs[i] for i, _ in labels], [docs[i] for i in ids])
    got = scores(spark, SMALL)
    close = [abs(got[i].score - w) < 1e-3 for i, w in zip(ids, want)]
    assert np.mean(close) > 0.98, np.mean(close)  # ties at the last neighbour may fall either way
    assert all(got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == held_out(i) for i in ids)


def test_held_out_accuracy(spark):
    got = scores(spark, FOLDER)
    labels = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality is not None and held_out(r.doc_id)]
    right = [got[r.doc_id].predicted == r.quality for r in labels if r.doc_id in got]
    assert len(right) > 500 and sum(right) / len(right) > 0.985


def test_text_part_alone_decides_most(spark, monkeypatch):
    """Without any indicator of form the trigram space still tells the labels apart."""
    monkeypatch.setattr(classifier, "FORM_WEIGHT", 0.0)
    got = scores(spark, FOLDER)
    labels = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality is not None and held_out(r.doc_id)]
    right = [got[r.doc_id].predicted == r.quality for r in labels if r.doc_id in got]
    assert sum(right) / len(right) > 0.94
    part = 9 * 0.3**2
    assert part / (1 + part) < 0.5


def test_fit_does_not_depend_on_layout(spark, monkeypatch):
    monkeypatch.setattr(classifier, "MAX_LABELLED", 60)
    rows = [(i, f"{'good plain words here ' * (i % 7 + 2)} number{i}" if i % 3 else f"$$ {i} ## BUY %%% " * 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], LABELS)
    texts = [t.encode() for _, t in rows]
    one = classifier.fit(docs.repartition(2), labels.repartition(5)).score(texts)
    two = classifier.fit(docs.repartition(7), labels.repartition(1)).score(texts[::-1])[::-1]
    assert one.tolist() == two.tolist()
    assert len(classifier.fit(docs, labels).labels) == 60


def test_awkward_and_empty(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (5, 1), (999, 0)], LABELS)
    table_dir(tmp_path / "a", spark)
    folder = table_dir(tmp_path / "a", spark, "labels", labels)
    rows = classifier.op7_quality(spark, folder).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS))
    empty = table_dir(tmp_path / "b", spark, "labels", spark.createDataFrame([], LABELS))
    assert classifier.op7_quality(spark, empty).count() == 0
    table_dir(tmp_path / "c", spark)
    none = table_dir(tmp_path / "c", spark, "labels", spark.createDataFrame([], LABELS))
    assert {r.score for r in classifier.op7_quality(spark, none).collect()} == {0.5}


@pytest.mark.parametrize("name", ["text.b", "__text", "score0", "h"])
def test_clashing_names_and_long_text(spark, name):
    docs = spark.createDataFrame([(1, "plain words " * 200_000, "kept"), (2, None, "too")], f"doc_id long, text string, `{name}` string")
    labels = spark.createDataFrame([(1, 1)], LABELS)
    model = classifier.fit(docs, labels)
    out = classifier.score_documents(docs, model, ["doc_id", name])
    assert out.columns == ["doc_id", name, "score"]
    assert [(r[0], r[1]) for r in sorted(out.collect())] == [(1, "kept"), (2, "too")]
