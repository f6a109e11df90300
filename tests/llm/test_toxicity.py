import itertools
import os
import random

import numpy as np
import pytest

from shelfcast.llm import toxicity
from tests.llm.fixtures import awkward, frame, prose

FOLDER = "/root/testdata/sf0.1"


def brute(e, trans, begin):
    """Marginals by summing over all labellings of one chain."""
    p, z = np.zeros(len(e)), 0.0
    for y in itertools.product((0, 1), repeat=len(e)):
        s = begin * y[0] + sum(x * v for x, v in zip(e, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        z += np.exp(s)
        p += np.exp(s) * np.array(y)
    return p / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = [1, 2, 7, 1, 9, 4]
    e, trans, begin = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, (2, 2)), -0.7
    first = np.zeros(sum(lengths), bool)
    starts = np.cumsum([0, *lengths[:-1]])
    first[starts] = True
    got = toxicity.marginals(e, first, trans, begin)[2]
    want = np.concatenate([brute(e[a : a + n], trans, begin) for a, n in zip(starts, lengths, strict=True)])
    assert np.allclose(got, want)


def corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 60)).split()
        if bad := i % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblix", "snarvo"]) + rng.choice(["", "en", "ost", "."]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_scores_and_offsets(spark):
    rows, labels = corpus()
    more = awkward()
    kinds = "doc_id long, quality long, toxic long"
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), (2, 0, 0)], kinds)
    docs = frame(spark, rows + [(5000 + i, t, s) for i, (_, t, s) in enumerate(more)])
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(got) == len(rows) + len(more)
    right = [got[i]["predicted"] == t for i, _, t in labels if got[i]["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(got[5000 + i]["predicted"] == 0 for i in range(len(more)))
    for i, text, _ in rows:
        for a, b in (map(int, x.split(":")) for x in got[i]["spans"].split(",") if x):
            assert text[a:b].startswith(("grumblix", "snarvo")), text[a:b]
    kept = toxicity.keep_clean(docs, marks)
    assert kept.schema.names == docs.schema.names and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_no_labels_and_empty_table(spark):
    kinds = "doc_id long, quality long, toxic long"
    none = spark.createDataFrame([], kinds)
    assert toxicity.score_documents(frame(spark, awkward()), none).where("score >= 0.5").count() == 0
    assert toxicity.score_documents(frame(spark, []), none).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, marks = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.score_documents(docs, marks).where("held_out").join(marks, "doc_id").select("toxic", "predicted").toPandas()
    hit = scored[scored.toxic == 1].predicted.mean()
    false = scored[scored.toxic == 0].predicted.mean()
    assert hit >= 0.9 and false <= 0.01


def test_sample_holds_what_can_be_used(spark):
    rows, labels = corpus(200)
    kinds = "doc_id long, quality long, toxic long"
    # Labels of ids that are not in docs, and toxic documents that are all long.
    elsewhere = [(10_000 + i, 1, i % 2) for i in range(400)]
    long = [(i, " ".join([t] * 30) if i % 8 == 0 else t, s) for i, t, s in rows]
    got = toxicity.training_rows(frame(spark, long), spark.createDataFrame(labels + elsewhere, kinds), 15, 1500).collect()
    toxic = [r["text"] for r in got if r["toxic"]]
    assert toxic and sum(map(len, toxic)) <= 15 * 1500 and len(got) - len(toxic) == 30
    assert sum(map(len, toxic)) >= 0.9 * 15 * 1500 or len(toxic) == 15
