import math
import random
import zlib

import numpy as np
import pyarrow as pa
from brute import prose
from pyspark.sql import functions as F

from pathloom.llm import toxicity as T


def labelled(spark):
    rng = random.Random(8)
    bad = ["Awful", "nasty", "vile"]
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(rng, rng.randint(5, 80)).split(" "), rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), "en", 0.5))
        if i % 4:
            labels.append((i, int(toxic), 1))
    rows += [(None, "vile", "en", 0.5), (5000, None, "en", 0.5), (5001, "", "en", 0.5), (3, rows[3][1], "en", 0.5)]
    labels += [(None, 1, 1), (5000, 1, 1), (6, None, 1), (7, labels[4][1], 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    model = T.train(docs, labels)
    assert 0 < len(model[0]) < 2000
    out = T.score(docs, model)
    assert out.columns == [*docs.columns, "__loom_score"]
    truth = {i: any(w in t for w in ("Awful", "nasty", "vile")) for i, t, *_ in rows if t and i is not None}
    right = total = 0
    for r in out.collect():
        assert 0 <= r["__loom_score"] <= 1 and r["score"] == 0.5
        if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            total += 1
            right += (r["__loom_score"] >= 0.5) == truth[r.doc_id]
    assert total > 100 and right / total > 0.97
    again = T.train(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(model[0], again[0]) and np.allclose(model[1], again[1])
    kept = T.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and 600 < kept.count() < 780


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark)
    held = labels.where(T.held_out(labels.doc_id))
    assert held.count() > 100 and len(T.train(docs, held)[0]) == 0
    other = labels.where(~T.held_out(labels.doc_id))
    a, b = T.train(docs, labels), T.train(docs, other)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_no_labels_and_no_rows(spark, empty, documents):
    docs, labels, rows = labelled(spark)
    assert T.remove_toxic(docs, labels.where("false")).count() == len(rows)
    assert T.remove_toxic(empty, labels).count() == 0
    (unknown,) = {r["__loom_score"] for r in T.score(documents, T.train(docs, labels.where("false"))).collect()}
    assert 0 < unknown < 0.5


def test_columns_of_any_name_and_type(spark):
    docs = spark.sql("SELECT id AS doc_id, 'a b' AS text, named_struct('a b', id, 'c', array(1)) AS `x.y`, 1 AS _c0, 2 AS __loom_score FROM range(3)")
    labels = spark.sql("SELECT id AS doc_id, 0 AS toxic FROM range(3)")
    out = T.remove_toxic(docs, labels)
    assert out.schema == docs.schema and out.count() == 3


def test_features():
    f, d = T.features(pa.array(["A b. C", None, "", "a B c!"]))
    assert sorted(f[d == 0]) == sorted(f[d == 3]) and len(f[d == 0]) == 3 + 2 + 1 and not len(f[(d == 1) | (d == 2)])


def test_sparse_updates():
    m = T.Ftrl(4)
    for _ in range(60):
        m.learn(np.array([0, 1]), 1)
        m.learn(np.array([1, 2]), 0)
    w = m.weights(np.arange(5))
    assert w[0] > 0 > w[2] and w[3] == 0


def scalar(rows, epochs, size):
    """FTRL-proximal, one coordinate at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1 = 0.0 if i == size else T.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(epochs):
        for found, label in rows:
            used = [*found, size]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in used:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_training_against_a_scalar_version(spark):
    docs, labels, rows = labelled(spark)
    index, weights = T.train(docs, labels, rows=150)
    told = {}
    for i, toxic, _ in sorted(labels.collect(), key=str):
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 5:
            told[i] = max(toxic, told.get(i, 0))
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in told], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()][:150]
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    examples = []
    for i in order:
        for t in texts.get(i, []):
            f, _ = T.features(pa.array([t]))
            examples.append((sorted(set(f.tolist())), told[i]))
    want = scalar(examples, T.EPOCHS, 1 << T.BITS)
    assert {i: round(w, 9) for i, w in zip(index.tolist(), weights.tolist(), strict=True)} == {i: round(w, 9) for i, w in enumerate(want) if w}
