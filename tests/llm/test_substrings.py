import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import substrings as S


def test_against_brute_force(corpus, documents):
    for window in (20, 7, 2):
        found = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.dedup(documents, window).collect())
        want = sorted((str(d), *x) for (d, _), x in zip(corpus, brute.deduplicated(corpus, window), strict=True))
        assert found == want


def test_ties_and_overlaps(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.dedup(df, 6).collect())
    assert found == sorted((d, *x) for (d, _), x in zip(rows, brute.deduplicated(rows, 6), strict=True))


def test_documents_keep_their_columns(corpus, documents):
    out = S.remove_repeats(documents)
    assert out.columns == documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema]
    found = sorted((str(r.doc_id), r.text, r.n_chars, r.kept) for r in out.collect() if r.text is not None)
    want = []
    for (d, t), (n, gone, kept) in zip(corpus, brute.deduplicated(corpus), strict=True):
        if t is not None and (gone < n or not n):
            text = kept if gone else t
            want.append((str(d), text, len(text), "mine"))
    assert found == sorted(want)
    assert out.where("text IS NULL").count() == sum(t is None for _, t in corpus)


def test_columns_of_any_name_and_type(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.sql(f"SELECT id AS doc_id, '{text}' AS text, named_struct('a b', id) AS `x.y`, 1 AS _c0, 2 AS runs, 3 AS did FROM range(3)")
    out = S.remove_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString() and [r.doc_id for r in out.collect()] == [0]


def test_empty(empty):
    assert S.dedup(empty).count() == 0 and S.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        S.dedup(empty, 1)


def test_a_hot_passage_has_few_entries(spark):
    """Copies of a passage in most of many slices: one entry in each task, not one in each slice."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) + " " + passage + f" {i}") for i in range(400)]

    def opened(met):
        count = 0
        for lo in range(0, 400, 20):
            part = rows[lo : lo + 20]
            batch = pa.RecordBatch.from_pydict({"did": pa.array([d for d, _ in part]), "tag": pa.array([0] * 20, pa.int32()), "text": [t for _, t in part]})
            out = S._dealt(S._runs_of(batch, 20), 1, met or S._Met()).to_pylist()
            count += sum(len(r["a"]) // 4 for r in out if r["kind"] == S.OPEN)
        return count

    each_slice, once = opened(None), opened(S._Met())
    # The passage has some 50 runs of its own; 19 of 20 slices leave them out.
    assert each_slice - once > 19 * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.dedup(df, 20).collect())
    assert found == sorted((d, *x) for (d, _), x in zip(rows, brute.deduplicated(rows, 20), strict=True))


def test_met_places():
    met = S._Met()
    one = lambda did, a, c=7: S._Places(*(np.array([x], t) for x, t in ((5, np.uint64), (c, np.uint64), (did, np.int64), (0, np.int32), (a, np.int32), (1, np.int64))))
    assert not met.repeats(one(3, 2), np.array([False]))[0] and not met.repeats(one(4, 0), np.array([True]))[0]
    assert met.repeats(one(4, 1), np.array([False]))[0] and met.repeats(one(5, 0), np.array([True]))[0]
    assert not met.repeats(one(4, 0), np.array([True]))[0] and not met.repeats(one(2, 9), np.array([False]))[0]
    assert met.repeats(one(3, 0), np.array([False]))[0] and not met.repeats(one(9, 9, 8), np.array([True]))[0]
