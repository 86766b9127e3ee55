import random

import brute
import pytest

from pathloom.llm import packing as P


def test_best_fit_is_the_tightest():
    rng = random.Random(4)
    for _ in range(30):
        pieces = sorted(((rng.randint(0, 50), rng.choice([None, "a", "b", "c", "d", "e", "f"]), rng.choice([None, 1, 2, 3, 4])) for _ in range(120)), key=lambda p: -p[0])
        assert P.best_fit(pieces, 60) == brute.best_fit(pieces, 60)


def test_all_is_packed(corpus, documents):
    capacity = 100
    out = P.pack(documents, capacity, group=40).collect()
    words = sum(len(brute.spaced(t)) for _, t in corpus)
    assert sum(r.n_words for r in out) == words
    assert len(out) == sum(max(1, -(-len(brute.spaced(t)) // capacity)) for _, t in corpus)
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    source = {d: f"src{(d or 0) % 5}" if (d or 0) % 11 else None for d, _ in corpus}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: (r.start, r.n_words)):
            assert r.start == at
            at += r.n_words
        assert at <= capacity
        known = [source[r.doc_id] for r in held if source[r.doc_id] is not None]
        assert len(known) == len(set(known))


def test_copies_and_groups(spark):
    rows = [(i, "same words here" if i % 3 else f"w{i} " * (i % 40), f"s{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = P.pack(df, 50, group=64).collect()
    held = {}
    for r in out:
        if r.doc_id % 3:
            assert r.bin_id not in held
            held[r.bin_id] = r
    assert {(r.doc_id, r.bin_id, r.start) for r in P.pack(df.repartition(7), 50, group=64).collect()} == {(r.doc_id, r.bin_id, r.start) for r in out}


def test_empty(empty):
    assert P.pack(empty).count() == 0
    with pytest.raises(ValueError):
        P.pack(empty, 0)


def test_near_copies_are_kept_apart(spark, tmp_path):
    """In the registered query, also from those without an id."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        near = list(words)
        near[rng.randrange(200)] = f"other{i}"
        rows.append((i if i < 25 else None, " ".join(near), f"s{i}"))
    rows += [(100 + i, f"text {i} " * 20, f"t{i}") for i in range(30)] + [(None, " ".join(words), "u"), (200, " ".join(words), "v")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.op5_best_fit_packing(spark, f"file://{tmp_path}").collect()
    assert len(out) == len(rows)
    # The copies are the pieces of 200 words.
    bins = [r.bin_id for r in out if r.n_words == 200]
    assert len(bins) == 32 == len(set(bins))


def test_registered_query_counts_words_where_it_splits_them(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    data = [(1, text, "a"), (2, text + " end", "b"), (3, None, "a"), (None, "no\u00a0id\there", None), (5, "", "b"), (6, " \x0b a  b\n", "c"), (6, "a", "c"), (8, None, None)]
    documents = spark.createDataFrame(data, "doc_id long, text string, source string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    _, links = P.near.near_links(P.known_ids(documents))
    want = sorted(map(str, P.pack(documents, clusters=P.components(links)).collect()))
    monkeypatch.setattr(P, "n_words", None)
    assert sorted(map(str, P.op5_best_fit_packing(spark, str(tmp_path)).collect())) == want
