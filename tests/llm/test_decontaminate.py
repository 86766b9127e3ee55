import random

import brute
from brute import prose

from pathloom.llm import decontaminate as D


def items(corpus):
    rng = random.Random(9)
    long = [t for _, t in corpus if t and 60 < len(t.split()) < 160]
    found = [(i, " ".join(long[i].split()[10:40])) for i in range(8)]
    return [*found, (8, " ".join(long[1].split()[15:30])), (9, long[2].split()[3]), (10, "Ba" + "r"), (11, None), (12, ""), (13, "!!"), (None, " ".join(long[9].split()[5:25])), (3, found[3][1]), (14, prose(rng, 80))]


def test_against_brute_force(spark, corpus, documents):
    known = items(corpus)
    benchmark = spark.createDataFrame(known, "item_id long, text string")
    found = D.report(documents, benchmark).collect()
    want = brute.decontaminated(corpus, known)
    have = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found)
    assert have == sorted((str(d), n, h, tuple(i), h > 0) for (d, _), (n, h, i) in zip(corpus, want, strict=True))
    blocks = D.hits(documents, benchmark, block=7)
    assert blocks.count() == D.hits(documents, benchmark).count()


def test_removal(spark, corpus, documents):
    known = [(i, t) for i, t in items(corpus) if t and len(t.split()) > 11]
    benchmark = spark.createDataFrame(known, "item_id long, text string")
    want = brute.decontaminated(corpus, known)
    kept = D.remove_documents(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (x for x, (_, h, _) in zip(corpus, want, strict=True) if not h)))
    cut = D.remove_spans(documents, benchmark).collect()
    assert len(cut) == len(corpus)
    left = sorted(len(brute.plain(r.text)) for r in cut)
    assert left == sorted(n - h for n, h, _ in want)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "z a b c d y a b c d a b z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d"), (2, "d a")], "item_id long, text string")
    (row,) = D.hits(docs, bench, n=3).collect()
    assert [tuple(s) for s in row.spans] == [(1, 5), (6, 11)] and row.n_hit == 9


def test_empty_tables(spark, empty, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(empty, none).count() == 0
    assert D.report(documents, none).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    assert D.remove_documents(documents, none).count() == documents.count()


def test_no_python(spark, documents):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    plan = D.report(documents, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_very_long_text_with_many_hits(spark):
    """Hits apart, hits that touch and hits in each other; 120,000 words."""
    text = "a b c x " * 20_000 + "a b c a b c y d a b c e z " * 3_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "d a b c e"), (3, "b")], "item_id long, text string")
    (row,) = D.report(docs, bench, n=5).collect()
    assert (row.n_hit, row["items"]) == (60_000 + 3_000 * 11, ["1", "2", "3"])
    (row,) = D.remove_spans(docs, bench, n=5).collect()
    assert row.text.split() == ["x"] * 20_000 + ["y", "z"] * 3_000


def test_columns_of_any_name(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('a b c ', id) AS text, 1 AS _id, 2 AS _hit, 3 AS spans, named_struct('a b', 4) AS `x.y` FROM range(2)")
    bench = spark.createDataFrame([(1, "b c 1")], "item_id long, text string")
    out = D.remove_documents(docs, bench)
    assert out.schema.simpleString() == docs.schema.simpleString() and [r.doc_id for r in out.collect()] == [0]
    assert sorted(r.text for r in D.remove_spans(docs, bench).collect()) == ["a", "a b c 0"]
