"""The pipeline against its stages in plain Python, each on what the one before it kept."""

import brute

import corpus_pipeline
from pathloom.llm import decontaminate, near, packing, substrings, toxicity
from pathloom.llm.queries import ORACLES, QUERIES

WITH_COPIES = [5, 6, 7, 300]


def test_registry():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert entry.queries()["pipeline"] is not None and set(QUERIES) < set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_stages(spark, corpus, tmp_path):
    d = str(tmp_path)
    rows = [(i, t, "en", f"s{(i or 0) % 4}", len(t) if t is not None else None) for i, t in corpus]
    rows += [(600 + i, f"{t} vile vile nasty {i}", "en", "s1", 5) for i, t in corpus[:40] if i is not None and t]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    toxic = [(i, int("vile" in (t or "")), 0) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(toxic, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    long = next(t for i, t in sorted(corpus, key=str) if t and i in range(40) and len(brute.plain(t)) > 60)
    items = [(1, " ".join(brute.plain(long)[20:45])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == names
        out.write.parquet(f"{d}/stage{n}")
        docs = spark.read.parquet(f"{d}/stage{n}")
        if name == "packing":
            assert sum(r.n_words for r in docs.collect()) == sum(len(brute.spaced(t)) for _, t in before)
            continue
        after = sorted(str(tuple(r)) for r in docs.select("doc_id", "text").collect())
        if name == "toxicity":
            assert not any("vile" in x for x in after) and len(after) >= len(corpus) - 2
        if name == "near_dedup":
            assert after == sorted(str(x) for x, (_, c) in zip(before, brute.near(before, 5), strict=True) if x[0] == c)
        if name == "substring_dedup":
            cut = zip(before, brute.deduplicated(before), strict=True)
            assert after == sorted(str((i, kept if gone else t)) for (i, t), (n_words, gone, kept) in cut if not gone or gone < n_words)
        if name == "decontamination":
            assert after == sorted(str(x) for x, (_, hit, _) in zip(before, brute.decontaminated(before, items), strict=True) if not hit)
            assert len(after) < len(before)
    whole = sorted(tuple(map(str, r)) for r in corpus_pipeline.run(spark, d).collect())
    assert whole == sorted(tuple(map(str, r)) for r in docs.collect())


def test_modules_are_used():
    assert all(m.__name__.startswith("pathloom.llm") for m in (decontaminate, near, packing, substrings, toxicity))
