import struct
from collections import Counter

import pytest
import xxhash

from pathloom.llm import sharding as S


def test_table_by_turns():
    names = ["a", "b", "c"]
    held = S.lookup_table(names, 13)
    free = dict.fromkeys(range(13))
    orders = []
    for n in names:
        begin, step = S._hash(n, b"begin") % 13, S._hash(n, b"step") % 12 + 1
        orders.append([(begin + j * step) % 13 for j in range(13)])
        assert sorted(orders[-1]) == list(range(13))
    want, turn = {}, 0
    while free:
        slot = next(s for s in orders[turn % 3] if s in free)
        want[slot] = turn % 3
        del free[slot]
        turn += 1
    assert held == [want[i] for i in range(13)]


def test_balance_and_few_moves():
    names = [f"s{i}" for i in range(10)]
    held = S.lookup_table(names, 10007)
    count = Counter(held)
    assert max(count.values()) - min(count.values()) <= 1
    less = S.lookup_table(names[:-1], 10007)
    moved = sum(a != b for a, b in zip(held, less, strict=True) if a != 9)
    assert moved < 0.1 * 10007


def test_placement(spark, documents, corpus):
    out = S.with_shard(documents, "doc_id", ["a", "b", "c"], 101).collect()
    held = S.lookup_table(["a", "b", "c"], 101)
    for r in out:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed=42) if r.doc_id is not None else 42
        h -= (h >> 63) << 64
        assert r.slot == h % 101 and r.shard == "abc"[held[r.slot]]
    assert len(out) == len(corpus)


def test_files(spark, documents, tmp_path):
    S.write_shards(documents, "doc_id", str(tmp_path / "x"), ["a", "b"], 2)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == documents.count() and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b"}


def test_wrong(documents, empty):
    assert S.with_shard(empty, "doc_id").count() == 0
    for names, slots in (([], 13), (["a", "a"], 13), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            S.lookup_table(names, slots)
    named = S.with_shard(documents.withColumnRenamed("lang", "Slot").withColumnRenamed("source", "place"), "doc_id")
    assert named.columns[-2:] == ["_slot", "shard"] and named.count() == documents.count()
    with pytest.raises(ValueError):
        S.with_shard(documents, "doc_id", slots=S.MOST_SLOTS + 7)


def test_a_frequent_key_has_all_files_of_its_shard(spark, tmp_path):
    df = spark.range(4000).selectExpr("IF(id % 3 = 0, NULL, 7) AS k", "id AS shard", "id AS slot").repartition(16)
    S.write_shards(df, "k", str(tmp_path / "out"), files=4)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 4000 and found.where("k = 7").select("_metadata.file_path").distinct().count() >= 3
    assert found.groupBy("k").agg({"_shard": "count"}).count() == 2 and found.select("_shard").distinct().count() <= 2
