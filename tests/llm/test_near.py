import random

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import near as N
from pathloom.llm.graph import components


def test_against_brute_force(corpus, documents):
    for k in (4, 5):
        found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.near_components(documents, k).collect())
        want = sorted((str(d), n, str(c), d == c) for (d, _), (n, c) in zip(corpus, brute.near(corpus, k), strict=True))
        assert found == want


def test_one_of_each_group_stays(corpus, documents):
    out = N.keep_one(documents)
    assert out.columns == documents.columns
    want = [x for x, (_, c) in zip(corpus, brute.near(corpus, 5), strict=True) if x[0] == c]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))


def test_groups_larger_than_a_block(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in N.near_components(df, 4).collect()}
    assert found == {d: c for (d, _), (_, c) in zip(rows, brute.near(rows, 4), strict=True)}
    assert len(set(found.values())) > 1


def test_empty(empty, spark):
    assert N.near_components(empty).count() == 0 and N.keep_one(empty).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    sets = np.concatenate([np.sort(x[:2000]), np.sort(x[500:2500])])
    m = N.minima(sets, np.array([0, 2000, 4000]), N.MINIMA)
    assert abs((m[:, 0] == m[:, 1]).mean() - 1500 / 2500) < 0.12


def test_shingles():
    texts = ["A b c d", "a B c d", "a b", "a  b", None, "", "a b c d a b c d"]
    g, bounds = N.shingles(pa.array(texts), 4)
    sets = [tuple(g[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[4] == sets[5] == () and len(sets[6]) == 4


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (1, None), (2000, 2001), (2000, 2001)] + [(3000, 3001 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    nodes = {x for e in edges for x in e if None not in e}
    assert found == {x: root(x) for x in nodes if root(x) != x}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1), min_size=2, max_size=12))
def test_links_in_one_place(sets):
    arrays = [np.sort(np.array([x * 0x9E3779B97F4A7C15 % (1 << 64) for x in s], np.uint64)) for s in sets]
    found = N.linked(list(range(len(sets))), [0] * len(sets), arrays, False, 80)
    for a, b in found:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert len(found) < len(sets)


def test_chains_and_groups_in_many_blocks(spark, monkeypatch):
    """Chains of near copies whose ends are far apart, one large group, and blocks of a few members."""
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 400)
    rng = random.Random(4)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(80)]
    for i in range(60):
        rows.append((i, " ".join(base)))
        base = base.copy()
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_components(df, 4).collect())
    assert found == sorted((d, n, c) for (d, _), (n, c) in zip(rows, brute.near(rows, 4), strict=True))
