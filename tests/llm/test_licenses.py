import itertools
import random

import pytest
from brute import prose
from hypothesis import given
from hypothesis import strategies as st

from pathloom.llm import licenses as L


@given(st.lists(st.sampled_from("abcdefgh")), st.lists(st.sampled_from("abcdefgh")))
def test_alignment_is_one(a, b):
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < p and y < q for (x, y), (p, q) in zip(pairs, pairs[1:], strict=False))


@given(st.permutations(range(9)))
def test_longest_run(order):
    pairs = list(enumerate(order))
    found = L._increasing(pairs)
    best = [1] * 9
    for i in range(9):
        best[i] = 1 + max((best[j] for j in range(i) if order[j] < order[i]), default=0)
    assert len(found) == max(best) and all(p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_equal_texts_align_in_full():
    for _, text in L.TEMPLATES:
        ws = L.words_of(text)
        assert L.align(ws, ws) == [(i, i) for i in range(len(ws))]


@pytest.mark.parametrize("name", [n for n, _ in L.TEMPLATES])
def test_planted(name):
    rng = random.Random(name)
    text = dict(L.TEMPLATES)[name]
    known = [L.Template(*t) for t in L.TEMPLATES]
    before = prose(rng, 300)
    found = L.scan(f"{before}\n{text.upper()}\n{prose(rng, 300)}", known)
    n = len(L.words_of(before))
    assert found == (name, 1.0, len(L.words_of(text)), n, n + len(L.words_of(text)))
    twice = L.scan(f"{text}\n{text}", known)
    assert twice[:2] == (name, 1.0)
    words = text.split()
    if len(words) > 20:
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = "other"
        changed = L.scan(" ".join(words), known)
        assert changed[0] == name and changed[1] >= L.LICENSED


def test_table(spark, corpus, documents):
    out = L.license_scan(documents).collect()
    assert len(out) == len(corpus) and all(r.license is None and r.coverage == 0 for r in out)
    rows = [(1, "Released under the MIT License."), (2, None), (3, "license"), (1, "x " * 9000 + "Licensed under CC BY-NC 4.0."), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.license), r.coverage >= L.LICENSED) for r in L.license_scan(df).collect())
    assert found[:2] == [("1", "CC-BY-NC-4.0", True), ("1", "MIT", True)] and not any(x[2] for x in found[2:])
    assert L.license_scan(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        L.license_scan(df, [])


KNOWN = [L.Template(*t) for t in L.TEMPLATES]


@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd")))
def test_common_is_longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    pairs = L.common(a, b)
    assert len(pairs) == size[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(x < p and y < q for (x, y), (p, q) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("t", KNOWN, ids=lambda t: t.name)
def test_a_fifth_may_be_other_words(t):
    """Each set of replaced words that leaves enough, seeds too; of long templates seeds first, and many at random."""
    n, rng = len(t.words), random.Random(t.name)
    most = n - t.need
    if n < L.LONG:
        gone = [x for k in range(most + 1) for x in itertools.combinations(range(n), k)]
    else:
        by_seed = sorted(range(n), key=lambda j: (t.words[j] not in t.seeds, j))
        gone = [by_seed[:most], by_seed[-most:], *(rng.sample(range(n), most) for _ in range(100))]
    for x in gone:
        text = " ".join(["word"] * 30 + ["word" if j in x else w for j, w in enumerate(t.words)] + ["word"] * 30)
        found = L.scan(text, [t])
        assert found[0] == t.name and found[2] == n - len(x), x


@pytest.mark.parametrize("t", KNOWN, ids=lambda t: t.name)
def test_insertions(t):
    n = len(t.words)
    for at in range(2, n - 1):
        text = " ".join(["x"] * 9 + t.words[:at] + ["page"] * 60 + t.words[at:] + ["x"] * 9)
        found = L.scan(text, [t])
        assert found[1] >= L.LICENSED and 9 <= found[3] < found[4] <= 9 + n + 60, at
        if n < L.LONG and max(at, n - at) < t.need:
            assert found[1:] == (1.0, n, 9, 9 + n + 60), at
    if n >= L.LONG:
        thrice = " ".join(w + " page" * 40 * (j in (n // 4, n // 2, 3 * n // 4)) for j, w in enumerate(t.words))
        assert L.scan(f"{thrice} {'x ' * 500} {t.words[0]}", [t]) == (t.name, 1.0, n, 0, n + 120)
    far = " ".join(f"{w} {'x ' * 40}" for w in t.words)
    assert L.scan(far, [t])[1] < L.LICENSED


@pytest.mark.parametrize("verb", ["Published", "Available", "Released"])
def test_other_verbs(verb):
    assert L.scan(f"{verb} under CC BY-NC 4.0", KNOWN)[:3] == ("CC-BY-NC-4.0", 6 / 7, 6)


def test_all_notices(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    apache = dict(L.TEMPLATES)["Apache-2.0-notice"]
    parted = apache.replace(" Unless", f" {'page ' * 90}Unless")
    rows = [(1, f"{mit} x y {cc} z {mit}"), (2, f"{apache} {cc}"), (3, f"{mit * 3}"), (4, f"{apache} x {parted} x {apache}"), (5, "none"), (6, None)]
    out = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {d: [(x.license, x.first_word, x.last_word) for x in r.notices] for d, r in out.items()}
    n = len(L.words_of(apache))
    assert spans[1] == [("MIT", 0, 5), ("CC-BY-NC-4.0", 7, 14), ("MIT", 15, 20)]
    assert spans[2] == [("Apache-2.0-notice", 0, n), ("Apache-2.0", 0, 8), ("CC-BY-NC-4.0", n, n + 7)]
    assert spans[3] == [("MIT", 0, 5), ("MIT", 5, 10), ("MIT", 10, 15)]
    assert [x for x in spans[4] if x[0] == "Apache-2.0-notice"] == [("Apache-2.0-notice", a, b) for a, b in ((0, n), (n + 1, 2 * n + 91), (2 * n + 92, 3 * n + 92))]
    assert spans[5] == spans[6] == []
    for r in out.values():
        assert not r.notices or tuple(r)[1:6] in [tuple(x) for x in r.notices]
