import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathloom.llm import token_counts as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


def slowly(text, rule):
    """Every byte of every token, by line."""
    encoding, length = T.encoder(T.VOCABULARY)
    data = text.encode()
    line, n = [], 0
    for b in data:
        line.append(n)
        n += b == 0x0A
    lines = (line[-1] if line else 0) + 1
    out, at = [0] * lines, 0
    for t in encoding.encode_ordinary(text):
        held = line[at : at + length[t]]
        at += length[t]
        place = {"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]
        out[place] += 1
    assert at == len(data)
    return out


TEXTS = ["", "\n", "a", "one\n\n\ntwo  \n", "x\n\n   \n\ty", "é\nü😀\n", "a" * 5000 + "\n" + "b\n" * 50, " \n \n \n"]


@pytest.mark.parametrize("rule", T.RULES)
def test_lines(spark, rule):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string").repartition(2)
    found = {}
    for r in sorted(T.section_tokens(df, rule).collect()):
        assert r.section == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append((r.n_chars, r.n_tokens))
    assert {i: [n for _, n in x] for i, x in found.items()} == {i: slowly(t, rule) for i, t in enumerate(TEXTS)}
    assert {i: sum(c for c, _ in x) for i, x in found.items()} == {i: len(t) for i, t in enumerate(TEXTS)}


def test_whole_corpus_adds_up(corpus, documents):
    encoding, _ = T.encoder(T.VOCABULARY)
    total = sum(r.n_tokens for r in T.section_tokens(documents).collect())
    assert total == sum(len(encoding.encode_ordinary(t)) for _, t in corpus if t)


def test_fields(spark):
    df = spark.createDataFrame([(1, "a title", "some text\nmore", None), (2, None, "", "x")], "id long, title string, body string, note string")
    found = {(r.id, r.field): r.n_tokens for r in T.field_tokens(df, "id", ["title", "body", "note"]).collect()}
    encoding, _ = T.encoder(T.VOCABULARY)
    assert len(found) == 6 and found[1, "note"] == 0
    assert sum(n for (i, _), n in found.items() if i == 1) == len(encoding.encode_ordinary("a title\nsome text\nmore\n"))


@given(st.lists(st.integers(1, 6), max_size=30), st.sets(st.integers(1, 60)), st.sampled_from(T.RULES))
def test_allocation_adds_up(length, cuts, rule):
    total = sum(length)
    starts = np.array([0, *sorted(c for c in cuts if c < total)])
    assert T.allocate(np.array(length, np.int64), starts, total, rule).sum() == len(length)


def test_empty(empty):
    assert T.section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        T.section_tokens(empty, "middle")


def test_keys_of_any_name_and_type(spark):
    df = spark.sql("SELECT named_struct('a b', 1) AS field, 'one two' AS x, 'three' AS y")
    out = T.field_tokens(df, "field", ["x", "y"])
    assert out.columns == ["field", "_field", "n_tokens"] and sorted(r["_field"] for r in out.collect()) == ["x", "y"]
