import random

import pytest
from brute import VOCABULARY, prose


@pytest.fixture(scope="session")
def corpus():
    """[(doc_id, text)]: prose, copies, near copies, shared passages, repeated lines, and what is odd."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 200)
    out = [(i, prose(rng, rng.randint(1, 150))) for i in range(40)]
    out += [(100 + i, out[i][1]) for i in range(6)]
    for i in range(30):
        words = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append((200 + i, " ".join(words)))
    out += [(300 + i, prose(rng, rng.randint(0, 30)) + passage + prose(rng, rng.randint(0, 30))) for i in range(12)]
    out += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "one"), (405, "a b c"), (406, "A B C"), (None, out[3][1]), (None, out[3][1]), (None, None)]
    out += [(407, "same " * 300), (408, prose(rng, 5000)), (409, "x" * 100_000), (410, " é   ü\u0000z")]
    out += [(7, out[7][1]), (8, out[9][1]), (8, prose(rng, 60))]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table, with columns whose names operators use too."""
    rows = [(d, t, "en", f"src{(d or 0) % 5}" if (d or 0) % 11 else None, len(t) if t is not None else None, "mine", 3) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int").repartition(5)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
