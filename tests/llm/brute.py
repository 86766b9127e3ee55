"""Plain Python versions of the corpus operators."""

from __future__ import annotations

import re

VOCABULARY = [a + b for a in ("Ba", "ke", "lo", "mü", "nA") for b in ("r", "st", "t", "né", "x")]


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", ", ", "\n", "\t ", ". "]) for _ in range(n))


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def decontaminated(documents, items, n=10):
    """{row: (n_words, n_hit, sorted item ids)} of [(doc_id, text)] against [(item_id, text)]."""
    windows = {}
    for item, text in items:
        ws = plain(text)
        size = min(n, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + size]), set()).add(item)
    out = []
    for _, text in documents:
        ws, hit, found = plain(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                if (w := tuple(ws[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w]
        out.append((len(ws), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def deduplicated(documents, window=20):
    """[(n_words, n_removed, kept)]: windows that start earlier elsewhere go."""
    key = lambda d: -(1 << 63) if d is None else d
    first = {}
    for d, text in documents:
        ws = spaced(text)
        for i in range(len(ws) - window + 1):
            w, at = tuple(ws[i : i + window]), (key(d), i)
            first[w] = min(first.get(w, at), at)
    out = []
    for d, text in documents:
        ws, gone = spaced(text), set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (key(d), i):
                gone |= set(range(i, i + window))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def shingles(text, k):
    ws = spaced((text or "").translate(ASCII_LOWER))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def near(documents, k, percent=80):
    """[(n_shingles, component_id)]"""
    sets = [shingles(t, k) for _, t in documents]
    up = {d: d for d, _ in documents}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(documents):
        for j, (b, _) in enumerate(documents[:i]):
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(len(s), root(d)) for s, (d, _) in zip(sets, documents, strict=True)]


def top(vectors, queries, k):
    """[(query, rank, id, score)] of {id: integer vector}."""
    out = []
    for q in sorted(queries):
        found = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def best_fit(pieces, capacity):
    """Bins as lists, searched in full: the tightest compatible one, of equals the first opened."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= size and not (source is not None and source in b["sources"]) and not (cluster is not None and cluster in b["clusters"])]
        if not fits:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
            fits = [(capacity, len(bins) - 1)]
        i = min(fits)[1]
        out.append((i, bins[i]["used"]))
        bins[i]["used"] += size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
    return out
