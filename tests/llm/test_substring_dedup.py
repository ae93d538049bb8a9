import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import substring_dedup as sd


def brute(rows, window=50):
    """{(doc_id, text): (n_words, n_removed, kept_sha256)}"""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    order = [(d if d is not None else 2**63 - 1, w) for d, w in split]
    for d, w in order:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for (doc_id, text), (d, w) in zip(rows, order):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id, text] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df, rows):
    """The result's rows as brute force names them; texts are told apart by what they give."""
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def wanted(rows, window=50):
    by = brute(rows, window)
    return sorted((d is None, d or 0, *by[d, t]) for d, t in rows)


def corpus(seed, n=60):
    """Texts of few words, with quoted passages, copies and near copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ab", "été", "x", "Yes", "no", "7"])
    passages = [[word() for _ in range(rng.randint(45, 140))] for _ in range(4)]
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            own = rng.choice(rows)[1].split()
            own[rng.randrange(len(own) + 1) : rng.randrange(len(own) + 1)] = [word()]
            text = " ".join(own)
        else:
            own = [word() + str(rng.randrange(50)) for _ in range(rng.randint(0, 90))]
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
            text = rng.choice([" ", "\n", " \t "]).join(own)
        rows.append((rng.choice([d, rng.randrange(n), None]) if rng.random() < 0.2 else d, text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"group": 2, "block": 3}, {"group": 1}])
def test_equals_brute_force(docs_of, sizes):
    rows = corpus(1) + corpus(2)
    assert found(sd.dedup(docs_of(rows), **sizes), rows) == wanted(rows)


@pytest.mark.parametrize("group", [5, 8_000])
def test_a_passage_quoted_by_a_third_of_all_texts(docs_of, group):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (d, " ".join([f"l{rng.randrange(10**6)}" for _ in range(30)] + [passage] * (d % 3 == 0) + [f"r{rng.randrange(10**6)}"]))
        for d in range(120)
    ]
    got = {r.doc_id: r.n_removed for r in sd.dedup(docs_of(rows), group=group).collect()}
    assert got == {d: 60 if d % 3 == 0 and d else 0 for d in range(120)}


def test_longest_factors_are_those_of_smaller_documents():
    rng = random.Random(5)
    passages = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 25))] for _ in range(30)]
    ids = [rng.randrange(10) for _ in passages]
    block = sd.ReferenceBlock(passages, ids)
    for n, own in enumerate(passages):
        smaller = [b" ".join(p) + b" " for p, i in zip(passages, ids) if i < ids[n]]
        at = 0
        for start, end in block.factors(n):
            assert start == at
            at = end
            run = lambda a, b: any((b" " + b" ".join(own[a:b]) + b" ") in b" " + p for p in smaller)
            assert end == start + 1 or run(start, end)
            assert end == len(own) or not run(start, end + 1)
        assert at == len(own)


def test_suffix_array():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 200)
    order = sd.suffix_array(text, 200)
    tails = [text[i:].tolist() for i in order]
    assert tails == sorted(tails)


def test_odd_documents(odd_docs, spark):
    docs = odd_docs.selectExpr("*", "1 as id", "2 as key", "'x' as anchors", "3 as start", "4 as n_words", "5 as spans")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sd.dedup(docs)
    assert found(got, rows) == wanted(rows)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sd.dedup(docs.limit(0)).collect() == []
