import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import divergence as dv

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, top=10):
    docs = [((t or "").translate(ASCII), lang or "", source or "") for _, t, lang, source, _ in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            for rank, (value, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
                out.add((lang, s, "pair", o, value, rank))
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for rank, (value, t) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                out.add((lang, s, "term", t, value, rank))
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "straße", "ÉTÉ", "été", "x1y", "don't", "日本", "🙂", "a", "aa", "ab", "zz", "�", "rare%d"]
    rows = []
    for d in range(n):
        text = " ".join(rng.choice(words[d % 4 :]).replace("%d", "abcdefgh"[d % 8]) for _ in range(rng.randint(0, 40)))
        rows.append((d, rng.choice([text, text, text, None]), rng.choice(["en", "de", None, "", "xx"][: 4 + (d == 5)]), rng.choice([None, "s1", "s2", "é", "z"]), 1))
    return rows


def as_set(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 2, "pass_bytes": 200, "block_cells": 7}])
def test_equals_brute_force(docs_of, sizes):
    rows = corpus(1)
    assert as_set(dv.audit(docs_of(rows), **sizes)) == brute(rows)


def test_transducer_gives_the_place_of_every_term_and_no_other():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abé日") for _ in range(rng.randint(1, 7))).encode() for _ in range(900)})
    held = dv.Transducer.from_bytes(dv.Transducer.build(terms).to_bytes())
    others = [t + b"a" for t in terms] + [t[:-1] for t in terms]
    every = [*terms, *others, b"zzz"]
    raw = np.frombuffer(b" ".join(every) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in every]) - 1
    starts = ends - [len(t) for t in every]
    place = {t: n for n, t in enumerate(terms)}
    assert held.ordinals(raw, starts, ends).tolist() == [place.get(t, -1) for t in every]


def test_transducer_is_minimal():
    terms = sorted(a + b for a in (b"un", b"re", b"") for b in (b"do", b"doing", b"dos", b"go", b"going", b"gos"))
    held = dv.Transducer.build(terms)
    tails = defaultdict(set)  # what may follow each prefix; equal sets are one state
    for t in terms:
        for i in range(len(t) + 1):
            tails[t[:i]].add(t[i:])
    assert len(held.accepts) == len(set(map(frozenset, tails.values())))


def test_shares_are_exact():
    counts = np.array([2, 3, 10**12, 9 * 10**15 - 2, 7], np.int64)
    total = 9 * 10**15 - 1
    assert dv.share(counts, np.full(5, total)).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_odd_documents(odd_docs):
    docs = odd_docs.selectExpr("*", "1 as ordinal", "2 as term", "'x' as part", "3 as `count`", "4 as block")
    rows = [tuple(r) for r in odd_docs.collect()]
    assert as_set(dv.audit(docs)) == brute(rows)
    assert as_set(dv.audit(docs, least_docs=1)) == brute(rows, least=1)
    assert dv.audit(docs.limit(0)).collect() == []
