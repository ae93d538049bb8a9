import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from ledgerlens.llm import simhash
from ledgerlens.llm.support import components, ready


def plain_fingerprint(text, words=4):
    """The contract read word by word, bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    tokens = [w for w in lower.split(" ") if w]
    if not tokens:
        return 0
    cut = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_labels(prints, bits=4):
    label = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b C", "Ünï ÀB c d e f", "a\x0bb\x0cc d\te", "x " * 999])
def test_fingerprint_is_the_plain_reading(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_prints(seed, centres=3, copies=60, alone=120):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(alone)}
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(copies):
            p = base
            for _ in range(rng.randint(0, 7)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)


def as_sets(labels, members):
    groups = {}
    for label, m in zip(labels, members):
        groups.setdefault(label, set()).add(m)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(4))
def test_group_index_loses_no_link(seed):
    prints = near_prints(seed)

    def rank(x):
        for by in (1, 2, 4, 8, 16, 32):
            x ^= x >> by
        return x

    ordered = sorted(prints, key=rank)
    labels = simhash.group_forest(np.array(ordered, np.uint64), 4)
    assert as_sets(labels.tolist(), ordered) == as_sets(plain_labels(prints), prints)


@pytest.mark.parametrize("group_rows", [4096, 9])
def test_links_by_blocks_equal_brute_force(spark, group_rows):
    prints = near_prints(11)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = ready(spark).createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(df, 4, group_rows)).collect()}
    assert as_sets([roots.get(p, p) for p in signed], signed) == as_sets(plain_labels(prints), signed)


def test_components_of_odd_documents(docs_of, odd_docs):
    found = simhash.simhash_components(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {by_id[i][0].component_id for i in (1, 2, 3)} == {1}
    assert by_id[2][0].fingerprint == "0" * 16
    assert [r.component_id for r in by_id[4]] == [4, 4]
    assert by_id[None][0].component_id is None


def test_keep_one_keeps_one_of_each_component(docs_of):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = docs_of([(9, text), (3, text), (3, text), (None, text), (None, "lonely words that nobody shares"), (5, "other words altogether in here"), (5, "and a second text of that id")])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert [k for k in kept if k[0] == 3] == [(3, text)]
    assert len([k for k in kept if k[0] is None]) == 1 and len([k for k in kept if k[0] == 5]) == 1
    assert not [k for k in kept if k[0] == 9]


def test_empty_table(docs_of):
    assert simhash.simhash_components(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([])).count() == 0


def test_extra_columns_with_clashing_names(docs_of):
    docs = docs_of([(1, "a b c d e"), (2, "a b c d e")]).selectExpr("*", "1 as fp", "2 as version", "3 as component_id", "4 as k")
    assert {r.component_id for r in simhash.simhash_components(docs).collect()} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_repeated_rows_with_any_column_names(spark):
    from ledgerlens.llm.support import ready

    rows = [(1, "a b c d e", "z", {"k": 1}), (1, "a b c d e", "y", {"k": 2}), (1, "a b c d e", None, {"k": 3}), (2, "other words stand in here", "x", None)]
    docs = ready(spark).createDataFrame(rows * 3, "doc_id long, text string, _version string, row map<string, int>").repartition(4)
    docs = docs.selectExpr("*", "1 as v", "2 as least", "3 as `count`", "4 as `d`", "5 as `a.b`", "6 as p")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # Of rows of one text the one whose columns come first as JSON, where a missing one is left out.
    assert sorted((r.doc_id, r._version) for r in kept.collect()) == [(1, "y"), (2, "x")]


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 150) for i in range(40)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and found[239] == 150
