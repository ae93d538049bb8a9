import numpy as np
import pytest

from ledgerlens.llm import embedding_dedup as emb
from ledgerlens.llm.support import ready

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64)
        return a / np.linalg.norm(a)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: (n[i], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows))}


def clustered(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = rng.normal(size=16) if i % 3 else centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    return rows + [(n + i, rows[0][1], 0) for i in range(5)]


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_links_equal_brute_force(spark, shard_rows):
    rows = clustered(3)
    df = ready(spark).createDataFrame(rows, SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id) for r in emb.near_duplicates(df, shard_rows=shard_rows).collect()}
    wanted = brute_force(rows)
    assert found.keys() == wanted.keys()
    assert np.mean([found[i] == wanted[i] for i in wanted]) >= 0.99
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in wanted.values())


def test_recall_of_the_graph_against_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x[500:1000] = x[0] + rng.normal(size=(500, 24)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = emb.SmallWorld(x)
    hit = total = 0
    for i in range(0, 1500, 10):
        true = set(np.flatnonzero(x @ x[i] >= 0.98).tolist())
        hit += len(true & set(graph.within(x[i], 0.98, emb.BEAM)))
        total += len(true)
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1),
        (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, v, 2),
        (11, v + [0.0], 1), (None, v, 1), (12, v, 1), (12, v, 1),
    ]
    df = ready(spark).createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as shard", "3 as copies", "4 as class")
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in emb.near_duplicates(df).collect())
    linked = {"1": (4, 1, True), "2": (4, 1, False), "None": (4, 1, False), "12": (4, 1, False)}
    wanted = [(str(i), *linked.get(str(i), (0, i, True))) for i, _, _ in rows]
    assert found == sorted(wanted)
    empty = spark.createDataFrame([], SCHEMA)
    assert emb.near_duplicates(empty).count() == 0


class Lossy:
    """A shard that loses what `lost` names unless it is searched in full."""

    def __init__(self, vectors, lost):
        self.vectors, self.lost = vectors, lost

    def within(self, q, least, width):
        found = np.flatnonzero(self.vectors @ q >= least).tolist()
        at = int(np.argmax(self.vectors @ q))
        return found if width >= len(self.vectors) else [n for n in found if (at, n) not in self.lost]


def lossy(pairs, size=130, dense=100):
    x = np.eye(size)
    x[1:dense] = x[0] + np.eye(size)[1:dense] * 0.01  # a dense group, then pairs
    x[dense + 1 :: 2] = x[dense:-1:2] + x[0] * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return Lossy(x, pairs), x


def wanted_links(x):
    sims = x @ x.T >= 0.98
    np.fill_diagonal(sims, False)
    return {i: int(n) for i, n in enumerate(sims.sum(axis=1)) if n}


def test_audit_sees_sparse_pairs_and_cells_without_audit_queries():
    sparse = {(a, b) for i in range(100, 130, 2) for a, b in ((i, i + 1), (i + 1, i))}
    graph, x = lossy(sparse)
    ids, ones = np.arange(130), np.ones(130, np.int64)
    for nodes in (ids, ids * 50 + 1):  # the latter has no audit query
        counts, _ = emb.search_pair((graph, nodes, ones), None, 0.98, 24, 50, 0.995)
        assert {int(np.searchsorted(nodes, a)): n for a, n in counts} == wanted_links(x)


def test_links_found_from_one_side_count_for_both():
    graph, x = lossy({(i + 1, i) for i in range(102, 130, 2)})
    ids, ones = np.arange(130), np.ones(130, np.int64)
    counts, edges = emb.search_pair((graph, ids, ones), None, 0.98, 24, 1000, 0.995)
    assert dict(counts) == wanted_links(x) and len(edges) == 99 + 15
    a, b = Lossy(x[::2], {(i, i) for i in range(51, 65)}), Lossy(x[1::2], set())
    a.within, full = (lambda q, least, width: []), wanted_links(x)  # nothing is found from that side
    counts, _ = emb.search_pair((a, ids[::2], ones[::2]), (b, ids[1::2], ones[1::2]), 0.98, 24, 1000, 0.995)
    assert all(dict(counts)[i] == (1 if i >= 100 else 50) for i in full)
