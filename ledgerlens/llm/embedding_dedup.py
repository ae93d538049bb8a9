"""Embedding near-duplicates: links at a cosine threshold, found with small-world graphs per shard.

Vectors are compared within one label (and one length). Equal vectors meet as one class first. A hash deals
the classes of a label to shards of about `shard_rows`; each shard becomes a hierarchical navigable small
world: every vector gets a random top layer, and on each layer links to near but mutually distant
neighbours. Every vector queries every shard of its label: greedy descent through the upper layers, then a
beam on the lowest. While everything in a beam is within the threshold, the beam is widened, so a large
group of near copies is found whole. Each task audits itself: the stated audit queries (every
`audit_every`-th vector) are compared with brute force over the shard, and the beam is doubled for all its
queries until each of them, itself left out, reaches the recall `audit_recall`; a beam as wide as the shard is
brute force, and is taken where there is no audit query. Candidates are verified by their cosine in double
precision, a link that one of its ends finds counts for both, and links join into components.

Scale. A task holds two shards, or one that meets itself, and a table of bits for their links, all bounded.
Links are counted where they are found; what leaves a task is a count per query and a spanning forest, not all pairs of a dense group.

Edge cases. A vector that is null, empty, zero, or holds a null or non-finite component links with nothing,
as does one without a label: n_links 0, its own component. Repeated rows are vectors of their own and link
with each other. A row without vec_id links like any other, but a component is named by its smallest
non-null vec_id, and the row is not kept. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import heapq
import math
import pickle
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.support import components, settle

THRESHOLD = 0.98
SHARD_ROWS = 8_192
LINKS = 12
BUILD_BEAM = 40
BEAM = 24
AUDIT_EVERY = 50
AUDIT_RECALL = 0.995
_SLACK = 1e-9  # candidates are taken with this slack and then verified


class SmallWorld:
    """A hierarchical navigable small world over unit vectors, by inner product."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build_beam: int = BUILD_BEAM, seed: int = 1):
        self.vectors, self.links, self.build_beam = vectors, links, build_beam
        rng, scale = random.Random(seed), 1 / math.log(links)
        self.top = [int(-math.log(1 - rng.random()) * scale) for _ in range(len(vectors))]
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        for node in range(len(vectors)):
            self._add(node)

    def _add(self, node: int) -> None:
        top, q = self.top[node], self.vectors[node]
        start = [(1.0, self.entry)] if self.entry >= 0 else []
        highest = len(self.layers) - 1
        if start:
            start = [(float(self.vectors[self.entry] @ q), self.entry)]
            for layer in range(highest, top, -1):
                start = self._beam(q, start, 1, layer)[:1]
        for layer in range(min(top, highest), -1, -1):
            start = self._beam(q, start, self.build_beam, layer)
            chosen = self._spread(start, self.links)
            self.layers[layer][node] = chosen
            most = self.links * 2 if layer == 0 else self.links
            for other in chosen:
                near = self.layers[layer][other]
                near.append(node)
                if len(near) > most:
                    sims = (self.vectors[near] @ self.vectors[other]).tolist()
                    ranked = sorted(zip(sims, near), reverse=True)
                    self.layers[layer][other] = self._spread(ranked, most)
        if top > highest:
            for _ in range(highest, top):
                self.layers.append({node: []})
            self.entry = node

    def _spread(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to those already chosen, then the nearest of the others."""
        if len(ranked) <= 1:
            return [n for _, n in ranked]
        own = self.vectors[[n for _, n in ranked]]
        between = (own @ own.T).tolist()
        chosen, others = [], []
        for at, (sim, _) in enumerate(ranked):
            if len(chosen) == most:
                break
            row = between[at]
            (chosen if all(row[c] <= sim for c in chosen) else others).append(at)
        chosen += others[: max(0, most // 2 - len(chosen))]
        return [ranked[c][1] for c in chosen]

    def _beam(self, q, start, width: int, layer: int) -> list[tuple[float, int]]:
        """The `width` best nodes a best-first search meets, best first."""
        links, vectors = self.layers[layer], self.vectors
        seen = {n for _, n in start}
        todo = [(-s, n) for s, n in start]
        heapq.heapify(todo)
        best = list(start)
        heapq.heapify(best)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = [n for n in links[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, n in zip((vectors[fresh] @ q).tolist(), fresh):
                if len(best) < width:
                    heapq.heappush(best, (sim, n))
                    heapq.heappush(todo, (-sim, n))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, n))
                    heapq.heappush(todo, (-sim, n))
        return sorted(best, reverse=True)

    def within(self, q, least: float, width: int) -> list[int]:
        """Nodes with an inner product of at least `least`; the beam widens while it holds nothing else."""
        size = len(self.vectors)
        if width >= size:
            return np.flatnonzero(self.vectors @ q >= least).tolist()
        start = [(float(self.vectors[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self._beam(q, start, 1, layer)
        while True:
            found = self._beam(q, start, width, 0)
            if found[-1][0] < least or len(found) < width:
                return [n for s, n in found if s >= least]
            width *= 4
            if width >= size:
                return np.flatnonzero(self.vectors @ q >= least).tolist()


class Forest:
    """Union of members by rank-free path halving; remembers the edges that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _matrix(column: pd.Series) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = np.stack(column.to_numpy()).astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def found_links(
    graph: SmallWorld, nodes: np.ndarray, queries: np.ndarray, vectors: np.ndarray,
    threshold: float, beam: int, audit_every: int, audit_recall: float,
) -> np.ndarray:
    """queries x nodes: the links found, a query itself left out. Every audited query must reach the recall by
    itself; without an audited query the search is as wide as the shard."""
    least = threshold - _SLACK
    audited = np.flatnonzero(queries % audit_every == 0).tolist()

    def recalled(at: int, width: int) -> bool:
        true = {n for n in np.flatnonzero(graph.vectors @ vectors[at] >= least).tolist() if nodes[n] != queries[at]}
        return len(true.intersection(graph.within(vectors[at], least, width))) >= audit_recall * len(true)

    width = beam if audited else len(nodes)
    while width < len(nodes) and not all(recalled(at, width) for at in audited):
        width *= 2
    out = np.zeros((len(queries), len(nodes)), bool)
    for at in range(len(queries)):
        found = np.array(graph.within(vectors[at], least, width), np.int64)
        found = found[nodes[found] != queries[at]]
        if len(found):
            out[at, found[graph.vectors[found] @ vectors[at] >= threshold]] = True
    return out


def search_pair(ours: tuple, theirs: tuple | None, *settings) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(node, weight of its links) and edges that span the links between two shards (graph, nodes, weights), or
    within one. A link that either side finds counts for both."""
    graph, nodes, weights = ours
    other, other_nodes, other_weights = theirs or ours
    hits = found_links(other, other_nodes, nodes, graph.vectors, *settings)
    hits = hits | (found_links(graph, nodes, other_nodes, other.vectors, *settings) if theirs else hits).T
    forest, here, there = Forest(), np.zeros(len(nodes), np.int64), np.zeros(len(other_nodes), np.int64)
    for at in np.flatnonzero(hits.any(axis=1)).tolist():
        linked = np.flatnonzero(hits[at])
        here[at] = other_weights[linked].sum()
        if theirs:
            there[linked] += weights[at]
        else:
            linked = linked[linked > at]
        for n in other_nodes[linked].tolist():
            forest.join(int(nodes[at]), n)
    sides = ((nodes, here), (other_nodes, there))
    return [(int(n), int(c)) for own, sums in sides for n, c in zip(own, sums) if c], forest.edges


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
    audit_every: int = AUDIT_EVERY,
    audit_recall: float = AUDIT_RECALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label)."""
    usable = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0)
        & F.col("label").isNotNull(),
        F.lit(False),
    )
    # -0.0 and 0.0 are one value; equal vectors are one class.
    plain = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", F.when(usable, plain).alias("embedding"))
    key = F.sha2(F.to_json(F.struct("embedding")), 256)
    rows = rows.withColumn("class", F.when(F.col("embedding").isNotNull(), F.concat_ws(":", "label", key)))
    grouped = rows.where("class is not null").groupBy("class")
    classes = settle(
        grouped.agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
            F.min("vec_id").alias("least_id"),
            F.count("*").alias("copies"),
        ),
        "classes",
    )
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    classes = classes.withColumn("length", F.size("embedding"))
    counts = classes.groupBy("label", "length").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    counts = settle(counts, "shards")
    placed = classes.join(counts, ["label", "length"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    placed = settle(placed.select("label", "length", "shards", "shard", "node", "copies", "embedding"), "placed")
    unit = ["label", "length", "shards", "shard"]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        graph = SmallWorld(_matrix(rows["embedding"]))
        content = pickle.dumps((graph, rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)))
        return pd.DataFrame({**{c: [rows[c][0]] for c in unit}, "graph": [content]})

    label_type = dict(placed.dtypes)["label"]
    unit_schema = f"label {label_type}, length int, shards int, shard int"
    graphs = settle(placed.groupBy(*unit).applyInPandas(build, f"{unit_schema}, graph binary"), "graphs")
    # Every two shards of a label meet once, and each shard meets itself.
    own = ["label", "length", "graph"]
    left = graphs.select(*own, F.col("shard").alias("lo"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("hi"))
    right = graphs.select(*own, F.col("shard").alias("hi"), F.explode(F.sequence(F.lit(0), "shard")).alias("lo"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "n": []}
        if len(left) and len(right):
            theirs = pickle.loads(right["graph"][0]) if left["lo"][0] != left["hi"][0] else None
            ours = pickle.loads(left["graph"][0])
            counts, edges = search_pair(ours, theirs, threshold, beam, audit_every, audit_recall)
            out["a"] = [a for a, _ in counts] + [a for a, _ in edges]
            out["b"] = [None] * len(counts) + [b for _, b in edges]
            out["n"] = [n for _, n in counts] + [0] * len(edges)
        return pd.DataFrame(out).astype({"a": "int64", "b": "Int64", "n": "int64"})

    meet = ["label", "length", "lo", "hi"]
    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(search, "a long, b long, n long")
    found = settle(found, "found")
    roots = components(found.where("b is not null").select("a", "b"))
    linked = found.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    named = classes.select("class", "node", "least_id", "copies").join(roots, "node", "left").join(linked, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select(
        "class", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
