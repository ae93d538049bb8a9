"""SimHash near-duplicates, searched with a hierarchical index over Gray order.

Every text becomes a 64-bit fingerprint: the majority of each bit over the XXH64 hashes of its word
shingles. Fingerprints within `max_bits` differing bits are linked, and links chain into components.

Search. The 64 bits are cut into max_bits + 2 blocks; two fingerprints within max_bits share at least two
whole blocks, so each pair meets in a group of some pair of blocks. A group is sorted by Gray rank, in
which close fingerprints stand together. Runs of FANOUT neighbours form nodes that hold the bits all
members share (mask and pattern), nodes form upper nodes, and so on. Two nodes are compared on the bits
both share; differences accumulate on the way down, and a pair of nodes beyond max_bits is dropped with
all its members. Members already in one component are not compared again, and a group reports a spanning
forest rather than all pairs, so that a group of many near copies stays small.

Scale. Copies meet as one fingerprint. A group larger than `group_rows` is cut by hash into parts and
every two parts meet in a task of their own, so no task holds an unbounded group and no pair is lost.

Edge cases. A null, empty or white-space text has fingerprint zero and is linked like any other. Repeated
rows keep one result row each. A row without doc_id is linked, but the component is named by the smallest
non-null doc_id (null if there is none). Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.support import components, settle

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
GROUP_ROWS = 4_096
FANOUT = 16
_HASHES_AT_ONCE = 16_384
_PAIRS_AT_ONCE = 4_096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of each shingle, lower-cased in A-Z, joined by single spaces."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "replace").lower().split()  # the six ASCII white-space bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(tokens))
    firsts, lasts = starts[: len(tokens) - span + 1].tolist(), ends[span - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(firsts), _HASHES_AT_ONCE):
        cut = slice(at, at + _HASHES_AT_ONCE)
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(firsts[cut], lasts[cut])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(firsts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, version (a hash of the text) and fp, the fingerprint as a signed long; a row per row of docs."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "version": batch["version"], "fp": prints})

    rows = docs.select("doc_id", "text", _version("text").alias("version"))
    return rows.mapInPandas(hashed, "doc_id long, version long, fp long")


def _version(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def gray_rank(fp):
    """Place of a bit pattern in Gray order: each bit is the parity of the bits from it upwards."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def block_masks(max_bits: int) -> list[int]:
    """Every two of max_bits + 2 blocks of bits, as signed masks."""
    edges = np.linspace(0, BITS, max_bits + 3).round().astype(int).tolist()
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(x | y).view(np.int64)) for x, y in combinations(blocks, 2)]


def _differing(a, b, on=None):
    both = a ^ b
    return np.bitwise_count(both if on is None else both & on)


class _Forest:
    """Component labels of the members of one group."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label[:] = label[label]


def group_forest(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels (smallest member's position) of one group, `prints` in Gray order."""
    size = len(prints)
    forest = _Forest(size)
    levels = [(prints, np.full(size, ~np.uint64(0)))]  # pattern and mask of each node, members first
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones, ones | zeros))

    def one_label(level: int, node: np.ndarray) -> np.ndarray:
        """The label all members of a node have, or -1 and less where they differ."""
        step = FANOUT**level
        at = np.arange(0, size, step)
        low, high = np.minimum.reduceat(forest.label, at), np.maximum.reduceat(forest.label, at)
        return np.where(low == high, low, -1 - np.arange(len(at)))[node]

    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8))]
    while todo:
        level, a, b, apart = todo.pop()
        if level == 0:
            near = (apart <= max_bits) & (a != b)
            forest.join(a[near], b[near])
            continue
        same = one_label(level, a)
        keep = same != np.where(same >= 0, one_label(level, b), -size - 2)
        a, b, apart = a[keep], b[keep], apart[keep]
        (pattern, mask), (inner, inner_mask) = levels[level], levels[level - 1]
        fan, count = np.arange(FANOUT), len(inner)
        for at in range(0, len(a), _PAIRS_AT_ONCE):
            up_a, up_b, so_far = (x[at : at + _PAIRS_AT_ONCE] for x in (a, b, apart))
            x = np.broadcast_to((up_a[:, None] * FANOUT + fan)[:, :, None], (len(up_a), FANOUT, FANOUT)).ravel()
            y = np.broadcast_to((up_b[:, None] * FANOUT + fan)[:, None, :], (len(up_b), FANOUT, FANOUT)).ravel()
            up = np.repeat(np.arange(len(up_a)), FANOUT * FANOUT)
            there = (x <= y) & (y < count)
            x, y, up = x[there], y[there], up[there]
            above = (mask[up_a] & mask[up_b])[up]  # bits already compared in the upper nodes
            total = so_far[up] + _differing(inner[x], inner[y], inner_mask[x] & inner_mask[y] & ~above)
            keep = total <= max_bits
            todo.append((level - 1, x[keep], y[keep], total[keep]))
    return forest.label


def _search(max_bits: int):
    """Reads rows sorted by group and Gray rank; yields links that span each group's components."""

    def links(key: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        turn = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        sizes = np.diff(np.append(turn, len(prints)))
        run = np.repeat(np.arange(len(turn)), sizes)
        a, b = [], []
        small = np.flatnonzero(sizes <= FANOUT)
        here = np.flatnonzero(np.isin(run, small) if len(small) < len(turn) else np.ones(len(run), bool))
        for by in range(1, FANOUT):  # groups of one node: its members are compared with each other
            left = here[: len(here) - by][here[by:] - here[: len(here) - by] == by] if by < len(here) else here[:0]
            left = left[run[left] == run[left + by]]
            if not len(left):
                break
            near = left[_differing(prints[left], prints[left + by]) <= max_bits]
            a.append(prints[near])
            b.append(prints[near + by])
        for at in np.flatnonzero(sizes > FANOUT):
            own = prints[turn[at] : turn[at] + sizes[at]]
            label = group_forest(own, max_bits)
            moved = np.flatnonzero(label != np.arange(len(own)))
            a.append(own[moved])
            b.append(own[label[moved]])
        empty = np.zeros(0, np.uint64)
        return pd.DataFrame({n: np.concatenate([empty, *v]).view(np.int64) for n, v in (("a", a), ("b", b))})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last group may go on in the next batch
        names = ["t", "k", "x", "y"]
        for batch in batches:
            last = batch[names].to_numpy()[-1]
            same = (batch[names].to_numpy() == last).all(axis=1)
            cut = len(batch) - int(same[::-1].argmin()) if not same.all() else 0
            if cut or (held and (held[-1][names].to_numpy()[-1] != last).any()):
                done = pd.concat([*held, batch[:cut]])
                yield links(done[names].to_numpy(), done["fp"].to_numpy(np.int64).view(np.uint64))
                held = []
            held.append(batch[cut:])
        if held:
            done = pd.concat(held)
            yield links(done[names].to_numpy(), done["fp"].to_numpy(np.int64).view(np.uint64))

    return search


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between the distinct values of `fp` that connect all those within max_bits."""
    tables = F.posexplode(F.array(*[F.lit(m) for m in block_masks(max_bits)])).alias("t", "mask")
    keyed = prints.select("fp", tables).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    heavy = settle(keyed.groupBy("t", "k").count().where(F.col("count") > group_rows), "heavy")
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / group_rows).cast("int")
    meet = (
        keyed.join(heavy, ["t", "k"], "left")
        .withColumn("p", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("t", "k", F.least("p", "o").alias("x"), F.greatest("p", "o").alias("y"), "fp")
    )
    # Unsigned order of the ranks does not matter, only that neighbours in Gray order stand together.
    placed = meet.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y", gray_rank(F.col("fp")))
    return placed.mapInPandas(_search(max_bits), "a long, b long")


def simhash_components(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """doc_id, version, fingerprint (16 hex digits) and component_id, one row per row of docs."""
    rows = settle(fingerprints(docs, words), "prints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(near_links(distinct.select("fp"), max_bits, group_rows))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = rows.join(placed.join(names, "root").select("fp", "component_id"), "fp")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", "version", shown, "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, the one that names it; columns unchanged. Of different texts under
    that doc_id the one with the least hash stays; of rows of one text the one whose columns come first as
    JSON. In a component without any doc_id one row of each different text stays."""
    found = settle(simhash_components(docs, **settings).where("doc_id <=> component_id"), "named")
    least = F.min("version").over(Window.partitionBy("doc_id"))
    stay = found.where("doc_id is not null").groupBy("doc_id", "version").count()
    stay = stay.withColumn("least", least).where("version = least").select("doc_id", "version", "count")
    loose = found.where("doc_id is null").groupBy("doc_id", "version").count()
    stay = settle(stay.union(loose), "stay")

    def rows(keys: DataFrame) -> DataFrame:
        same = F.expr("d.doc_id <=> k.doc_id and xxhash64(coalesce(d.text, '')) = k.version")
        return docs.alias("d").join(keys.alias("k"), same, "left_semi")

    out = rows(stay.where("count = 1"))
    repeated = stay.where("count > 1")
    if repeated.head(1):
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        # Combined before the shuffle, however often a row is repeated.
        least = rows(repeated).groupBy("doc_id", _version("text").alias("v")).agg(F.min_by(row, F.to_json(row)).alias("row"))
        out = out.union(least.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return out
