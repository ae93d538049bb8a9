"""Source divergence audit over a vocabulary kept as minimal acyclic transducers.

For each language the terms of at least LEAST_DOCS of its documents are kept. Sorted, they are built into
minimal acyclic transducers (Daciuk's incremental construction: a state is frozen and merged with an equal
one as soon as the sorted order shows that nothing will be added to it). Each arc carries how many terms come
before those it leads to, so the sum along a term's path is its place in lexicographic order. All texts are
then streamed through the transducer of their language: every byte of every term follows its arc, terms that
fall off it or end at a state that accepts nothing are not kept ones, and what remains is counted by source and
ordinal. Sources of a language are compared by smoothed shares in whole numbers, and ties between terms are
decided by their ordinals.

Scale. The first pass counts documents by term, combined in the task and before the shuffle. Terms are range
partitioned, so every partition builds its own transducers, of at most `block_terms` terms, and adds the number
of terms before them. The second pass broadcasts at most `pass_bytes` of transducers (`pass_bytes` bounds a
broadcast whatever the vocabulary's size; a larger vocabulary takes another pass over the texts of its languages,
never a larger broadcast) and shuffles counts by ordinal, not strings. Pairs of sources are summed in blocks of
ordinals of at most BLOCK_CELLS counts, on both sides of a lost executor the same; the pairs themselves are the
result that is asked for.

Edge cases. A null text, lang or source counts as empty text. Rows that repeat are documents of their own. A group
without kept terms, or a language without any, still gives its pairs, of value 0 where there are no terms. A
language with one source has no pairs. Very long terms are terms like others. Extra columns are ignored. An
empty table gives no rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
BLOCK_TERMS = 100_000
PASS_BYTES = 64 << 20
BLOCK_CELLS = 1 << 18
_ROWS_AT_ONCE = 1_000
_KEPT_COUNTS = 1_000_000
#: A byte of a term, A-Z lower-cased; 0 for a byte between terms.
_LETTER = np.array([c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in range(256)], np.uint8)
#: The same with spaces between terms.
_SPACED = bytes(c or 0x20 for c in _LETTER.tolist())


class Transducer:
    """Sorted terms (bytes, each once) as arcs: `key` is state * 256 + byte, sorted; `to` the state reached;
    `add` the terms that sort before those beyond it; `accepts` by state. State 0 is the start. `bits` has for each
    state the bytes it has arcs for, `rank` the arcs before each 64 of them, so an arc is found by counting bits."""

    def __init__(self, key: np.ndarray, to: np.ndarray, add: np.ndarray, accepts: np.ndarray):
        self.key, self.to, self.add, self.accepts = key, to, add, accepts
        self.bits = np.zeros(4 * len(accepts), np.uint64)
        np.bitwise_or.at(self.bits, key >> 6, np.uint64(1) << (key & 63).astype(np.uint64))
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int32)))[:-1].astype(np.int32)

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        states: list[tuple[bool, tuple]] = []  # frozen: whether it accepts, and its arcs (byte, state)
        known: dict[tuple[bool, tuple], int] = {}
        path: list[list] = [[False, []]]  # of the last term: whether it accepts, arcs to frozen states
        last = b""

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, arcs = path.pop()
                state = (accepts, tuple(arcs))
                at = known.setdefault(state, len(states))
                if at == len(states):
                    states.append(state)
                path[-1][1].append((last[len(path) - 1], at))

        for term in terms:
            common = 0
            while common < min(len(term), len(last)) and term[common] == last[common]:
                common += 1
            freeze(common)
            path += [[False, []] for _ in term[common:]]
            path[-1][0] = True
            last = term
        freeze(0)
        states.append((path[0][0], tuple(path[0][1])))
        size = [0] * len(states)  # terms that end at or beyond a state; arcs lead to earlier states
        rows = []
        top = len(states) - 1
        for at, (accepts, arcs) in enumerate(states):
            below = int(accepts)
            for byte, to in arcs:
                rows.append(((top - at) * 256 + byte, top - to, below))  # numbered from the start down
                below += size[to]
            size[at] = below
        rows.sort()
        columns = list(zip(*rows)) if rows else [(), (), ()]
        accepting = np.array([accepts for accepts, _ in reversed(states)], np.uint8)
        return cls(np.array(columns[0], np.int64), np.array(columns[1], np.int32), np.array(columns[2], np.int32), accepting)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.key), len(self.accepts)], "<i8")
        parts = (sizes, self.key.astype("<i8"), self.to.astype("<i4"), self.add.astype("<i4"), self.accepts)
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        arcs, states = np.frombuffer(raw, "<i8", 2).tolist()
        key = np.frombuffer(raw, "<i8", arcs, 16)
        to = np.frombuffer(raw, "<i4", arcs, 16 + 8 * arcs)
        add = np.frombuffer(raw, "<i4", arcs, 16 + 12 * arcs)
        return cls(key, to, add, np.frombuffer(raw, np.uint8, states, 16 + 16 * arcs))

    def ordinals(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each term letters[start:end], -1 for one that is not accepted. All terms take their
        next arc together, those that fall off the transducer leave."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.key):
            return out
        who, at = np.arange(len(starts)), starts.astype(np.int64)
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(who):
            over = at == ends[who]
            done = over & (self.accepts[state] > 0)
            out[who[done]] = total[done]
            who, at, state, total = who[~over], at[~over], state[~over], total[~over]
            byte = letters[at]
            word = state * 4 + (byte >> 6)
            bit, held = np.uint64(1) << (byte & 63).astype(np.uint64), self.bits[word]
            on = (held & bit) > 0
            arc = self.rank[word[on]] + np.bitwise_count(held[on] & (bit[on] - np.uint64(1)))
            who, at, total = who[on], at[on] + 1, total[on] + self.add[arc]
            state = self.to[arc].astype(np.int64)
        return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of its language each term occurs."""

    def counted(batches) -> Iterator:
        import pyarrow as pa

        def flush(lang: str, counts: Counter):
            terms = pa.array([t.decode("utf-8", "replace") for t in counts], pa.string())
            columns = [pa.array([lang] * len(counts), pa.string()), terms, pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs"])

        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = counts.setdefault(lang, Counter())
                own.update(set(text.encode("utf-8", "replace").translate(_SPACED).split()))
                if len(own) > _KEPT_COUNTS:
                    yield flush(lang, counts.pop(lang))
        for lang, own in counts.items():
            yield flush(lang, own)

    rows = _rows(docs).select("lang", "text").mapInArrow(counted, "lang string, term string, docs long")
    return rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """Terms (lang, term, each once) with their ordinals (lang, term, ordinal), and the transducers of blocks of
    them: lang, first (the ordinal of the block's first term), terms, raw."""
    order = [F.col("lang"), F.col("term")]
    placed = kept.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = settle(placed.sortWithinPartitions(*order), "terms")
    sizes = placed.groupBy("lang", "part").agg(F.count("*").alias("n"))  # a row per partition and language in it
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = sizes.select("lang", "part", F.coalesce(before, F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")) - 1
    numbered = placed.join(F.broadcast(earlier), ["lang", "part"])
    numbered = settle(numbered.select("lang", "term", (F.col("earlier") + inside).alias("ordinal")), "ordinals")

    def built(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("ordinal")
        raw = Transducer.build([t.encode() for t in batch["term"]]).to_bytes()
        return pd.DataFrame({"lang": batch["lang"].iloc[:1], "first": batch["ordinal"].iloc[:1], "terms": len(batch), "raw": [raw]})

    block = F.floor(F.col("ordinal") / block_terms).alias("block")
    blocks = numbered.groupBy("lang", block).applyInPandas(built, "lang string, first long, terms long, raw binary")
    return numbered, settle(blocks, "transducers")


def passes(blocks: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list]:
    """The transducers in groups of at most pass_bytes (more for one larger block)."""
    heads = blocks.select("lang", "first", F.octet_length("raw").alias("size")).orderBy("lang", "first").collect()
    group, held = [], 0
    for head in [*heads, None]:
        if group and (head is None or held + head["size"] > pass_bytes):
            ends = [F.struct(F.lit(h["lang"]), F.lit(h["first"]).cast("long")) for h in (group[0], group[-1])]
            yield blocks.where(F.struct("lang", "first").between(*ends)).collect()
            group, held = [], 0
        if head is not None:
            group, held = [*group, head], held + head["size"]


def _terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters one after another, and where each term starts and ends in them, and its text's number."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    letters = _LETTER[np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)]
    inside = letters > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    return letters, starts, ends, np.searchsorted(ends_of, starts, side="right")


class OrdinalCounts:
    """Occurrences by group (lang, source) and ordinal, added up in a task before they leave it."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[np.ndarray] = []

    def number(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, groups: np.ndarray, ordinals: np.ndarray) -> None:
        self.fresh.append(groups << 40 | ordinals)

    def _merge(self) -> None:
        keys, counts = np.unique(np.concatenate(self.fresh), return_counts=True) if self.fresh else (self.keys[:0], self.counts[:0])
        every = np.concatenate((self.keys, keys))
        order = np.argsort(every, kind="stable")
        every, both = every[order], np.concatenate((self.counts, counts))[order]
        begins = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[begins], np.add.reduceat(both, begins) if len(every) else both
        self.fresh = []

    def flushed(self, most: int) -> Iterator:
        """Rows to be sent, if more than `most` have come together."""
        import pyarrow as pa

        if sum(map(len, self.fresh)) > most or not most:
            self._merge()
        if len(self.keys) > most:
            names = np.array(list(self.groups), object).reshape(-1, 2)[self.keys >> 40]
            columns = [pa.array(names[:, 0], pa.string()), pa.array(names[:, 1], pa.string())]
            columns += [pa.array(self.keys & ((1 << 40) - 1)), pa.array(self.counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "ordinal", "count"])
            self.__init__()


def recount(docs: DataFrame, blocks: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, ordinal, count of every kept term's occurrences: texts streamed through the transducers."""
    schema = "lang string, source string, ordinal long, count long"
    rows, out = _rows(docs), docs.sparkSession.createDataFrame([], schema)
    for held in passes(blocks, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast([(h["lang"], h["first"], bytes(h["raw"])) for h in held])

        def counted(batches, sent=sent) -> Iterator:
            of: dict[str, list[tuple[int, Transducer]]] = {}
            for lang, first, raw in sent.value:
                of.setdefault(lang, []).append((first, Transducer.from_bytes(raw)))
            counts = OrdinalCounts()
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                    langs: dict[str, tuple[list[str], list[str]]] = {}
                    for lang, source, text in zip(*[c.to_pylist() for c in whole.slice(at, _ROWS_AT_ONCE).columns]):
                        own = langs.setdefault(lang, ([], []))
                        own[0].append(source)
                        own[1].append(text)
                    for lang, (sources, texts) in langs.items():
                        letters, starts, ends, row = _terms_of(texts)
                        groups = np.array([counts.number(lang, source) for source in sources], np.int64)
                        for first, transducer in of.get(lang, []):
                            found = transducer.ordinals(letters, starts, ends)
                            kept = found >= 0
                            counts.add(groups[row[kept]], found[kept] + first)
                    yield from counts.flushed(_KEPT_COUNTS)
            yield from counts.flushed(0)

        langs = sorted({h["lang"] for h in held})
        texts = rows.where(F.col("lang").isin(langs)).select("lang", "source", "text")
        out = out.union(texts.mapInArrow(counted, schema))
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count"))


def share(count: np.ndarray, total: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * count / total) for count <= total, scale a power of 1000: by long division in steps
    of 1000, exact in 64 bits for totals under 9e15."""
    out, rest = np.zeros_like(count), count
    while scale > 1:
        rest = rest * 1000
        out, rest, scale = out * 1000 + rest // total, rest % total, scale // 1000
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _share(count: Column, total: Column, scale: int = SCALE) -> Column:
    """The same as `share`, as a column."""
    wide = (F.lit(scale) * count.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, total.cast("decimal(20,0)"))


def pair_sums(cells: DataFrame, groups: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """lang, a, b (a < b by number), value: the distance of two sources summed over all kept terms.

    groups: lang, source, n (occurrences of kept terms), v (kept terms), number (of the source in its
    language, from 0), sources. A block of ordinals meets the totals of all sources of its language, so that
    terms a source lacks count with their smoothed share."""
    width = F.greatest(F.lit(1), F.floor(F.lit(block_cells) / F.col("sources")))
    known = groups.select("lang", "source", "number", width.alias("width"))
    left = cells.join(known, ["lang", "source"]).select(
        "lang", F.floor(F.col("ordinal") / F.col("width")).alias("block"),
        F.col("number").alias("at"), "ordinal", "count",
    )
    last = F.floor((F.col("v") - 1) / width)
    right = groups.where("v > 0 and sources > 1").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "number", "n", "v", width.alias("width")
    )

    def summed(key: tuple, held: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(totals):
            return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
        totals = totals.sort_values("number")
        n, v = totals["n"].to_numpy(np.int64), int(totals["v"].iloc[0])
        first = int(key[1]) * int(totals["width"].iloc[0])
        counts = np.zeros((len(n), min(int(totals["width"].iloc[0]), v - first)), np.int64)
        counts[held["at"], held["ordinal"] - first] = held["count"]
        p = share(counts + 2, (n + 2 * v)[:, None])
        a, b = np.triu_indices(len(n), 1)
        value = np.concatenate([distance(p[i], p[i + 1 :]).sum(axis=1) for i in range(len(n) - 1)] or [np.zeros(0, np.int64)])
        return pd.DataFrame({"lang": key[0], "a": a, "b": b, "value": value})

    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
    parts = parts.applyInPandas(summed, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
    pass_bytes: int = PASS_BYTES, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: how far each source lies from the other sources of its
    language, and the terms that it uses more than its language does."""
    terms = document_counts(docs).where(F.col("docs") >= least_docs)
    ordinals, blocks = vocabulary(terms, block_terms)
    cells = settle(recount(docs, blocks, pass_bytes), "cells")

    every = _rows(docs).select("lang", "source").distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = ordinals.groupBy("lang").agg(F.count("*").alias("v"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = every.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "v"])
    whole = Window.partitionBy("lang")
    groups = groups.withColumns({"number": number, "sources": F.count("*").over(whole), "n_lang": F.sum("n").over(whole)})
    groups = settle(groups, "groups")

    sums = pair_sums(cells, groups, block_cells)
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("number").alias(k)) for s, k in (("source", "a"), ("item", "b")))
    pairs = one.join(two, "lang").where("a <> b")  # the pairs that the result lists
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = pairs.select("lang", "source", "item", low, high).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place))

    by_term = cells.groupBy("lang", "ordinal").agg(F.sum("count").alias("all"))
    found = cells.join(by_term, ["lang", "ordinal"]).join(groups.select("lang", "source", "n", "v", "n_lang"), ["lang", "source"])
    p = _share(F.col("count") + 2, F.col("n") + 2 * F.col("v"))
    q = _share(F.col("all") + 2, F.col("n_lang") + 2 * F.col("v"))
    found = found.select("lang", "source", "ordinal", p.alias("p"), q.alias("q")).where("p > q")
    found = found.withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    found = found.join(ordinals, ["lang", "ordinal"])
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(found)


def oracle() -> str:
    """DuckDB SQL of the query."""
    p = f"1 + ({SCALE}::hugeint * (count + 2)) // (n + 2 * v)"
    return f"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(text, '') as text from documents),
words as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct r) >= {LEAST_DOCS}),
vs as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
cells as (select lang, source, term, count(*) as count from words join kept using (lang, term) group by all),
ns as (select lang, source, coalesce(sum(count), 0)::bigint as n from groups left join cells using (lang, source) group by all),
grid as (select k.lang, ns.source, k.term, coalesce(c.count, 0) as count, n, v from kept k join ns using (lang)
    join vs using (lang) left join cells c on c.lang = k.lang and c.source = ns.source and c.term = k.term),
ps as (select lang, source, term, count, {p} as p from grid),
qs as (select lang, term, {p} as q from (select lang, term, sum(count) as count, any_value(v) as v,
    any_value(nl) as n from grid join (select lang, sum(n) as nl from ns group by lang) using (lang) group by all)),
pairs as (select a.lang, a.source, b.source as item,
    coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0)::bigint as value
    from ps a join ps b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value
    from ps join qs using (lang, term) where count > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
    from (select * from every union all select * from terms))
select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TOP_TERMS}"""
