"""Removal of repeated passages by relative Lempel-Ziv parsing.

A word goes if a window of `window` words of one text that covers it also starts in a document with a smaller
doc_id. Reference blocks hold passages of many documents, indexed by a suffix array. Every passage is parsed
greedily against its block: from each place the longest factor that also lies in a document of a smaller
doc_id is taken. A repeated window lies within one factor, which is then at least a window long, or it holds
one boundary of two factors, as the factor that starts inside it reaches at least to its end; so long factors
are spans, and the windows across a boundary are looked up where the two factors together are long enough.

Which block. A document cannot be parsed against the whole corpus. Of the runs of ANCHOR words inside any
window the one of least hash is its anchor; equal windows have equal anchors. A block holds, for a range of
anchors, the passages around them (every window with that anchor lies within), so a document is parsed
against all blocks that can hold a window of its own, and against no other.

Scale. Only anchors are shuffled at first, about one in 13 words; those of a single document go at once. Equal
texts and equal passages are one class, whose first document stands for it, so copies are counted before
they move: the others of a class are covered whole. Passages of the classes that remain are sent to their blocks.
An anchor with more than `group` different passages, as that of a passage quoted in a third of all texts, is
shared out instead: its windows are counted by their hash, combined before the shuffle, with the same result.
Texts are read three times, moved twice, and no task holds more than a block. Anchors and classes go by hashes
of 64 bits and more; factors compare words.

Edge cases. A null or empty text has no words; texts under a window keep all. A null doc_id counts as larger
than any other. Rows of equal doc_id do not remove each other's words; each keeps a row. Extra columns are
ignored. An empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle

WINDOW = 50
ANCHOR = 25
#: Different passages of one anchor that a block takes, and passages after which a block is closed.
GROUP = 8_000
BLOCK = 8_000
_ROWS_AT_ONCE = 500
_LAST = 2**63 - 1
_KNOWN_WORDS = 500_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64


def words(text: str | None) -> list[bytes]:
    """The words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


class Hasher:
    """Hashes of runs of words, from sums of word hashes times powers of an odd number modulo 2 ** 64."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 2**64))):
                steps = np.full(2 * size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, text: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        ids = list(map(self.known.get, text))
        for at, found in enumerate(ids):
            if found is None:
                ids[at] = found = xxh3_64_intdigest(text[at])
                if len(self.known) < _KNOWN_WORDS:
                    self.known[text[at]] = found
        self._grow(len(text) + 1)
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(np.array(ids, np.uint64) * self.powers[: len(text)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each run of words start..end."""
        mixed = (sums[end] - sums[start]) * self.inverses[start]
        mixed ^= (end - start).astype(np.uint64) << np.uint64(48)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        return mixed ^ (mixed >> np.uint64(32))

    def anchors(self, sums: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors of all windows, and their hashes: in each window the first run of least hash."""
        starts = np.arange(len(sums) - anchor)
        hashed = self.runs(sums, starts, starts + anchor)
        in_window = np.lib.stride_tricks.sliding_window_view(hashed, window - anchor + 1)
        places = np.unique(in_window.argmin(axis=1) + np.arange(len(in_window)))
        return places, hashed[places]


def _longs(hashed: np.ndarray):
    import pyarrow as pa

    return pa.array(hashed.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """id (doc_id, null as the largest number), text, key (one for equal texts)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("key"))


def outlines(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """id, key, n_words, sha256 (of all words) and anchors of each row: for each the run's hash, the hash of
    the passage around it, and where that starts and ends."""
    schema = "id long, key string, n_words long, sha256 string, anchors array<struct<anchor: long, passage: long, start: int, end: int>>"

    def outlined(batches) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                sizes, digests, ends, parts = [], [], [0], []
                for text in batch.column("text").to_pylist():
                    own = words(text)
                    sizes.append(len(own))
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                    if len(own) >= window:
                        sums = hasher.sums(own)
                        places, hashed = hasher.anchors(sums, window, anchor)
                        start = np.maximum(places + anchor - window, 0)
                        end = np.minimum(places + window, len(own))
                        parts.append((hashed, hasher.runs(sums, start, end), start, end))
                    ends.append(ends[-1] + (len(parts[-1][0]) if len(own) >= window else 0))
                columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, int)] * 2
                fields = [_longs(columns[0]), _longs(columns[1]), *[pa.array(c.astype(np.int32)) for c in columns[2:]]]
                rows = pa.StructArray.from_arrays(fields, ["anchor", "passage", "start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests), lists],
                    names=["id", "key", "n_words", "sha256", "anchors"],
                )

    return _keyed(docs).mapInArrow(outlined, schema)


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Places of `text` in the order of what follows, up to `longest` items, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        after = np.concatenate((rank[length:] + 1, np.zeros(min(length, len(rank)), np.int64)))[: len(rank)]
        pair = rank * (len(rank) + 1) + after
        order = np.argsort(pair, kind="stable")
        steps = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        rank = np.empty_like(rank)
        rank[order] = steps
        length *= 2
        if length >= longest or steps[-1] == len(rank) - 1:
            return order


def _smaller_before(values: list[int]) -> np.ndarray:
    """For each value the nearest place before it that holds a smaller one, -1 if none."""
    out, stack = np.empty(len(values), np.int64), []
    for at, value in enumerate(values):
        while stack and values[stack[-1]] >= value:
            stack.pop()
        out[at] = stack[-1] if stack else -1
        stack.append(at)
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many items from a and from b on are equal; b = -1 has none. Ends at the items that occur once."""
    out, live = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
    while len(live):
        live = live[(np.maximum(a[live], b[live]) + out[live] < len(text))]
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
    return out


class ReferenceBlock:
    """Passages (lists of words) of documents with their ids, indexed to be parsed against one another."""

    def __init__(self, passages: list[list[bytes]], ids: list[int]):
        number: dict[bytes, int] = {}
        rows = []
        for n, passage in enumerate(passages):
            rows.append([number.setdefault(w, len(number)) for w in passage])
            rows.append([-1 - n])  # ends the passage: no factor goes beyond
        text = np.array([x for row in rows for x in row], np.int64)
        self.begins = np.cumsum([0, *[len(p) + 1 for p in passages]]).tolist()
        owner = np.repeat(np.unique(np.array(ids), return_inverse=True)[1], [len(p) + 1 for p in passages])
        order = suffix_array(text, max(map(len, passages), default=0) + 1)
        owners = owner[order].tolist()
        before, after = _smaller_before(owners), _smaller_before(owners[::-1])
        after = np.where(after[::-1] < 0, -1, len(order) - 1 - after[::-1])
        longest = np.zeros(len(text), np.int64)
        for near in (before, after):
            other = np.where(near < 0, -1, order[near])
            longest[order] = np.maximum(longest[order], _common(text, order, other))
        #: At each place, how many words also follow one another in a document of a smaller id.
        self.longest = longest.tolist()

    def factors(self, number: int) -> list[tuple[int, int]]:
        """The greedy parse of a passage: (start, end) of each factor; a word found nowhere is one."""
        begin, end, out = self.begins[number], self.begins[number + 1] - 1, []
        at = begin
        while at < end:
            out.append((at - begin, at - begin + max(1, self.longest[at])))
            at += max(1, self.longest[at])
        return out

    def spans(self, number: int, window: int) -> list[tuple[int, int]]:
        """(start, end) of the parts of a passage that are covered by repeated windows; they may overlap."""
        begin, factors = self.begins[number], self.factors(number)
        out = [f for f in factors if f[1] - f[0] >= window]
        for (a, b), (_, c) in zip(factors, factors[1:]):
            for start in range(max(a, b - window + 1), min(b - 1, c - window) + 1):
                if self.longest[begin + start] >= window:
                    out.append((start, start + self.longest[begin + start]))
        return out


def parse_blocks(passages: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """anchor, passage, span_start, span_end: the spans of each passage (anchor, passage, id, words), which are
    the passages of an anchor in one block."""

    def parsed(batches) -> Iterator[pd.DataFrame]:
        def result(rows: list[tuple]) -> pd.DataFrame:
            held = ReferenceBlock([words(r[3]) for r in rows], [r[2] for r in rows])
            out = [(r[0], r[1], *span) for n, r in enumerate(rows) for span in held.spans(n, window)]
            return pd.DataFrame(out, columns=["anchor", "passage", "span_start", "span_end"]).astype("int64")

        rows: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if len(rows) >= block and rows[-1][0] != row[0]:
                    yield result(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield result(rows)

    rows = passages.select("anchor", "passage", "id", "words").repartition("anchor").sortWithinPartitions("anchor", "id")
    return rows.mapInPandas(parsed, "anchor long, passage long, span_start long, span_end long")


def passages_of(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The wanted passages (key, id, anchor, passage, start, end, crowded) out of the texts: their words, or
    for those of crowded anchors the hashes and places of their windows."""
    schema = "key string, id long, anchor long, passage long, words string, windows array<struct<hash: long, at: int>>"
    names = ["key", "id", "anchor", "passage", "words", "windows"]

    def cut(batches) -> Iterator:
        import pyarrow as pa

        hasher, types = Hasher(), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        types.append(pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))
        for whole in batches:
            for number in range(whole.num_rows):
                key, id_, text, places = (c.to_pylist()[0] for c in whole.slice(number, 1).columns)
                own, out = words(text), []
                sums = hasher.sums(own) if any(p["crowded"] for p in places) else None
                for p in places:
                    a, b, found, windows = p["start"], p["end"], None, None
                    if p["crowded"]:
                        at = np.arange(a, b - window + 1)
                        hashed = hasher.runs(sums, at, at + window).view(np.int64)
                        windows = [{"hash": h, "at": i} for h, i in zip(hashed.tolist(), at.tolist())]
                    else:
                        found = b" ".join(own[a:b]).decode("utf-8", "replace")
                    out.append((key, id_, p["anchor"], p["passage"], found, windows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    place = F.struct("start", "end", "anchor", "passage", "crowded")
    by_text = wanted.groupBy("key", "id").agg(F.collect_list(place).alias("places"))  # of one text
    return _keyed(docs).join(by_text, ["key", "id"]).select("key", "id", "text", "places").mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, outline: DataFrame, window: int = WINDOW, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """key, id, start, end: parts of the first document of each text that are covered by repeated windows. They
    may overlap."""
    # One row for each text, of its first document; the other documents with that text are covered whole.
    texts = outline.where(F.size("anchors") > 0).groupBy("key").agg(F.min("id").alias("id"), F.first("anchors").alias("anchors"))
    places = settle(texts.select("key", "id", F.inline("anchors")), "anchors")
    # Written first, so that adaptive execution can split the hot keys of the joins.
    met = places.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("anchor")
    shared = settle(places.join(settle(met, "met"), "anchor"), "shared")
    classes = settle(shared.groupBy("anchor", "passage").agg(F.min("id").alias("source")), "classes")
    sizes = settle(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    owned = shared.join(classes, ["anchor", "passage"])
    whole = owned.where("id > source").select("key", "id", "start", "end")
    first = owned.where("id = source").join(sizes, "anchor")
    first = settle(first.select("key", "id", "anchor", "passage", "start", "end", (F.col("n") > group).alias("crowded")), "first")
    held = settle(passages_of(docs, first, window), "passages")

    alike = held.where("words is not null").dropDuplicates(["anchor", "passage"])
    spans = parse_blocks(alike, window, block).join(first.select("key", "id", "anchor", "passage", F.col("start").alias("at")), ["anchor", "passage"])
    parsed = spans.select("key", "id", (F.col("at") + F.col("span_start")).alias("start"), (F.col("at") + F.col("span_end")).alias("end"))

    crowded = held.where("words is null").select("key", "id", F.inline("windows"))
    sources = crowded.groupBy("hash").agg(F.min("id").alias("source"))
    counted = crowded.join(sources, "hash").where("id > source")
    counted = counted.select("key", "id", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    return whole.union(parsed).union(counted)


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """key, n_removed, kept: the text of each first document (key, id) without the words in its spans."""

    def cut(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, kept = [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                own = words(text)
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, [p["start"] for p in parts], 1)
                np.add.at(change, [p["end"] for p in parts], -1)
                keep = np.cumsum(change)[:-1] == 0
                counts.append(len(own) - int(keep.sum()))
                kept.append(b" ".join([own[i] for i in np.flatnonzero(keep).tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
                names=["key", "n_removed", "kept"],
            )

    by_text = spans.groupBy("key", "id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = _keyed(docs).join(by_text, ["key", "id"]).select("key", "text", "spans")
    return rows.mapInArrow(cut, "key string, n_removed long, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: its words, how many of them are covered by a
    window that also starts in a document with a smaller doc_id, and a digest of the others."""
    outline = settle(outlines(docs, window, anchor), "outlines")
    spans = settle(repeated_spans(docs, outline, window, group, block), "spans")
    changed = removed(docs, spans)
    changed = changed.groupBy("key").agg(F.first("n_removed").alias("n_removed"), F.first(F.sha2(F.col("kept").cast("binary"), 256)).alias("kept"))
    firsts = outline.groupBy("key").agg(F.min("id").alias("first")).join(changed, "key", "left")
    firsts = settle(firsts, "texts")
    rows = outline.select("id", "key", "n_words", "sha256").join(firsts, "key")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    n_removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    own = F.when(F.col("id") == F.col("first"), F.col("kept"))
    kept = F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(own, "sha256"))
    doc_id = F.when(F.col("id") < _LAST, F.col("id"))
    return rows.select(doc_id.alias("doc_id"), "n_words", n_removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL of the query, for doc_ids that are not null."""
    return f"""
with docs as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
starts as (select r, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as pos from docs),
windows as (select r, doc_id, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') as w from starts),
firsts as (select w, min(doc_id) as first from windows group by w),
spans as (select r, list(pos) as places_hit from windows join firsts using (w) where doc_id > first group by r),
places as (select docs.r, unnest(range(1, len(words) + 1)) as pos, unnest(words) as word from docs),
hits as (select r, unnest(places_hit) as pos from spans),
marked as (select p.r, p.pos, word, count(h.pos) over (partition by p.r order by p.pos
    rows between {WINDOW - 1} preceding and current row) > 0 as gone from places p left join hits h on h.r = p.r and h.pos = p.pos),
kept as (select r, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as kept
    from marked group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256 from docs left join kept using (r)"""
