"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces. A test item of n characters may differ
from a passage in e = error_rate * n edits. It is cut into e + 1 pieces; a passage within e edits must hold
at least one piece unchanged. All pieces are looked for at once in each whole text (Aho-Corasick), and each
window that a hit points to is verified with Myers' bit-parallel distance, the start and end of the passage
being free. Hits of one item that point to the same place are verified once, and only where the window
holds as many of the item's five-letter pieces as e edits must leave (each edit breaks one at most).

Scale. One pass over the texts without a shuffle. Only test items are broadcast, in blocks of at most
`block_chars` characters; more items take more passes, never a larger broadcast.

An item under 1 / error_rate characters allows no edit. It is found between word ends only, never inside a
word, and as a word or two are no passage, `clean` drops a document for an item under `least_chars` characters
only if its text is nothing else; `matches` reports it wherever it stands.

Edge cases. Null or empty items and texts match nothing, nor do items without a letter or digit. Equal
items are reported each under its own item_id. Repeated rows of docs give equal matches, reported once per
doc_id by `matches`; rows without doc_id are reported under null. Extra columns are kept by `clean`. Empty
tables give no matches; without items `clean` keeps every row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.1
LEAST_CHARS = 10
BLOCK_CHARS = 4_000_000
SHORT = 5
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def budget(item: str, error_rate: float) -> int:
    return int(len(item) * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length that make up the item, with their places in it."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for place, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << place
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of the item to any part of text, and the first end of such a part."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    best, end = size, 0
    get = masks.get
    for place, c in enumerate(text, 1):
        match = get(c, 0)
        d0 = (((match & up) + up) ^ up) | match | down
        gain = down | ~(d0 | up) & full
        loss = d0 & up
        if gain & top:
            distance += 1
        elif loss & top:
            distance -= 1
        gain = (gain << 1) & full  # the passage may start anywhere: row zero stays at zero
        loss = (loss << 1) & full
        up = loss | ~(d0 | gain) & full
        down = gain & d0
        if distance < best:
            best, end = distance, place
    return best, end


class Items:
    """The items of one block, ready to be looked for."""

    def __init__(self, rows: list[tuple[int | None, str]], error_rate: float):
        import ahocorasick

        self.items, self.ids = [], {}
        for item_id, text in rows:  # equal items are looked for once
            self.ids.setdefault(text, []).append(item_id)
        places: dict[str, list[tuple[int, int]]] = {}
        for text in self.ids:
            errors = budget(text, error_rate)
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((len(self.items), at))
            short = [text[i : i + SHORT] for i in range(0, len(text) - SHORT + 1, SHORT)]
            self.items.append((text, errors, letter_masks(text), short, len(short) - errors))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)
        self.seen: dict[tuple[int, str], tuple[int, int]] = {}

    def _distance(self, number: int, window: str) -> tuple[int, int]:
        """Passages repeat across documents: what was verified last is kept."""
        found = self.seen.get((number, window))
        if found is None:
            text, errors, masks, short, least = self.items[number]
            may = least <= 0 or sum(map(window.__contains__, short)) >= least
            found = myers(masks, len(text), window) if may else (errors + 1, 0)
            if len(self.seen) >= 20_000:
                self.seen.clear()
            self.seen[number, window] = found
        return found

    def passages(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the closest passage of each item, in characters of the normal
        text; start is the earliest place the passage may begin, given its end and distance."""
        if not self.any or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            for number, at in where:
                begin = last - size + 1 - at  # where the item would start without edits before the piece
                item, errors = self.items[number][:2]
                if not errors:
                    edges = text[begin - 1 : begin] if begin else " ", text[last + 1 : last + 2] or " "
                    if edges == (" ", " ") and number not in best:
                        best[number] = (0, begin, last + 1)
                    continue
                # Starts that differ by up to the budget share a window that holds all their passages.
                slot = begin // (errors + 1)
                if (number, slot) in done:
                    continue
                done.add((number, slot))
                left = max(0, slot * (errors + 1) - errors)
                window = text[left : slot * (errors + 1) + 3 * errors + len(item)]
                distance, end = self._distance(number, window)
                if distance <= errors:
                    found = (distance, max(0, left + end - len(item) - distance), left + end)
                    if number not in best or found < best[number]:
                        best[number] = found
        return [(number, *found) for number, found in sorted(best.items())]

    def leaks(self, text: str, least_chars: int) -> bool:
        """Whether a normal text holds a passage of an item, or is itself an item under least_chars."""
        return text in self.ids or any(len(self.items[n][0]) >= least_chars for n, *_ in self.passages(text))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int | None, str]]]:
    """The normal texts of the items, in blocks of about block_chars characters (more for one longer item)."""
    usable = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, count)))
    for number in range(count):
        rows = usable.where(block == number).orderBy("item_id", "text").collect()
        yield [(r["item_id"], n) for r in rows if (n := normal(r["text"]))]


def _held(spark, rows, error_rate):
    """A broadcast of one block, and a way to get its automaton once in each task."""
    sent = spark.sparkContext.broadcast(rows)
    return lambda: Items(sent.value, error_rate)


def matches(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, distance, passage (its normal text): the closest passage of each item in each text."""
    schema = "doc_id long, item_id long, distance int, passage string"
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in item_blocks(benchmark, block_chars):
        held = _held(docs.sparkSession, rows, error_rate)

        def found(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            items = held()
            for batch in batches:
                hits = []
                for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                    plain = normal(text)
                    for number, distance, start, end in items.passages(plain):
                        for item_id in items.ids[items.items[number][0]]:
                            hits.append((doc_id, item_id, distance, plain[start:end]))
                out = pd.DataFrame(hits, columns=["doc_id", "item_id", "distance", "passage"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.union(docs.select("doc_id", "text").mapInPandas(found, schema))
    least = F.min(F.struct("distance", "passage")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(least).select("doc_id", "item_id", "m.distance", "m.passage")


def clean(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """The rows of docs whose text holds no passage of any item; columns unchanged."""
    out = docs
    for rows in item_blocks(benchmark, block_chars):
        held = _held(docs.sparkSession, rows, error_rate)

        def kept(batches, held=held):
            import pyarrow as pa

            items = held()
            for batch in batches:
                texts = batch.column("text").to_pylist()
                keep = [not items.leaks(normal(t), least_chars) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(kept, out.schema)
    return out
