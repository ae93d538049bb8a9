"""Personal data: four fixed kinds by pattern, and unseen identifiers by bootstrapped context.

Base spans are those of the fixed patterns below, leftmost and non-overlapping for each kind. They seed the
bootstrapping. Every base span is an instance, and so is every other run of neighbouring tokens that hold a digit
or an at sign, however long; the words around it, on the left, on the right or on both sides, are its lexical
patterns. Instances and patterns form a graph that Spark scores in rounds:

* a pattern's confidence for a kind is the scored share of its distinct instances, where at least
  `min_seeds` of them are scored;
* an unseen instance scores one minus the product of (1 - confidence) over its confident patterns.

Instances of a kind's base spans keep score one for it. In the end, occurrences of unseen identifiers in a
confident pattern become spans of its kind. Then the texts are read again for the slots that the confident
patterns point to: one token beside a context on one side, one to SLOT_TOKENS tokens between two. What stands there
needs no digit; it becomes a span where the pattern stays confident with all it points to counted. Base spans
always stay.

Scale. One pass over the texts, and another one for each block of at most `block_chars` characters of confident
patterns, which are all that is broadcast; only identifiers and their few neighbouring words are shuffled. The
graph holds each (pattern, instance) pair once, counted before the shuffle, so a common line or identifier is one
edge; scores are partial sums, and the joins can be split by adaptive execution.

Edge cases. A null text counts as empty. Repeated rows give repeated rows with equal spans; rows with the
same doc_id and different texts are kept apart. Rows without doc_id are scanned like any other. Signs that stand
alone are no context words. Very long runs of digits or letters take linear time, and stand for themselves in the
graph by a digest. Extra columns are ignored by `find_spans` and kept by `redact`."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.8
MIN_SEEDS = 5
_UNSEEN = -1

# The fixed patterns, written so that a failing start is not tried again inside the same run of letters or
# digits; what they match is that of the plain patterns:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      card [0-9]([\x20-]?[0-9])+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)                   phone \+[0-9][\x20().0-9-]+[0-9]
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TRIM = ".,;:!?\"'`()[]{}<>|#$%&*=_~^\\/-+"
_WORD = re.compile(r"\S+")
#: Most tokens of an identifier between the words of a pattern on both sides.
SLOT_TOKENS = 6
BLOCK_CHARS = 2_000_000
#: Longer words and identifiers go by a digest in the graph; texts are not cut.
_SHOWN = 64
_NEEDLES = 200
_ROWS_AT_ONCE = 500


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; places are code points, the end exclusive."""
    text = text or ""
    if not _SIGN.search(text):
        return []
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _name(word: str) -> str:
    return word if len(word) <= _SHOWN else hashlib.md5(word.encode("utf-8", "replace")).hexdigest()


def _plain(word: str) -> str:
    """A context word without the signs around it; empty for bare signs."""
    return _name(word.strip(_TRIM).lower())


def _words_before(text: str, end: int, count: int) -> list[str]:
    """The last `count` words before a place, the nearest last."""
    width = 96
    while True:
        left = max(0, end - width)
        parts = text[left:end].split()
        if left and not text[left - 1].isspace() and parts:
            parts = parts[1:]  # may be cut
        found = [w for p in parts if (w := _plain(p))]
        if len(found) >= count or not left:
            return found[-count:]
        width *= 4


def _words_after(text: str, start: int, count: int) -> list[str]:
    width = 96
    while True:
        right = start + width
        parts = text[start:right].split()
        if right < len(text) and not text[right].isspace() and parts:
            parts = parts[:-1]
        found = [w for p in parts if (w := _plain(p))]
        if len(found) >= count or right >= len(text):
            return found[:count]
        width *= 4


def _patterns(before: list[str], after: list[str]) -> list[str]:
    """Lexical patterns of a slot `_` between words: one or two before it, one or two after it, or one on each side."""
    out = []
    if before:
        out.append(f"{before[-1]} _")
        if len(before) > 1:
            out.append(f"{before[-2]} {before[-1]} _")
    if after:
        out.append(f"_ {after[0]}")
        if len(after) > 1:
            out.append(f"_ {after[0]} {after[1]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space that hold a digit or an at sign, with the signs around them."""
    at = 0
    while found := _SIGN.search(text, at):
        start = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = found.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        yield start, end


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the signs around it, but for a bracket whose other half is inside."""
    token = text[start:end]
    first = start + len(token) - len(token.lstrip(_TRIM))
    last = max(first, start + len(token.rstrip(_TRIM)))
    if first > start and text[first - 1] == "(" and text.count(")", first, last) > text.count("(", first, last):
        first -= 1
    return first, last


def _runs(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring tokens with a digit or an at sign, free of covered places and of the signs around."""
    at, run = 0, None
    for s, e in _signed_tokens(text):
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        free = not any(a < e and s < b for a, b in covered[at : at + 8])
        if run and (not free or text[run[1] : s].strip()):
            yield _trimmed(text, *run)
            run = None
        if free:
            run = (run[0], e) if run else (s, e)
    if run:
        yield _trimmed(text, *run)


def instances(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind, surface, patterns) of base spans and of other identifier-like runs (kind -1)."""
    text = text or ""
    if not _SIGN.search(text):
        return []
    found = [(s, e, k) for s, k, e in base]
    found += [(s, e, _UNSEEN) for s, e in _runs(text, sorted((s, e) for s, _, e in base)) if s < e]
    out = []
    for s, e, k in found:
        if p := _patterns(_words_before(text, s, 2), _words_after(text, e, 2)):
            out.append((s, e, k, _name(text[s:e].lower()), p))
    return out


class Slots:
    """Confident patterns, ready to find the slots they point to."""

    def __init__(self, patterns: list[str]):
        self.left, self.right, self.both = set(), set(), {}
        for p in patterns:
            if p.startswith("_ "):
                self.right.add(tuple(p[2:].split()))
            elif p.endswith(" _"):
                self.left.add(tuple(p[:-2].split()))
            else:
                first, last = p.split(" _ ")
                self.both.setdefault(first, set()).add(last)
        #: The longest word of each pattern; a text without any of them has no slot. Not used where there are many, or
        #: where a word may not stand in the lower-case text as it is: a digest, or one with a sigma, whose lower
        #: case depends on what follows.
        self.needles = sorted({max((w for w in p.split() if w != "_"), key=len) for p in patterns})
        plain = all(len(n) < 32 and not set(n) & {"σ", "ς"} for n in self.needles)
        self.needles = self.needles if plain and len(self.needles) <= _NEEDLES else None

    def may_find(self, text: str) -> bool:
        if self.needles is None:
            return True
        low = text.lower()
        return any(n in low for n in self.needles)

    def find(self, text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str]]:
        """(start, end, pattern, surface) of what stands in a slot and is no instance yet: off base spans, and not
        a single token with a digit or an at sign."""
        text = text or ""
        if not self.may_find(text):
            return []
        tokens = [(m.start(), m.end(), w) for m in _WORD.finditer(text) if (w := _plain(m[0]))]
        plain = ["", "", *[w for *_, w in tokens], "", ""]
        out: list[tuple[int, int, str, str]] = []

        def add(first: int, last: int, pattern: str) -> None:
            start, end = _trimmed(text, tokens[first][0], tokens[last][1])
            known = first == last and _SIGN.search(text, start, end)
            if not known and not any(a < end and start < b for a, _, b in base):
                out.append((start, end, pattern, _name(text[start:end].lower())))

        for i in range(1, len(tokens)):
            wanted = self.both.get(plain[i + 1])
            for last in range(i, min(i + SLOT_TOKENS, len(tokens) - 1)) if wanted else ():
                if plain[last + 3] in wanted:
                    add(i, last, f"{plain[i + 1]} _ {plain[last + 3]}")
                    break
        for i in range(len(tokens)):
            a, b, c, d = plain[i], plain[i + 1], plain[i + 3], plain[i + 4]
            for held, key in ((self.left, (b,)), (self.left, (a, b)), (self.right, (c,)), (self.right, (c, d))):
                if key in held:
                    add(i, i, f"{' '.join(key)} _" if held is self.left else f"_ {' '.join(key)}")
        return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,kind:int,surface:string,patterns:array<string>>>"


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some rows at a time, which bounds what a worker holds beside the texts."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS_AT_ONCE):
            yield batch.iloc[at : at + _ROWS_AT_ONCE].reset_index(drop=True)


def _scan(docs: DataFrame) -> DataFrame:
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            base = [base_spans(t) for t in batch["text"]]
            found = [instances(t, b) for t, b in zip(batch["text"], base)]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "version": batch["version"],
                    "base": [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base],
                    "found": [
                        [{"start": s, "end": e, "kind": k, "surface": x, "patterns": p} for s, e, k, x, p in f]
                        for f in found
                    ],
                }
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    return rows.mapInPandas(scanned, f"doc_id long, version long, base {_SPAN}, found {_FOUND}")


def confident_patterns(
    edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS
) -> DataFrame:
    """(pattern, kind, weight, size, confidence) after scoring the graph `edges` (pattern, surface, kind), whose rows are
    distinct; kind -1 marks unseen instances."""
    sizes = settle(edges.groupBy("pattern").agg(F.countDistinct("surface").alias("size")), "sizes")
    seeds = edges.where(F.col("kind") >= 0).select("pattern", "surface", "kind", F.lit(1.0).alias("score"))
    unseen = edges.where(F.col("kind") == _UNSEEN).select("pattern", "surface")
    scored, patterns = seeds, None
    for _ in range(rounds):
        weight = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"))
        strong = weight.where(F.col("weight") >= min_seeds).join(sizes, "pattern")
        strong = strong.withColumn("confidence", F.least(F.lit(1.0), F.col("weight") / F.col("size")))
        patterns = settle(strong.where(F.col("confidence") >= confidence), "patterns")
        # log1p keeps the product of the complements a sum, so it is combined before the shuffle.
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        reached = unseen.join(patterns, "pattern").groupBy("surface", "kind").agg((1 - F.exp(doubt)).alias("score"))
        scored = seeds.union(unseen.join(reached, "surface").select("pattern", "surface", "kind", "score"))
    return patterns


def slots_of(docs: DataFrame, patterns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, version, start, end, pattern, surface of the slots that patterns point to and that are no instances."""
    schema = "doc_id long, version long, start int, end int, pattern string, surface string"
    names = patterns.select("pattern").distinct()
    total = names.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = -(-total // block_chars)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    out = docs.sparkSession.createDataFrame([], schema)
    for number in range(blocks):
        block = names.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == number).collect()
        sent = docs.sparkSession.sparkContext.broadcast([r["pattern"] for r in block])

        def found(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            slots = Slots(sent.value)
            for batch in _slices(batches):
                hits = [
                    (doc_id, version, *hit)
                    for doc_id, text, version in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["version"])
                    for hit in (slots.find(text, base_spans(text)) if slots.may_find(text or "") else ())
                ]
                yield pd.DataFrame(hits, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

        out = out.union(rows.mapInPandas(found, schema))
    out = settle(out, "slots").withColumn("two", ~F.col("pattern").startswith("_ ") & ~F.col("pattern").endswith(" _"))
    # What stands between the words of a two-sided pattern is not taken by a one-sided one as well.
    wider = F.collect_set(F.when(F.col("two"), F.struct("start", "end"))).alias("wider")  # of one text
    by_text = out.groupBy("doc_id", "version").agg(wider).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "wider")
    both = out.join(by_text, F.expr("doc_id <=> d and version <=> v"))
    inside = F.exists("wider", lambda w: (w["start"] < F.col("end")) & (F.col("start") < w["end"]))
    return both.where(F.col("two") | ~inside).select(*[c.split()[0] for c in schema.split(", ")])


def find_spans(
    docs: DataFrame,
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    min_seeds: int = MIN_SEEDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, version (hash of the text), base and spans (arrays of start, kind, end), one row per row of docs."""
    rows = settle(_scan(docs), "scanned")
    seen = rows.select("doc_id", "version", F.explode("found").alias("i")).select("doc_id", "version", "i.*")
    seen = seen.withColumn("pattern", F.explode("patterns"))
    edges = settle(seen.select("pattern", "surface", "kind").distinct(), "edges")
    patterns = confident_patterns(edges, rounds, confidence, min_seeds).withColumnRenamed("kind", "as_kind")
    place = ["doc_id", "version", "start", "end"]
    hits = seen.where(F.col("kind") == _UNSEEN).join(patterns, "pattern").select(*place, "as_kind", "confidence")
    slots = settle(slots_of(docs, patterns, block_chars), "slots")
    more = slots.groupBy("pattern").agg(F.countDistinct("surface").alias("more"))
    wide = F.least(F.lit(1.0), F.col("weight") / (F.col("size") + F.col("more")))
    steady = patterns.join(more, "pattern").withColumn("confidence", wide).where(F.col("confidence") >= confidence)
    hits = hits.union(slots.join(steady, "pattern").select(*place, "as_kind", "confidence"))
    best = hits.groupBy(*place).agg(F.max(F.struct("confidence", (-F.col("as_kind")).alias("k"))).alias("b"))
    span = F.struct("start", (-F.col("b.k")).cast("int").alias("kind"), "end")
    added = best.groupBy("doc_id", "version").agg(F.collect_set(span).alias("added"))  # of one text
    joined = rows.alias("r").join(
        added.alias("a"), F.expr("r.doc_id <=> a.doc_id and r.version <=> a.version"), "left"
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return joined.select("r.doc_id", "r.version", "base", spans.alias("spans"))


def count_of(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(shown, ",")


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets, columns and rows unchanged.
    Where spans overlap, the first stays and what it covers of later ones goes with it."""
    found = find_spans(docs, **settings).where(F.size("spans") > 0)
    found = found.select("doc_id", "version", "spans").dropDuplicates(["doc_id", "version"])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(done, span):
        fresh = span["start"] >= done["at"]
        piece = F.substring(done["text"], done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.when(fresh, F.concat(done["out"], piece, F.get(names, span["kind"]))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
            done["text"].alias("text"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.col("d.text").alias("text"))
    told = F.aggregate(
        F.col("s.spans"), start, step, lambda x: F.concat(x["out"], F.substring(x["text"], x["at"] + 1, F.length(x["text"])))
    )
    joined = docs.alias("d").join(
        found.alias("s"), F.expr("d.doc_id <=> s.doc_id and xxhash64(d.text) = s.version"), "left"
    )
    text = F.when(F.col("s.spans").isNull(), F.col("d.text")).otherwise(told)
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
