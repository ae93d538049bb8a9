"""Language of texts and of each word in code-switched text, by a linear-chain conditional random field.

Words are runs of letters, lower-cased. A word's score for each language is the sum of learned weights of
its features: affixes (first and last one to three letters), groups of three letters inside the word with
its edges, and which languages' lexicons hold it. Learned transition weights score neighbouring labels.
Forward-backward gives each word's label probabilities; a text's language is the one with the largest mean
probability over all its words, and that mean is the score.

Whether a text is in any learned language is another question: a word is known if a lexicon holds it or training
texts hold all its letter groups, and the share of known words does not depend on the number of languages or on
how evenly a text mixes them. The least share is calibrated on the training texts, each left out of the others,
and is lower for short texts by CHANCE standard deviations of the share.

Training takes a bounded sample of labelled texts (`sample_docs`, texts of at most `sample_chars`
characters, chosen by a hash of the id) on the driver; everything else runs over whole texts in tasks.
Labels of words are those of their text; segments of texts in different languages are strung together so
that transitions are learned from changes of language too.

Forward and backward passes run over blocks of words side by side: the product of a block's transition
and score matrices carries messages from block to block, so a long text costs no long loop, and the
result is that of one pass over the whole text.

Edge cases. A null text or one without a letter: `und`, score 0. Without a labelled training text every
text is `und`. Ties go to the first language in alphabetical order. Repeated rows give repeated rows. A
row without doc_id is predicted, but neither trained on nor held out. Extra columns are ignored by
`predict`; `label_words` needs doc_id and text only. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SAMPLE_DOCS = 600
SAMPLE_CHARS = 20_000
LEXICON_WORDS = 2_000
LEXICON_MIN_COUNT = 3
BUCKET_BITS = 17
BLOCK = 128
EPOCHS = 3
BATCHES = 10
RATE = 0.3
DECAY = 1e-5
CALIBRATED = 0.95
UNKNOWN_MARGIN = 2
LEAST_UNKNOWN = 0.005
CHANCE = 4  # standard deviations by which the words of a short text may miss the share
_CHARS_AT_ONCE = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX32, _STEP = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BUCKET_BITS)
_EDGE = np.uint32(1)  # stands for a word's edge in affixes and letter groups


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """All words of some texts: code points of all, edged by a mark on both sides, and where words lie."""

    codes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray  # the text each word is from
    offset: np.ndarray  # code point at which the word starts in its text


def _lower(text: str) -> str:
    """Lower case with a letter for each letter, so that places in the text stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def find_words(texts: list[str | None]) -> Words:
    lower = [_lower(t or "") for t in texts]
    codes = np.frombuffer("\n".join(["", *lower, "", ""]).encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    first = np.concatenate(([1], 1 + np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))))
    text = np.searchsorted(first, start, side="right") - 1
    marked = np.where(letter, codes + np.uint32(2), _EDGE)
    return Words(marked, start, end - start, text, start - first[text])


def _bucket(seed: int, *parts: np.ndarray) -> np.ndarray:
    h = parts[0] + np.uint32(seed * 0x3C6EF372 & 0xFFFFFFFF)
    for p in parts[1:]:
        h *= _STEP
        h ^= p
    h *= _MIX32
    h ^= h >> np.uint32(15)
    h *= _STEP
    h >>= _SHIFT
    return h


def word_hash(words: Words) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    ends = words.start + words.length
    gaps = np.diff(np.concatenate(([0], words.start, [len(words.codes)])))
    place = np.arange(len(words.codes)) - np.repeat(np.concatenate(([0], words.start)), gaps)
    mixed = (words.codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))) * _MIX
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    return total[ends] - total[words.start]


def affix_buckets(words: Words) -> list[np.ndarray]:
    """Buckets of the first and last one, two and three letters (edges where the word is shorter)."""
    codes, start, last = words.codes, words.start, words.start + words.length - 1
    out = []
    for at, step, seed in ((start, 1, 11), (last, -1, 21)):
        a = codes[at]
        b = np.where(words.length > 1, codes[np.clip(at + step, 0, len(codes) - 1)], _EDGE)
        c = np.where(words.length > 2, codes[np.clip(at + 2 * step, 0, len(codes) - 1)], _EDGE)
        out += [_bucket(seed, a), _bucket(seed + 1, a, b), _bucket(seed + 2, a, b, c)]
    return out


def gram_buckets(words: Words) -> np.ndarray:
    """Buckets of the three letters that end at each place; those of a word are at its letters and the mark
    after them, and do not look beyond the mark before it."""
    codes = words.codes
    before = np.concatenate((codes[:1], codes[:-1]))
    second = np.concatenate((before[:1], before[:-1]))
    second[before == _EDGE] = _EDGE
    return _bucket(31, second, before, codes)


def _sums(values: np.ndarray, words: Words) -> np.ndarray:
    """Sum over each word's letters and the mark after them."""
    spans = np.column_stack((words.start, words.start + words.length + 1)).ravel()
    return np.add.reduceat(values, spans)[::2]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x feature buckets
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    holders: np.ndarray  # languages x words: which lexicon holds the word
    lexicon_weights: np.ndarray  # languages x languages
    seen: np.ndarray  # buckets of letter groups in training texts
    unknown_rate: float = 1.0  # calibrated share of unknown words that texts in learned languages may have

    def known(self, words: Words) -> np.ndarray:
        """Whether a lexicon holds each word, or training texts hold all its letter groups."""
        if not len(words.start):
            return np.zeros(0, bool)
        return (_sums((~self.seen)[gram_buckets(words)].astype(np.int64), words) == 0) | self.holds(words).any(axis=1)

    def holds(self, words: Words) -> np.ndarray:
        """words x languages: 1 where the language's lexicon holds the word."""
        out = np.zeros((len(words.start), len(self.languages)), np.float32)
        if len(self.lexicon) and len(out):
            hashes = word_hash(words)
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == hashes
            out[hit] = self.holders[at[hit]]
        return out

    def scores(self, words: Words) -> np.ndarray:
        """words x languages: sum of the weights of each word's features."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)), np.float32)
        out = self.holds(words) @ self.lexicon_weights
        affixes, grams = affix_buckets(words), gram_buckets(words)
        for j, weights in enumerate(self.weights):
            for b in affixes:
                out[:, j] += weights[b]
            out[:, j] += _sums(weights[grams], words)
        return out


def _blocks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most BLOCK words of one text: first word, length, text, place among the text's blocks."""
    size = np.bincount(text) if len(text) else np.zeros(0, np.int64)
    count = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(size) - size)[owner] + place * BLOCK
    return begin, np.minimum(BLOCK, size[owner] - place * BLOCK), owner, place


def marginals(scores: np.ndarray, text: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and the expected transitions between neighbouring words.
    `text` is the (ascending) text of each word; a text starts from a uniform label before its first word."""
    n, k = scores.shape
    if not n:
        return scores.astype(np.float64), np.zeros((k, k))
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    step = np.exp(transitions - transitions.max())
    begin, length, owner, place = _blocks(text)
    order = np.argsort(-length, kind="stable")
    begin, length, owner, place = begin[order], length[order], owner[order], place[order]
    live = [int(np.searchsorted(-length, -t)) for t in range(BLOCK)]  # blocks with more than t words

    def rescaled(x, axes):
        return x / x.sum(axis=axes, keepdims=True)

    product = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t in range(BLOCK):
        m = live[t]
        if m:
            product[:m] = rescaled((product[:m] @ step) * likely[begin[:m] + t][:, None, :], (1, 2))
    # Messages between the blocks of a text, all texts side by side.
    at = np.full((owner.max() + 1, place.max() + 1), -1)
    at[owner, place] = np.arange(len(begin))
    into = np.full((len(begin), k), 1 / k)
    back = np.full((len(begin), k), 1 / k)
    for p in range(1, at.shape[1]):
        here = at[:, p][at[:, p] >= 0]
        prior = at[owner[here], p - 1]
        into[here] = rescaled(np.einsum("nk,nkl->nl", into[prior], product[prior]), 1)
    for p in range(at.shape[1] - 2, -1, -1):
        later = at[:, p + 1][at[:, p + 1] >= 0]
        here = at[owner[later], p]
        back[here] = rescaled(np.einsum("nkl,nl->nk", product[later], back[later]), 1)
    forward = np.empty((n, k))
    message = into.copy()
    for t in range(BLOCK):
        m = live[t]
        if m:
            message[:m] = rescaled((message[:m] @ step) * likely[begin[:m] + t], 1)
            forward[begin[:m] + t] = message[:m]
    out, moves = np.empty((n, k)), np.zeros((k, k))
    message = back.copy()
    for t in range(BLOCK - 1, -1, -1):
        m = live[t]
        if not m:
            continue
        at_t = begin[:m] + t
        out[at_t] = rescaled(forward[at_t] * message[:m], 1)
        onward = likely[at_t] * message[:m]
        inner = at_t[(t > 0) | (place[:m] > 0)]
        if len(inner):
            sel = (t > 0) | (place[:m] > 0)
            joint = forward[inner - 1][:, :, None] * step * onward[sel][:, None, :]
            moves += rescaled(joint, (1, 2)).sum(axis=0)
        message[:m] = rescaled(onward @ step.T, 1)
    return out, moves


def _familiar(words: Words, texts: list[str]) -> tuple[np.ndarray, float]:
    """The buckets of the texts' letter groups, and the share of unknown words that a text in their
    languages may have: UNKNOWN_MARGIN times what CALIBRATED of the texts keep when left out of the others."""
    if not len(words.start):
        return np.zeros(1 << BUCKET_BITS, bool), 1.0
    grams, size = gram_buckets(words), words.length + 1  # the letters and the mark after them
    at = np.arange(size.sum()) + np.repeat(words.start - (np.cumsum(size) - size), size)
    copy = {t: i for i, t in reversed(list(enumerate(texts)))}  # equal texts count as one
    text = np.array([copy[t] for t in texts])[words.text]
    pairs = np.unique(np.repeat(text, size) << BUCKET_BITS | grams[at])
    held = np.bincount(pairs & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
    elsewhere = _sums((held < 2)[grams].astype(np.int64), words) == 0
    count = np.bincount(words.text)
    share = np.bincount(words.text, elsewhere)[count > 0] / count[count > 0]
    rate = max(1 - float(np.quantile(share, 1 - CALIBRATED)), LEAST_UNKNOWN)
    return held > 0, min(1.0, UNKNOWN_MARGIN * rate)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit the field by AdaGrad on the conditional log-likelihood of word labels."""
    languages = sorted(set(labels))
    k = len(languages)
    words = find_words(texts)
    label = np.array([languages.index(x) for x in labels], np.int64)[words.text] if len(texts) else np.zeros(0, np.int64)
    hashes = word_hash(words)
    # Lexicons: the frequent words of each language, where one language has most of their uses.
    names, inverse = np.unique(hashes, return_inverse=True)
    counts = np.zeros((len(names), k))
    np.add.at(counts, (inverse, label), 1)
    rates = counts / np.maximum(counts.sum(axis=0), 1)
    holders = np.zeros((len(names), k), np.float32)
    for j in range(k):
        top = np.argsort(-counts[:, j], kind="stable")[:LEXICON_WORDS]
        top = top[(counts[top, j] >= LEXICON_MIN_COUNT) & (rates[top, j] * 2 > rates[top].sum(axis=1))]
        holders[top, j] = 1
    held = holders.any(axis=1)
    model = Model(languages, np.zeros((k, 1 << BUCKET_BITS), np.float32), np.zeros((k, k)), names[held], holders[held], np.zeros((k, k), np.float32), *_familiar(words, texts))
    if k < 2 or not len(label):
        return model
    # Segments of 4 to 60 words, strung together across languages in a fixed random order.
    rng = np.random.default_rng(seed)
    cuts, at = [], 0
    change = np.append(np.flatnonzero(np.diff(words.text)) + 1, len(label))
    for end in change.tolist():
        while at < end:
            size = min(int(rng.integers(4, 61)), end - at)
            cuts.append((at, at + size))
            at += size
    affixes, triples, holds = affix_buckets(words), gram_buckets(words), model.holds(words)
    learned = {"w": model.weights, "t": model.transitions, "l": model.lexicon_weights}
    spread = {name: np.full_like(x, 1e-8, dtype=np.float64) for name, x in learned.items()}

    def move(x, name, gradient):
        gradient = gradient - DECAY * x * len(label) / BATCHES
        spread[name] += gradient**2
        x += (RATE * gradient / np.sqrt(spread[name])).astype(x.dtype)

    for _ in range(EPOCHS):
        rng.shuffle(cuts)
        for part in range(BATCHES):
            mine = cuts[part::BATCHES]
            if not mine:
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in mine])
            sequence = np.repeat(np.arange(len(mine)) // 6, [b - a for a, b in mine])  # six segments make a text
            y = label[rows]
            grams = np.concatenate([np.arange(s, s + n + 1) for s, n in zip(words.start[rows], words.length[rows])])
            gram_row = np.repeat(np.arange(len(rows)), words.length[rows] + 1)
            scores = holds[rows] @ model.lexicon_weights
            first = np.cumsum(words.length[rows] + 1) - words.length[rows] - 1
            for j, weights in enumerate(model.weights):
                scores[:, j] += sum(weights[b[rows]] for b in affixes)
                scores[:, j] += np.add.reduceat(weights[triples[grams]], first)
            p, moves = marginals(scores, sequence, model.transitions)
            wrong = -p
            wrong[np.arange(len(y)), y] += 1
            follows = sequence[1:] == sequence[:-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][follows], y[1:][follows]), 1)
            buckets = np.concatenate([b[rows] for b in affixes] + [triples[grams]])
            of = np.concatenate([np.arange(len(rows))] * len(affixes) + [gram_row])
            gradient = np.stack([np.bincount(buckets, w[of], 1 << BUCKET_BITS) for w in wrong.T])
            move(model.weights, "w", gradient)
            move(model.transitions, "t", seen - moves)
            move(model.lexicon_weights, "l", holds[rows].T @ wrong)
    return model


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list:
    """About sample_docs labelled texts, as many of each language, chosen by a hash of doc_id."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null")
    usable = usable.where(F.length("text") <= sample_chars).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return []
    each = sample_docs / len(counts)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))]), F.col("lang"))
    # Repeated rows share a place, so the rows are limited as well: the bound holds for any table.
    rows = usable.where(place < chance).orderBy("doc_id", "text", "lang").limit(2 * sample_docs)
    return rows.select("text", "lang").collect()


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the labelled rows that are not held out."""
    rows = training_sample(docs.where(~is_held_out()), sample_docs, sample_chars)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def _in_parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts with about a million characters together, so that a batch's arrays stay small."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHARS_AT_ONCE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def text_languages(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    names, best = [], []
    for _, part in _in_parts(texts):
        words = find_words(part)
        total = np.zeros((len(part), max(1, len(model.languages))))
        if model.languages:
            p, _ = marginals(model.scores(words), words.text, model.transitions)
            count = np.bincount(words.text, minlength=len(part))
            for j in range(p.shape[1]):
                total[:, j] = np.bincount(words.text, p[:, j], len(part)) / np.maximum(count, 1)
        top = total.max(axis=1)
        names += [model.languages[j] if s > 0 else UNKNOWN for j, s in zip(total.argmax(axis=1), top)]
        best += np.clip(top, 0, 1).tolist()
    return names, best


def known_shares(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The share of each text's words that the model knows (0 without words), and the least share that texts in
    learned languages have at their number of words."""
    shares, sizes = [], []
    for _, part in _in_parts(texts):
        words = find_words(part)
        count = np.bincount(words.text, minlength=len(part))
        shares += (np.bincount(words.text, model.known(words), len(part)) / np.maximum(count, 1)).tolist()
        sizes += np.maximum(count, 1).tolist()
    rate, size = model.unknown_rate, np.array(sizes, np.int64)
    return np.array(shares), 1 - rate - CHANCE * np.sqrt(rate * (1 - rate) / size)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets and the sample

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = text_languages(sent.value, batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    out = docs.select("doc_id", "text").mapInPandas(labelled, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, min_known: float | None = None) -> DataFrame:
    """The rows of docs in learned languages: at least min_known of their words are known (by default the
    calibrated share at the text's number of words); columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    learned = bool(model.languages)

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            shares, least = known_shares(sent.value, batch.column("text").to_pylist())
            keep = learned & (shares > 0) & (shares >= (least if min_known is None else min_known))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words in one language: doc_id, start and end (code points of the text), lang, n_words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for first, part in _in_parts(batch["text"].tolist()):
                words = find_words(part)
                if not len(words.start) or not sent.value.languages:
                    continue
                p, _ = marginals(sent.value.scores(words), words.text, sent.value.transitions)
                label = p.argmax(axis=1)
                turn = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                last = np.append(turn[1:], len(label)) - 1
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[first + words.text[turn]].to_numpy(),
                        "start": words.offset[turn],
                        "end": words.offset[last] + words.length[last],
                        "lang": np.array(sent.value.languages, object)[label[turn]],
                        "n_words": last - turn + 1,
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(runs, "doc_id long, start long, end long, lang string, n_words long")
