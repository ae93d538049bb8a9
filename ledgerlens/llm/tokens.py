"""Token ids of whole texts as little-endian unsigned 32-bit bytes, by a public tokenizer file.

A word-end BPE of the tokenizers library never looks across white space, so the ids of a text are those
of its pieces between ASCII white space, one after another. Texts repeat their words: each worker keeps
the ids of pieces and of words it has met. A piece of plain Latin letters, digits and signs is cut into
words here and each new word goes to the library's model; any other piece goes through the library's
whole chain of normalizer, splitter and model. A text that may hold an added token goes there whole, as
such tokens are looked for before letters are lower-cased."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Pieces and words that a worker keeps. A full store takes no more, which costs time only; the frequent
#: words are in it by then. Longer entries are not kept.
KEEP_ENTRIES = 300_000
KEEP_LENGTH = 48

_IDS = [struct.Struct(f"<{n}I") for n in range(32)]
_PLAIN = re.compile(r"[!-~¡-ÿ]+")
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: What the tokenizer file's splitter does, for lower-case text of the plain set.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        """Ids of one lower-case word of plain letters, one digit, or a run of plain signs."""
        spelled = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return _IDS[len(ids)].pack(*ids) if len(ids) < len(_IDS) else struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return self._word(piece)
        text = piece.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        words = [w.encode() for w in _WORDS.findall(text.lower())]
        return b"".join([self._known(w, self._word) for w in words])

    def _known(self, piece: bytes, ids_of) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = ids_of(piece)
            if len(piece) <= KEEP_LENGTH and len(self.known) < KEEP_ENTRIES:
                self.known[piece] = found
        return found

    def __call__(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        low = raw.lower()  # touches ASCII only, which the tokenizer lower-cases itself
        if any(token in low for token in self.added):
            return self._whole(raw.decode("utf-8"))
        pieces = low.split()
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for at, found in enumerate(ids):
                if found is None:
                    ids[at] = self._known(pieces[at], self._piece)
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    return Encoder(path)
