"""Word-wise use of a ``tokenizers`` file whose normaliser and splitter never join what white space parts."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words whose ids a worker keeps (two generations of that many), and bytes up to which a word is worth keeping:
#: memory is bounded by their product.
KEPT_WORDS = 350_000
KEPT_BYTES = 40
#: Marks that end a word; behind a letter they are a token of their own to the splitter.
STOPS = b".,"


#: Below this, letters are whole (nothing to compose) and have one small form each, but for the one with a dot above.
LATIN_END = "\u0250"
NO_SMALL = "\u0130"
#: Byte-level vocabularies show a byte as itself if it is a printable Latin-1 character, and the others from U+0100 on.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
PRINTABLE = {b: chr(0x100 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _small_latin(text: str) -> bool:
    return text.isalpha() and max(text) < LATIN_END and text == text.lower() and NO_SMALL not in text


#: What keeps a text from being normalised as a whole: letters beyond, and brackets, which may be a special token.
_ODD = re.compile("[\u0130<\u0250-\U0010ffff]")
#: A run of stops at a word's end, behind a letter or a digit; the looked-for mark comes first, as texts are scanned for it.
_STOPS_BEHIND = re.compile(r"[.,](?<=[^\W_][.,])[.,]*(?=[\x20\t-\r]|\Z)")
_STOPS_BEHIND_ASCII = re.compile(rb"[.,](?<=[a-z0-9][.,])[.,]*(?=[\x20\t-\r]|\Z)")
#: A private character, put between words that are encoded in one call: its ids mark where a word ends.
BETWEEN = "\ue000"


def _normal(text: bytes) -> bytes | None:
    """A text in small letters with stops set apart, if that can be done at once."""
    if text.isascii():
        return None if b"<" in text else _STOPS_BEHIND_ASCII.sub(rb" \g<0>", text.lower())
    wide = text.decode()
    return None if _ODD.search(wide) else _STOPS_BEHIND.sub(r" \g<0>", wide.lower()).encode()


def _bytes(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordIds:
    """Ids of whole texts as little-endian 32-bit numbers.

    Texts are cut at 0x20 and 0x09-0x0D, which are white space to the tokenizer as well: it parts words there, drops
    the space, and neither composes nor merges across it. So a text's ids are its words' ids in a row, and a word is
    encoded once per worker for as long as it is in use: a word that was met since the last change of generation
    stays. Latin words are looked up in small letters, and full stops and commas behind a letter apart, since the
    normaliser and the splitter do the same: for whole texts where nothing stands against it, else word by word.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Words of small Latin letters alone go to the model as normaliser and splitter would hand them over."""
        merge, out = self.tokenizer.model.tokenize, {}
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters alone, and such a word is in small letters where it was normalised
                if w.islower():
                    out[w] = _bytes([t.id for t in merge(w.decode())])
            elif not w.isascii() and _small_latin(w.decode()):
                out[w] = _bytes([t.id for t in merge(w.decode("latin-1").translate(PRINTABLE))])
        rest = [w for w in words if w not in out]
        for low in range(0, len(rest), 1024):
            out.update(self._encode_together(rest[low : low + 1024]))
        return [out[w] for w in words]

    def _encode_together(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Any words, as one text; one by one if a word has the private character."""
        wide = [w.decode() for w in words]
        encode = self.tokenizer.encode_batch_fast
        if any(BETWEEN in w for w in wide):
            yield from ((w, _bytes(x.ids)) for w, x in zip(words, encode(wide, add_special_tokens=False), strict=True))
            return
        between, found = (x.ids for x in encode([BETWEEN, f" {BETWEEN} ".join([*wide, ""])], add_special_tokens=False))
        numbers = array("I", found)
        if sys.byteorder == "big":
            numbers.byteswap()
        ids, size = np.frombuffer(numbers.tobytes(), "<u4"), len(between)
        at = np.flatnonzero(np.all([ids[i : len(ids) - size + 1 + i] == x for i, x in enumerate(between)], axis=0)).tolist()
        low = 0
        for w, high in zip(words, at, strict=True):
            yield w, ids[low:high].tobytes()
            low = high + size

    def _known(self, words: set[bytes]) -> set[bytes]:
        """Words still to be learnt; what the old generation knows is taken over."""
        missing = words - self.young.keys()
        again = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        return missing - again

    def _learn(self, words: set[bytes]) -> None:
        missing = self._known(words)
        parted: dict[bytes, tuple[bytes, bytes]] = {}
        for w in missing:
            end = w.rstrip(STOPS)
            text = end.decode()
            if text[-1:].isalpha() and max(text) < LATIN_END and "<" not in text and NO_SMALL not in text:
                stem = text.lower().encode()
                if stem != w:
                    parted[w] = (stem, w[len(end) :])
        new = list(self._known({x for both in parted.values() for x in both if x}) | (missing - parted.keys()))
        self.young.update(zip(new, self._encode(new), strict=True))
        young = self.young
        young.update((w, young[stem] + (young[tail] if tail else b"")) for w, (stem, tail) in parted.items())

    def together(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of some texts, whose words are looked up at once (a few megabytes: see ``common.slices``)."""
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, {w: ids for w, ids in self.young.items() if len(w) <= KEPT_BYTES}
        normal = [_normal(t) for t in texts]
        split = [(t if plain is None else plain).split() for t, plain in zip(texts, normal, strict=True)]
        plain = set().union(*(w for w, t in zip(split, normal, strict=True) if t is not None))
        odd = set().union(*(w for w, t in zip(split, normal, strict=True) if t is None))
        new = list(self._known(plain))
        self.young.update(zip(new, self._encode(new), strict=True))
        self._learn(odd)
        different = plain | odd
        own = {w: self.young[w] for w in different}  # a small table: most of it stays in the processor's cache
        for words in split:
            yield b"".join(map(own.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One per worker process: its words serve the tasks that follow, too."""
    return WordIds(vocabulary)
