"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a prefix table.

For each prefix of a string the table holds the *last token* of the prefix's encoding. It is unique: of the pieces
that end there (found by an automaton over all pieces), it is the one that is compatible with the last token of the
prefix before it. Two tokens are compatible if merging their joined text gives just these two again. A row of tokens
in which all neighbours are compatible is the encoding of its text, so the ids are read off backwards from the end.
This takes one pass over the string, whatever its length, instead of a queue of merges.

Characters that are no piece become their bytes and part the string. A run of marks (the model's visible space)
starts no piece but one, so a text may be cut before such a run: the cuts are words, and a worker keeps the tokens of
the words it has met (bounded). Nothing depends on the cuts but speed.

Models that normalise text, drop spaces, or have user-defined or unused pieces are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm.common import id_and_text

MARK = "▁"
KEPT_WORDS = 700_000
KEPT_CHARS = 40
KEPT_PAIRS = 1_000_000


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:  # a parameter of the operator: the vocabulary is installed on every executor
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece.Type
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if not plain or proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("the prefix table is for merge-type models with byte fallback and no normalisation")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.text = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.length = [len(t) for t in self.text]
        self.letters = {t for t in self.id if len(t) == 1}
        if any(set(t) - self.letters for t in self.id) or any(MARK in t.lstrip(MARK) or (t[:2] == MARK * 2 and t.strip(MARK)) for t in self.id):
            raise ValueError("pieces of letters that are no pieces, or with marks inside, are not supported")
        self.unknown_letter = re.compile(f"([^{''.join(map(re.escape, sorted(self.letters)))}])")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if self.merged(t) == [i]:  # a piece that its own text does not give can be in no encoding
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[int]:
        """Plain merging, for the short strings of the compatibility test: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a string of known letters."""
        last, length, pairs = [-1] * (len(text) + 1), self.length, self.pairs
        for stop, token in self.automaton.iter(text):
            stop += 1
            if last[stop] < 0:
                start = stop - length[token]
                if start == 0:
                    last[stop] = token
                else:
                    before = last[start]
                    fits = pairs.get(before << 32 | token)
                    if fits or (fits is None and self.compatible(before, token)):
                        last[stop] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def _cut(self, text: str) -> tuple[int, ...]:
        """Ids of a string with marks for spaces."""
        out: list[int] = []
        for k, part in enumerate(self.unknown_letter.split(text)):
            if k % 2:
                out += [self.byte[b] for b in part.encode()]
            elif part:
                out += self._known(part)
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that follows one space. If its last letter fits behind the tokens of a known stem, they are
        the word's tokens: no other row has neighbours that are all compatible."""
        stem, tail = self.words.get(word[:-1]), self.id.get(word[-1:])
        if stem and tail is not None and self.compatible(stem[-1], tail):
            ids = (*stem, tail)
        else:
            ids = self._cut(MARK + word)
        if len(word) <= KEPT_CHARS:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids without an end id, as the library gives them."""
        out: list[int] = []
        if not text:
            return out
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            for cut in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)):
                out += self._cut(cut)
            return out
        known = self.words
        for word in text.split(" "):
            out += known.get(word) or self._word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, marks as spaces, the first space dropped, byte pieces read as UTF-8."""
        ids = [i for i in ids if i not in self.control]
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(_from_bytes(bytes(raw)))
                raw.clear()
            out.append(" ⁇ " if i == self.unknown else self.text[i])
        if raw:
            out.append(_from_bytes(bytes(raw)))
        if ids and out and ids[0] not in self.value and out[0].startswith(MARK):
            out[0] = out[0][1:]
        return "".join(out).replace(MARK, " ")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per worker process: its words and pairs serve the tasks that follow, too."""
    return PieceModel(path)


def _from_bytes(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids array<int>``: whole texts with an end id. A null text is an empty one; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            ids = [[*pieces.encode(t or ""), pieces.end] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            text = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Ids are decoded where they are made, by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces, library = piece_model(model), sentencepiece.SentencePieceProcessor(model_file=model)
        as_text = [str(i) for i in range(len(pieces.text))]
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                ids = pieces.encode(t.as_py() or "")
                ids.append(pieces.end)
                listed = hashlib.sha256(" ".join(map(as_text.__getitem__, ids)).encode())
                rows.append((len(ids), listed.hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
            n, listed, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
