"""Substring dedup by level-wise doubling of repeated word windows.

Wanted are the windows of ``size`` words whose word sequence also starts in a document with a smaller identifier.
Lengths go from a short one up to ``size``, each at most twice the one before (13 words: 7, 13). At each level
the windows of that length are compared over all documents, and only those that repeat in another document are
extended to the next length; it ends when nothing repeats.

The first level need not look at all windows: of the short windows inside a window of ``size`` words the one with
the least hash is its *anchor*. Equal windows have equal anchors at equal places, so a window whose anchor does not
repeat does not repeat. For 7 in 13 words about a quarter of the positions are anchors. At a middle level the
window that starts at the anchor (moved left if it would overlap the end) stands for it; at the last level it is
the window itself.

Hot passages: a task first compares its own windows. Of equal windows it sends on only those of its smallest
document; what is already settled (a copy of something in a smaller document of the same task) goes along under a
key of its own. So however many documents share a passage, a key gets at most a document per task. Lower levels know
a row by a hash of its identifier and text (in place of the document), so rows that share an identifier, or have none,
each take up their own positions only. The last level
compares 128 bits (two independent 64-bit sums over independent word hashes); the lower ones 64, as a chance hit
there only means a needless extension.

Defined results: a null text has no words. A null identifier is larger than any other. Rows that repeat an
identifier are documents of that identifier: none is smaller than the other. Fewer words than ``size`` are never
removed. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import id_and_text, packed, texts
from gridspark.storage import write_table

SIZE = 13
SHORTEST = 8
NO_ID = 2**63 - 1
TOGETHER = 1 << 22  # bytes of text whose words are hashed together
FLUSH = 3_000_000  # windows that a task holds before it compares them

#: Odd multipliers of the sums, one for each place in a window: the same in every task of every run.
_RANDOM = np.random.Generator(np.random.Philox(20_240_229))
FACTORS = _RANDOM.integers(0, 2**63, (2, 1024), np.uint64) * np.uint64(2) + np.uint64(1)


def lengths(size: int = SIZE) -> list[int]:
    """Lengths of the levels: ``size`` halved (rounded up) until it is short."""
    out = [size]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w, seed) for w in words]), ">u8").astype(np.uint64)


def _sums(hashes: np.ndarray, at: np.ndarray | None, length: int, row: int) -> np.ndarray:
    """Hash of the windows that start at ``at`` (None: everywhere)."""
    count = len(hashes) - length + 1
    total = np.zeros(count if at is None else len(at), np.uint64)
    for j in range(length):
        total += FACTORS[row, j] * (hashes[j : j + count] if at is None else hashes[at + j])
    total ^= total >> np.uint64(32)  # low bits of a sum depend on low bits alone: mix before the least is sought
    total *= np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    return total


class _Level:
    """Windows of one level in one task. ``before``: the level's predecessor length, None for the first."""

    def __init__(self, size: int, length: int, before: int | None):
        self.size, self.length, self.before, self.last = size, length, before, length == size

    def windows(self, docs: list[tuple[int, bytes, np.ndarray | None]]):
        """``(document number, position, hash, second hash)`` of the windows to compare, as arrays."""
        split = [t.split() for _, t, _ in docs]
        words = [w for s in split for w in s]
        ends = np.cumsum([len(s) for s in split])
        starts = ends - [len(s) for s in split]
        if len(words) < self.size:
            return None
        owner = np.repeat(np.arange(len(docs)), ends - starts)
        whole = np.flatnonzero(ends[owner] - np.arange(len(words)) >= self.size)  # windows inside one document
        if not whole.size:
            return None
        hashes = _word_hashes(words, 0)
        inner = lengths(self.size)[0]
        if inner == self.size:
            anchor = whole
        else:
            small = _sums(hashes, None, inner, 0)
            view = np.lib.stride_tricks.sliding_window_view(small, self.size - inner + 1)
            anchor = whole + np.concatenate([view[whole[i : i + 500_000]].argmin(axis=1) for i in range(0, len(whole), 500_000)])
        if self.before is not None:
            found = np.zeros(len(words) + 1, bool)
            for start, end, (_, _, at) in zip(starts, ends, docs, strict=True):
                found[start + at[at < end - start]] = True
            whole, anchor = (x[found[np.minimum(anchor, whole + self.size - self.before)]] for x in (whole, anchor))
        at = np.unique(np.minimum(anchor, whole + self.size - self.length))
        if not at.size:
            return None
        second = _sums(_word_hashes(words, 1), at, self.length, 1) if self.last else np.zeros(len(at), np.uint64)
        return owner[at], at - starts[owner[at]], _sums(hashes, at, self.length, 0), second

    def compared(self, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """What goes on: of equal windows those of the smallest document, and the others as settled runs of positions."""
        order = np.lexsort((at, tag, doc, b, a))
        doc, tag, at, a, b = (x[order] for x in (doc, tag, at, a, b))
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(new) - 1
        first = doc[np.flatnonzero(new)][group]
        settled = doc != first
        shared = np.zeros(group[-1] + 1, bool)
        shared[group[settled]] = True
        send = ~settled
        parts = [(a[send], b[send], doc[send], tag[send], at[send], np.ones(send.sum(), np.int64), np.zeros(send.sum(), bool) if self.last else shared[group[send]])]
        if settled.any():
            d, t, p = doc[settled], tag[settled], at[settled]
            order = np.lexsort((p, t, d))
            d, t, p = d[order], t[order], p[order]
            begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)])
            own = (d[begin].astype(np.uint64) * FACTORS[0, 0]) ^ (p[begin].astype(np.uint64) * FACTORS[1, 0])  # settled rows need no company
            parts.append((own, own, d[begin], t[begin], p[begin], np.diff(np.r_[begin, len(p)]), np.ones(len(begin), bool)))
        a, b, doc, tag, at, n, sure = (np.concatenate(x) for x in zip(*parts, strict=True))
        span = n.astype(np.int64) << 32 | at.astype(np.int64)  # position, length of the run and the flag (as the sign) in one number
        columns = {"a": a.view(np.int64), "doc": doc, "span": np.where(sure, ~span, span)}
        if self.last:
            columns |= {"b": b.view(np.int64), "tag": tag}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def schema(self) -> str:
        return "a long, doc long, span long" + (", b long, tag long" if self.last else "")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            ids = (batch.column("doc_id").fill_null(NO_ID) if self.last else batch.column("row")).to_numpy()
            tags = batch.column("tag").to_numpy()
            found = batch.column("found") if self.before is not None else None
            text = texts(batch)
            low, size = 0, 0
            for i, t in enumerate(text):
                size += len(t)
                if size < TOGETHER and i < len(text) - 1:
                    continue
                docs = [(k, text[k], found[k].values.to_numpy() if found is not None else None) for k in range(low, i + 1)]
                if got := self.windows(docs):
                    owner, at, a, b = got
                    held.append((ids[low + owner], tags[low + owner], at, a, b))
                    count += len(at)
                low, size = i + 1, 0
                if count >= FLUSH:
                    yield from self._flush(held)
                    held, count = [], 0
        if held:
            yield from self._flush(held)

    def _flush(self, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows = self.compared(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for low in range(0, rows.num_rows, 100_000):
            yield rows.slice(low, 100_000)


def _open_span(df: DataFrame) -> DataFrame:
    """``at``, ``n`` and ``sure`` from their common column."""
    span = F.when(F.col("span") < 0, F.bitwise_not("span")).otherwise(F.col("span"))
    return df.withColumns({"sure": F.col("span") < 0, "at": span.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), "n": F.shiftright(span, 32).cast("int")}).drop("span")


def _tagged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, a hash of the text, which tells rows apart that share an identifier, and a hash of both."""
    return id_and_text(docs).withColumn("tag", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "tag"))


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc, tag, cuts)``: per document (``doc``: its identifier, or ``NO_ID``) the runs ``array<struct<at,n>>`` of
    positions at which a window of ``size`` words starts that also starts in a document with a smaller identifier."""
    if not 1 <= size <= FACTORS.shape[1]:
        raise ValueError(f"windows have 1 to {FACTORS.shape[1]} words")
    rows, before = _tagged(docs), None
    for length in lengths(size):
        level = _Level(size, length, before)
        if before is not None:
            each = F.transform(F.collect_set(F.struct("at", "n")), lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))
            found = repeats.groupBy("doc").agg(F.flatten(each).alias("found"))  # noqa: F821
            source = rows.join(found, F.col("row") == F.col("doc")).select("doc_id", "tag", "row", "text", "found")
        else:
            source = rows
        sent = source.mapInArrow(level, level.schema())
        equal = Window.partitionBy("a", "b") if level.last else Window.partitionBy("a")
        smallest = sent.withColumn("_min", F.min("doc").over(equal))
        if level.last:
            hit = _open_span(smallest).where(F.col("sure") | (F.col("doc") > F.col("_min"))).select("doc", "tag", "at", "n")
        else:
            smallest = smallest.withColumn("_max", F.max("doc").over(equal))
            hit = _open_span(smallest).where(F.col("sure") | (F.col("_max") > F.col("_min"))).select("doc", "at", "n")
        repeats = write_table(hit, "windows")
        before = length
    return repeats.groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n")).alias("cuts"))  # equal rows send the same


def _covered(count: int, cuts, size: int) -> np.ndarray:
    edge = np.zeros(count + 1, np.int64)
    for at, n in cuts:
        edge[at] += 1
        edge[min(count, at + n + size - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _join_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    own = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (rows["tag"] == cuts["tag"])
    return rows.join(cuts, own, "left")


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(texts(batch), batch.column("cuts"), strict=True):
                words = text.split()
                gone = 0
                if cuts.is_valid:
                    flat = cuts.values
                    mask = _covered(len(words), zip(flat.field("at").to_pylist(), flat.field("n").to_pylist(), strict=True), size)
                    gone = int(mask.sum())
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                else:
                    kept = words
                out.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n_words, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _join_cuts(_tagged(docs), repeated_windows(docs, size))
    return joined.select("doc_id", "text", "cuts").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _without(text: bytes, cuts, size: int) -> str:
    """The text without its covered words; each goes with the white space before it, the rest stays as it is."""
    import re

    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    gone = _covered(len(spans), cuts, size).tolist()
    out, last, first = [], 0, True
    for (low, high), drop in zip(spans, gone, strict=True):
        if not drop:
            out.append(text[low if first and last else last : high])
            first = False
        last = high
    out.append(text[last:] if not first else b"")
    return b"".join(out).decode()


def cut_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with its columns and all its rows; ``text`` loses the repeated words, ``n_chars`` (if there) follows."""

    @F.arrow_udf("string")
    def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = [
            _without(t.as_py().encode(), zip(c.values.field("at").to_pylist(), c.values.field("n").to_pylist(), strict=True), size) if c.is_valid else None
            for t, c in zip(text, cuts, strict=True)
        ]
        return pa.array(out, pa.string())

    base = packed(docs, doc_id=F.col("doc_id").cast("long"), tag=F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = _join_cuts(base, repeated_windows(docs, size)).select("_row", "cuts")
    rows = rows.withColumn("_new", without(F.when(F.col("cuts").isNotNull(), F.col("_row.text")), "cuts"))
    new = {"text": F.coalesce("_new", "_row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
