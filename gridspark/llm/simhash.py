"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most four bits differ in at most four bytes, so they share
at least ``8 - 4 = 4`` bytes at the same positions: the guaranteed minimum. A list per single positional byte
would hold 1/256 of all fingerprints, and pairing within it would grow with the square of the corpus. The index
therefore keeps its postings under *triples* of positional bytes: a set of 20 triples of positions such that any
four positions contain one of them, so a pair that reaches the minimum meets in at least one list of 1/2^24 of
the fingerprints. Inside a list the positional bytes that a pair shares are tallied, pairs below the minimum go,
and the rest are verified by the Hamming distance.

Groups of copies: equal fingerprints are one entry. Of a list only a spanning forest of its verified links is
emitted (one row less than it has entries), never all pairs. A list of more than ``LIST`` entries is not worked
on as a whole: as its pairs must share a fourth byte, its entries are dealt again under each of the five other
positions, and those finer lists are linked by other tasks.

Defined results: a null text is empty; an empty text has fingerprint zero and is linked like any other. Repeated
rows give repeated rows. A null identifier is never a component's name unless nothing else is there. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.graph import connected_components
from gridspark.llm.common import id_and_text, packed, runs, slices, texts
from gridspark.storage import write_table

SHINGLE = 4
SEED = 42
DISTANCE = 4
LIST = 1 << 15
PAIRWISE = 48


def byte_triples() -> list[tuple[int, int, int]]:
    """The fewest triples of eight positions that reach every four positions: three groups, one triple inside each
    group of three, and two of a group with one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [(*two, one) for g, after in zip(groups, groups[1:] + groups[:1], strict=True) for two in combinations(g, 2) for one in after]
    return [tuple(sorted(t)) for t in inside + across]


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text's word shingles; a bit is set if over half of the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, digest = (end - length).tolist(), xxhash.xxh64_digest
    stop, total, ones = end.tolist(), len(words) - size + 1, np.zeros(64, np.int64)
    for low in range(0, total, 1 << 16):  # long texts in slices, so that memory stays bounded
        high = min(total, low + (1 << 16))
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(start[low:high], stop[low + size - 1 : high + size - 1], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([simhash(t) for part in slices(batch) for t in texts(part)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.int64())], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark)``: the fingerprint's 64 bits as a signed number."""
    return id_and_text(docs).mapInArrow(_fingerprint_batches, "doc_id long, mark long")


def _byte(mark: str, position: int):
    return F.shiftrightunsigned(F.col(mark), 56 - 8 * position).bitwiseAND(F.lit(255))


def postings(marks: DataFrame) -> DataFrame:
    """``(mark, key)``: a row per fingerprint and triple; the key holds the triple's number and its three bytes."""
    keys = []
    for number, triple in enumerate(byte_triples()):
        key = F.lit(number << 24).cast("long")
        for place, position in enumerate(triple):
            key = key.bitwiseOR(F.shiftleft(_byte("mark", position), 16 - 8 * place))
        keys.append(key)
    return marks.select("mark", F.explode(F.array(*keys)).alias("key"))


def _near(marks: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification, of fingerprints against each other elementwise."""
    differ = marks ^ other
    by_byte = differ.reshape(-1, 1).view(np.uint8).reshape(-1, 8)
    enough = (by_byte == 0).sum(axis=1) >= 8 - distance
    enough[enough] = np.bitwise_count(differ[enough]) <= distance
    return enough


def _forest(marks: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of a list's links: whatever is reached leaves the list, so dense lists cost little."""
    links = []
    while marks.size:
        queue, marks = [marks[0]], marks[1:]
        while queue and marks.size:
            one = queue.pop()
            near = _near(marks, np.broadcast_to(one, marks.shape).copy(), distance)
            if near.any():
                hit, marks = marks[near], marks[~near]
                links.append((np.full(hit.size, one), hit))
                queue.extend(hit)
    return links


def _refined(key: int, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of a long list under each of the positions that its triple leaves out."""
    number = key >> 24
    for position in sorted(set(range(8)) - set(byte_triples()[number])):
        byte = (marks >> np.uint64(56 - 8 * position)) & np.uint64(255)
        yield marks, (np.uint64((number * 8 + position + 1) << 32) | np.uint64((key & 0xFFFFFF) << 8) | byte)


def _linker(distance: int, limit: int | None):
    """Rows ``(a, b, key)``: a link of two fingerprints, or an entry ``a`` for a finer list ``key``."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b=None, key=None):
            fill = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
            return pa.RecordBatch.from_arrays([fill(a), fill(b), fill(key)], ["a", "b", "key"])

        for keys, (marks,) in runs(batches, "key", ["mark"]):
            marks = marks.view(np.uint64)
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, keys.size])
            rest = np.repeat(size - 1, size) - (np.arange(keys.size) - np.repeat(start, size))  # entries after this one in its list
            at = np.flatnonzero((rest > 0) & (np.repeat(size, size) <= PAIRWISE))
            step = 1
            while at.size:  # short lists of all keys at once: entry against the entry ``step`` places on
                near = _near(marks[at], marks[at + step], distance)
                if near.any():
                    yield rows(marks[at[near]], marks[at[near] + step])
                step += 1
                at = at[rest[at] >= step]
            for k in np.flatnonzero(size > PAIRWISE):
                own = marks[start[k] : start[k] + size[k]]
                if limit and size[k] > limit:
                    for a, key in _refined(int(keys[start[k]]), own):
                        yield rows(a, key=key)
                elif links := _forest(own, distance):
                    yield rows(np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))

    return link


def near_links(marks: DataFrame, distance: int = DISTANCE, limit: int = LIST) -> DataFrame:
    """``(a, b)``: links that join all distinct fingerprints ``mark`` within ``distance`` bits of each other, directly or in steps."""
    if not 0 <= distance <= 4:
        raise ValueError("the triples cover distances of 0 to 4 bits")
    schema = "a long, b long, key long"
    dealt = lambda df: df.repartition("key").sortWithinPartitions("key", "mark")
    found = write_table(dealt(postings(marks)).mapInArrow(_linker(distance, limit), schema), "links")
    finer = dealt(found.where(F.col("key").isNotNull()).select(F.col("a").alias("mark"), "key").distinct()).mapInArrow(_linker(distance, None), schema)
    return found.where(F.col("b").isNotNull()).select("a", "b").union(finer.select("a", "b"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, mark, component_size``."""
    own = write_table(fingerprints(docs), "fingerprints")
    marks = write_table(own.groupBy("mark").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "marks")
    member = connected_components(near_links(marks.select("mark")), "a", "b").select(F.col("node").alias("mark"), "component")
    named = marks.join(member, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    named = write_table(named, "named")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("component_size"))
    by_mark = named.join(names, "component").select("mark", "component_id", "component_size")
    return own.join(by_mark, "mark").select(  # an often repeated fingerprint is one row on the right; adaptive execution splits its left side
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id", "mark", "component_size"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identifier names their component: one document of each group, with all its columns."""
    stay = near_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return packed(docs, _id=F.col("doc_id").cast("long")).join(stay, F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").select("_row.*")
