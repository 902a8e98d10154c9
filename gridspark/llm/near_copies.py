"""Near copies of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by SimHash first: a document's shingles give 256 bits, and the first 64 go through the index of operator 3
(postings under positional bytes, count filter, Hamming distance of at most four). A copy at 0.8 to 0.95 is mostly further
away, and no count of equal bytes is guaranteed at that distance, so what the index cannot reach is found by minima: a
document has 96 minima of its shingles under as many permutations, and 24 keys of four minima each. A pair at 0.8 shares a
key with probability 1 - (1 - 0.8^4)^24, over 0.99999. Inside a list the 256 bits leave out pairs that are far apart (0.8
gives 39 differing bits on average with a deviation of 6; the limit is 72; sets of under ``SMALL`` shingles have none), and
every candidate that is left, of both ways, is decided by the exact similarity.

Groups of copies: equal shingle sets are one entry. Lists of at most ``PAIRWISE`` entries give all their candidates. In a
longer one all entries are first compared with ``PIVOTS`` of them, which joins the copies of one text. A list that still
holds several components then gets its shingle sets, and every pair of two components in it is decided where the list
lies; only links that join two components leave the task, so rows grow with the entries and not with the pairs. The
comparisons of entries that stay apart do grow with the square of a list; a list of over ``BLOCK`` shingles is dealt in
blocks, and each pair of blocks is a group of its own, so that memory stays bounded.

Defined results: a null text is empty; empty texts are alike. A document of fewer than five words is one shingle. Of each
component of alike documents the row with the smallest identifier stays (null comes last; then the smaller hash of the
text); rows equal in identifier and text stay together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.graph import connected_components
from gridspark.llm.common import packed, runs, slices, texts
from gridspark.llm.simhash import near_links
from gridspark.storage import drop_table, write_table

SHINGLE = 5
LEAST = 0.8
SEED = 42
BANDS, ROWS = 24, 4
BITS = 72
SMALL = 64
PAIRWISE = 48
PIVOTS = 4
BLOCK = 1 << 21
WORDS = ["m0", "m1", "m2", "m3"]

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_WIDE = _random.integers(0, 1 << 63, 4, np.uint64) << np.uint64(1) | np.uint64(1)
_BAND_FACTORS = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, digest = (end - length).tolist(), xxhash.xxh64_intdigest
    stop = end[size - 1 :].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(start, stop)), np.uint64, len(stop)))  # noqa: B905


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def band_keys(own: np.ndarray) -> np.ndarray:
    """24 keys, each of four minima; long sets in slices, so that memory stays bounded."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, own.size, 2048):
        least = np.minimum(least, (own[None, low : low + 2048] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    keys = _mixed((_mixed(least.reshape(BANDS, ROWS)) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64))
    return keys


def wide_simhash(own: np.ndarray) -> np.ndarray:
    """256 bits as four numbers; a bit is set if over half of the hashes have it."""
    ones = np.zeros(256, np.int64)
    for low in range(0, own.size, 255):  # 255 ones fit a byte
        wide = _mixed(own[low : low + 255, None] * _WIDE[None, :])
        ones += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > own.size).view(np.uint64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, n, marks, keys = [], [], [], []
        for part in slices(batch):
            for text in texts(part):
                own = shingles(text)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(own.size)
                marks.append(wide_simhash(own))
                keys.append(band_keys(own))
        longs = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        marks = np.array(marks, np.uint64).reshape(-1, 4)
        flat = longs(np.array(keys, np.uint64).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        columns = [batch.column("doc_id"), batch.column("tag"), longs(np.array(node, np.uint64)), pa.array(n, pa.int64()), *(longs(marks[:, i]) for i in range(4)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "node", "n", *WORDS, "keys"])


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, tag`` (hash of the text), ``node`` (hash of the shingle set), ``n`` (its size), 256 bits and 24 keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text(docs)).alias("tag"), _text(docs).alias("text"))
    return rows.mapInArrow(_sketch_batches, "doc_id long, tag long, node long, n long, m0 long, m1 long, m2 long, m3 long, keys array<long>")


def _bits(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks ^ other).sum(axis=1, dtype=np.int64)


def _sizes_fit(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.minimum(n, other) >= LEAST * np.maximum(n, other)


def _near(marks: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits, and whether the similarity can be reached."""
    bits = _bits(marks, other)
    return bits, ((bits <= BITS) | (np.minimum(n, m) < SMALL)) & _sizes_fit(n, m)


def _pivot_pairs(marks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A long list's entries with some of them, as positions."""
    a, b = [], []
    for one in np.unique(np.linspace(0, len(n) - 1, PIVOTS).astype(np.int64)):
        found = np.flatnonzero(_near(marks, n, marks[one], n[one])[1])
        found = found[found != one]
        a.append(np.full(found.size, one))
        b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, (node, n, *words) in runs(batches, "key", ["node", "n", *WORDS]):
        marks = np.stack(words, axis=1).view(np.uint64)
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, keys.size])
        rest = np.repeat(size - 1, size) - (np.arange(keys.size) - np.repeat(start, size))  # entries after this one in its list
        at = np.flatnonzero((rest > 0) & (np.repeat(size, size) <= PAIRWISE))
        step = 1
        while at.size:  # short lists of all keys at once: entry against the entry ``step`` places on
            near = _near(marks[at], n[at], marks[at + step], n[at + step])[1]
            if near.any():
                yield _rows(node[at[near]], node[at[near] + step])
            step += 1
            at = at[rest[at] >= step]
        for k in np.flatnonzero(size > PAIRWISE):
            own = slice(start[k], start[k] + size[k])
            a, b = _pivot_pairs(marks[own], n[own])
            if a.size:
                yield _rows(node[own][a], node[own][b])


def _list_links(rows: pa.Table) -> pa.Table:
    """Links ``(a, b)`` that join different components of a list (or of two blocks of it), decided by the shingle sets.

    Every pair of two components has an end outside the largest one, so only those entries are compared with the others."""
    rows = rows.filter(pc.field("n") > 0)  # the empty set is one node and like no other
    node, n, component, block = (rows.column(c).to_numpy() for c in ("node", "n", "component", "block"))
    marks = np.stack([rows.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
    held, shingle = np.unique(rows.column("own").combine_chunks().flatten().to_numpy(), return_inverse=True)
    start, has = np.cumsum(n) - n, np.zeros(held.size, np.uint8)
    one_block = bool(rows.num_rows) and rows.column("low")[0] == rows.column("high")[0]
    _, place = np.unique(component, return_inverse=True)
    a, b = [], []
    for one in np.flatnonzero(place != np.bincount(place).argmax()).tolist() if place.size else []:
        near = _near(marks, n, marks[one], n[one])[1] & (place != place[one])
        found = np.flatnonzero(near if one_block else near & (block != block[one]))
        if not found.size:
            continue
        own = shingle[start[one] : start[one] + n[one]]
        has[own] = 1
        if found.size < 16:
            shared = np.array([has[shingle[start[x] : start[x] + n[x]]].sum(dtype=np.int64) for x in found.tolist()])
        else:
            shared = np.add.reduceat(has[shingle], start, dtype=np.int64)[found]
        has[own] = 0
        for other in found[shared >= LEAST * (n[one] + n[found] - shared) - 1e-9].tolist():
            if place[other] != place[one]:
                place[place == place[other]] = place[one]
                a.append(node[one])
                b.append(node[other])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _list_pairs(long: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between different components that a long list holds."""
    known = long.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = known.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    apart = lists.where("_low <> _high").select("key", F.greatest("blocks", F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = known.join(apart, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).join(sets, "node")
    chosen = dealt.select("key", "low", "high", "block", "node", "n", "component", *WORDS, "own")
    return chosen.groupBy("key", "low", "high").applyInArrow(_list_links, "a long, b long").distinct()


def entries(own: DataFrame) -> DataFrame:
    """One row per key and node."""
    return own.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node", "n", *WORDS)


def index_pairs(own: DataFrame) -> DataFrame:
    """``(a, b)``: nodes whose first 64 bits the index of positional bytes links; nodes of equal bits with the first of them."""
    nodes = own.select("node", F.col("m0").alias("mark")).distinct()
    first = write_table(nodes.groupBy("mark").agg(F.min("node").alias("first")), "marks")
    name = lambda end: first.select(F.col("mark").alias(end), F.col("first").alias(f"_{end}"))
    across = near_links(first.select("mark")).join(name("a"), "a").join(name("b"), "b")
    same = nodes.join(first, "mark").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return across.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).union(same)


def candidates(own: DataFrame) -> DataFrame:
    """``(a, b)``, each pair once: links of the index, and nodes that share a key and are not far apart (of long lists those with a pivot)."""
    dealt = entries(own).repartition("key").sortWithinPartitions("key", "node")
    return write_table(index_pairs(own).union(dealt.mapInArrow(_candidate_batches, "a long, b long")).distinct(), "candidates")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = pa.array([shingles(t).view(np.int64) for t in texts(part)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "own"])


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, alike)``: whether the exact similarity is ``LEAST`` or more."""
    left, right = sets.select(F.col("node").alias("a"), F.col("own").alias("_a")), sets.select(F.col("node").alias("b"), F.col("own").alias("_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_k", F.size(F.array_intersect("_a", "_b")))
    return both.select("a", "b", (F.col("_k") >= LEAST * (F.size("_a") + F.size("_b") - F.col("_k")) - 1e-9).alias("alike"))


def _sets_of(docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    chosen = own.groupBy("node").agg(F.min("tag").alias("tag")).join(nodes, "node", "left_semi")
    held = docs.select(F.xxhash64(_text(docs)).alias("tag"), _text(docs).alias("text")).join(chosen, "tag").dropDuplicates(["node"])
    return write_table(held.select("node", "text").mapInArrow(_set_batches, "node long, own array<long>"), "sets")


def components(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes that are alike to another one."""
    pairs = candidates(own)
    every = entries(own)
    many = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PAIRWISE).select("key")
    long = write_table(every.join(many, "key", "left_semi"), "long-lists")
    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select("b"))
    sets = _sets_of(docs, own, ends(pairs).union(long.select("node")).distinct())
    links = write_table(_decided(pairs, sets).where("alike").select("a", "b"), "links")
    member = connected_components(links, "a", "b")
    if not long.isEmpty():
        more = write_table(_list_pairs(long, member, sets), "list-links")
        if not more.isEmpty():
            member = connected_components(links.union(more), "a", "b")
        drop_table(more)
    for table in (pairs, links, sets, long):
        drop_table(table)
    return member


def drop_alike(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns."""
    own = write_table(sketches(docs), "sketches")
    member = components(docs, own)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    by_node = own.groupBy("node").agg(F.min(name).alias("name")).join(member, "node", "left")
    stay = by_node.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("name").alias("name"))
    stay = stay.select(F.col("name.doc_id").alias("_keep"), F.col("name.tag").alias("_kept"))
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _tag=F.xxhash64(_text(docs)))
    return rows.join(stay, (F.col("_tag") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").select("_row.*")
