"""Best-fit packing by hierarchical residual packing.

Round 0: where the documents lie, each partition cuts its documents into pieces of at most ``length`` tokens and
packs the pieces best-fit, longest first. Bins with at most ``SLACK`` free tokens are done and never move again.
Each further round deals the underfull bins to fewer nodes of a tree and packs them there again, best-fit, with a
whole bin as one item; what is nearly full then is done, too. A node gets at most about ``NODE`` bins, whatever the
size of the corpus: the tree narrows by ``FAN`` a round down to one node, or to as many as that bound asks for, and
ends when a round at that width joins hardly any bins.

Only bins move, never texts. A bin holds at most ``length`` pieces, so its row is bounded.

Defined results: a null text is an empty one (its piece is the end id alone). Repeated rows are packed like others.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import id_and_text, slices, texts
from gridspark.llm.words import word_ids
from gridspark.storage import write_table

LENGTH = 4096
SLACK = 8
FAN = 8
NODE = 50_000
FLUSH = 1_000_000  # pieces that a task holds before it packs them
END_ID = 1
TOGETHER = 1 << 22  # bytes of text whose words are looked up together

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BIN = f"open boolean, fill int, members array<struct<{PIECE.replace(' ', ':')},offset:bigint>>".replace(",:", ",")
FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: longest items first, each into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free tokens
    free_mask, count = 0, 0  # bit f is set if a bin with f free tokens waits
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = free_mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            home = waiting[free].pop()
            if not waiting[free]:
                free_mask ^= 1 << free
        else:
            free, home = capacity, count
            count += 1
        bins[item] = home
        left = free - size
        if left:
            waiting[left].append(home)
            free_mask |= 1 << left
    return bins


def _as_bins(columns: list[np.ndarray], sizes: np.ndarray, bins: np.ndarray, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Bins as rows; ``columns`` and ``sizes`` are of pieces, ``bins`` says where each goes."""
    if not len(bins):
        return
    order = np.argsort(bins, kind="stable")
    sorted_bins, length = bins[order], sizes[order]
    first = np.flatnonzero(np.r_[True, sorted_bins[1:] != sorted_bins[:-1]])
    total = np.cumsum(length)
    before = total - length
    offset = before - np.repeat(before[first], np.diff(np.r_[first, len(order)]))
    fill = np.add.reduceat(length, first)
    parts = [c.take(pa.array(order)) for c in columns] + [pa.array(offset)]
    members = pa.StructArray.from_arrays(parts, [*FIELDS, "offset"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), members)
    whole = pa.RecordBatch.from_arrays([pa.array(capacity - fill > slack), pa.array(fill.astype(np.int32)), lists], ["open", "fill", "members"])
    for low in range(0, whole.num_rows, 5000):
        yield whole.slice(low, 5000)


def _pack_documents(vocabulary: str, capacity: int, slack: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()

        def flush(rows):
            columns = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(FIELDS, zip(*rows, strict=True), strict=True)]
            sizes = columns[3].to_numpy()
            return _as_bins(columns, sizes, best_fit(sizes, capacity), capacity, slack)

        rows: list[tuple] = []
        for batch in (part for whole in batches for part in slices(whole, TOGETHER)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.together(texts(batch)), strict=True):
                ids += end
                for piece, low in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[low : low + 4 * capacity]
                    rows.append((doc_id, piece, low // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= FLUSH:
                yield from flush(rows)
                rows = []
        if rows:
            yield from flush(rows)

    return pack


def _pack_bins(capacity: int, slack: int):
    """Rows come sorted by ``node``; each node's bins are packed as items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks()
            fill = table.column("fill").to_numpy().astype(np.int64)
            lists = table.column("members").chunk(0)
            members, count = lists.flatten(), lists.value_lengths().to_numpy()
            bins = np.repeat(best_fit(fill, capacity), count)
            columns = [members.field(n) for n in FIELDS]
            return _as_bins(columns, columns[3].to_numpy(), bins, capacity, slack)

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            node = batch.column("node").to_numpy()
            cuts = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)] if len(node) else np.zeros(1, int)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and node[low] != now:
                    yield from flush(held)
                    held = []
                now = node[low]
                held.append(batch.slice(low, high - low).select(["fill", "members"]))
        if held:
            yield from flush(held)

    return pack


def _tree(bins: DataFrame, width: int, capacity: int, slack: int, node: int) -> DataFrame:
    """Rounds over the underfull bins; all bins that are done, of all rounds."""
    done, now = [bins.where("not open")], bins.where("open")
    left = now.count()
    while left:
        width = max(-(-width // FAN), -(-left // node))
        dealt = now.withColumn("node", F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(width)))
        dealt = dealt.select("node", "fill", "members").repartition(width, "node").sortWithinPartitions("node")
        packed = write_table(dealt.mapInArrow(_pack_bins(capacity, slack), BIN), "bins")
        done.append(packed.where("not open"))
        now, before, left = packed.where("open"), left, packed.where("open").count()
        if width == 1 or (width == -(-before // node) and left > 0.99 * before):
            break
    done.append(now)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, slack: int = SLACK, node: int = NODE) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = id_and_text(docs)
    bins = write_table(rows.mapInArrow(_pack_documents(vocabulary, length, slack), BIN), "bins")
    done = _tree(bins, max(1, rows.rdd.getNumPartitions()), length, slack, node)
    numbered = done.select(F.monotonically_increasing_id().alias("sequence_id"), "members")  # before the bins are taken apart
    return numbered.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def piece_ids(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The real output beside the places: ``doc_id, piece, ids array<int>`` of every piece, to be joined on the first two."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        for batch in (part for whole in batches for part in slices(whole, TOGETHER)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.together(texts(batch)), strict=True):
                own = np.append(np.frombuffer(ids, "<u4"), END_ID).astype(np.int32)
                parts = [own[low : low + length] for low in range(0, len(own), length)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id] * len(parts), pa.int64()), "piece": pa.array(range(len(parts)), pa.int32()), "ids": pa.array(parts, pa.list_(pa.int32()))}
                )

    return id_and_text(docs).mapInArrow(cut, "doc_id long, piece int, ids array<int>")
