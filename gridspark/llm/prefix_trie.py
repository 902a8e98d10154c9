"""Prefix trie of conversations: what a cache of shared beginnings would save.

A node is a distinct sequence of first turns (role and text); the root is the empty one. Conversations are rebuilt first:
with a fresh start taken from the conversation that opens their hundred, so that beginnings are shared (``rebuilt``).

Method: a turn becomes a 128-bit hash with the number of its code points, and texts move no further. Conversations are
range partitioned by (turn hashes, identifier), so a shard holds one range of the sorted order, and copies of one
conversation may fill many shards. A shard gives its turns numbers in hash order and lexsorts padded matrices of them,
``PANEL`` turns at a time (rows that ended drop out, so long conversations do not widen the others). Masks of changed columns,
OR-ed from left to right, mark where nodes start; ``reduceat`` takes members, least identifiers and the sums of subtrees
for every depth. Only the nodes on the paths of a shard's first and last conversation can go on in a neighbour: they stay
open, and a tree of merges, ``FAN`` neighbours at a time, adds up equal ones and closes all that no longer lie on the
outer paths. A merge sees at most ``2 * FAN`` paths, however many conversations share a node.

``ends_sha256`` is a hash over all identifiers that end in a node, which no two tasks can share out. For open nodes shards
send their identifiers as one joined block each, and blocks are hashed as they stream by, in order.

Defined results: a null role or text is empty. Rows without ``conv_id`` belong to no conversation. Turns are in order of
``turn``, null first, and equal ones in order of their hashes. A conversation may be left without turns: it is a member of
the root. An empty table gives no rows. Other columns are not read. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.storage import drop_table, write_table

BLOCK = 100
HEADS = 6
PANEL = 16
FAN = 64
SHARD_TURNS = 500_000
LEAST_TURNS = 5_000  # a shard smaller than this is not worth a task

SUMS = "n_convs long, n_children long, n_leaves long, saved_tokens long"
NODE = f"open boolean, shard long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, {SUMS}"
SHARD = f"{NODE}, last_points long, on_first boolean, on_last boolean, ends_sha256 string, ends binary"
MERGED = f"{NODE}, last_points long, on_first boolean, on_last boolean"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as two hashes and a number of code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("n"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n"))))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """The first turns of the conversation that opens the block, then the own turns after as many."""
    base, h = F.col("conv_id") - F.col("conv_id") % BLOCK, head_length(F.col("conv_id"))
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    both = own.withColumn("_base", base).join(heads, "_base", "left")  # at most BLOCK conversations meet one opening
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.slice("_head", F.lit(1), h))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the pairs (a, b), equal for equal pairs."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def build(conv: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray, points: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Nodes of a shard, depth by depth, the root first: ``depth, parent, conv_id, n_convs, last_points``; the sorted order
    of its conversations; and the node in which each of them, in that order, ends."""
    order, node = np.arange(len(conv)), np.zeros(len(conv), np.int64)
    nodes = {k: [np.array([v], np.int64)] for k, v in (("depth", 0), ("parent", -1), ("conv_id", conv.min()), ("n_convs", len(conv)), ("last_points", 0))}
    known, low, at = 1, 0, order.copy()
    while True:
        rows = order[at]
        width = min(PANEL, int(length[rows].max()) - low)
        turn = np.zeros((len(at), width), np.int64)  # 0 where a conversation has ended, so that it comes before its continuations
        for w in range(width):
            has = np.flatnonzero(length[rows] > low + w)
            turn[has, w] = number[start[rows[has]] + low + w]
        by = np.lexsort((conv[rows], *turn.T[::-1], node[at]))
        rows, turn = rows[by], turn[by]
        order[at] = rows
        change = np.r_[True, node[at][1:] != node[at][:-1]]
        for w in range(width):
            change[1:] |= turn[1:, w] != turn[:-1, w]
            live = np.flatnonzero(turn[:, w])
            new = change[live]
            first = np.flatnonzero(new)
            held = rows[live]
            for name, x in (
                ("depth", np.full(first.size, low + w + 1)),
                ("parent", node[at[live[first]]]),
                ("conv_id", np.minimum.reduceat(conv[held], first)),
                ("n_convs", np.diff(np.r_[first, live.size])),
                ("last_points", points[start[held[first]] + low + w]),
            ):
                nodes[name].append(x)
            node[at[live]] = known + np.cumsum(new) - 1
            known += first.size
        low += width
        at = at[length[order[at]] >= low]
        if not (length[order[at]] > low).any():
            return {k: np.concatenate(v) for k, v in nodes.items()}, order, node


def add_up(nodes: dict[str, np.ndarray], closed: np.ndarray) -> None:
    """Give every closed node its finished sums and add them to its parent, the deepest nodes first.

    ``n_children``, ``n_leaves`` and ``saved_tokens`` hold what came from nodes closed before; an open node goes on with these.
    """
    depth, parent = nodes["depth"], nodes["parent"]
    by_depth = np.lexsort((parent, depth))
    ends = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=0) + 2))
    for d in range(int(depth.max(initial=0)), -1, -1):
        here = by_depth[ends[d] : ends[d + 1]]
        here = here[closed[here]]
        if not here.size:
            continue
        nodes["n_leaves"][here[nodes["n_children"][here] == 0]] = 1
        nodes["saved_tokens"][here] += (nodes["n_convs"][here] - 1) * nodes["last_points"][here]
        up = parent[here]
        if d:
            first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            nodes["n_children"][up[first]] += np.diff(np.r_[first, up.size])
            for name in ("n_leaves", "saved_tokens"):
                nodes[name][up[first]] += np.add.reduceat(nodes[name][here], first)


def path_to(node: int, parent: np.ndarray) -> list[int]:
    out = [node]
    while parent[out[-1]] >= 0:
        out.append(int(parent[out[-1]]))
    return out[::-1]


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])))]))
    if not table.num_rows:
        return
    turns = table.column("turns").combine_chunks()
    turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
    a, b, points = (turns.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
    conv = table.column("conv_id").to_numpy()
    length = np.diff(turns.offsets.to_numpy()).astype(np.int64)
    start = np.cumsum(length) - length
    nodes, order, end = build(conv, start, length, numbered(a, b), points)
    count = len(nodes["depth"])
    nodes |= {name: np.zeros(count, np.int64) for name in ("n_children", "n_leaves", "saved_tokens")}
    paths = [path_to(int(end[0]), nodes["parent"]), path_to(int(end[-1]), nodes["parent"])]
    on = np.zeros((2, count), bool)
    keys: dict[int, bytes] = {}
    for flags, path, row in zip(on, paths, (order[0], order[-1]), strict=True):
        flags[path] = True
        so_far = hashlib.sha256()
        for d, node in enumerate(path):
            if d:
                so_far.update(np.array([a[start[row] + d - 1], b[start[row] + d - 1]], "<i8").tobytes())
            keys[node] = so_far.digest()
    is_open = on.any(axis=0)
    add_up(nodes, ~is_open)
    by_end = np.argsort(end, kind="stable")  # identifiers rise within a node
    cut = np.searchsorted(end[by_end], np.arange(count + 1))
    ids = conv[order[by_end]].tolist()
    ended: dict[int, bytes] = {}
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        ended[k] = ",".join(map(str, ids[cut[k] : cut[k + 1]])).encode()
    parent = nodes["parent"]
    up = np.maximum(parent, 0)
    parent_open = is_open[up] & (parent >= 0)
    columns = {
        "open": pa.array(is_open),
        "shard": pa.array(np.full(count, TaskContext.get().partitionId(), np.int64)),
        "key": pa.array([keys.get(k) for k in range(count)], pa.binary()),
        "parent_key": pa.array([keys[p] if o else None for p, o in zip(up.tolist(), parent_open.tolist(), strict=True)], pa.binary()),
        "conv_id": pa.array(nodes["conv_id"]),
        "depth": pa.array(nodes["depth"]),
        "parent_conv_id": pa.array(nodes["conv_id"][up], mask=parent_open | (parent < 0)),
        **{name: pa.array(nodes[name]) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens", "last_points")},
        "on_first": pa.array(on[0]),
        "on_last": pa.array(on[1]),
        "ends_sha256": pa.array([None if o else hashlib.sha256(ended[k]).hexdigest() if k in ended else NO_ENDS for k, o in enumerate(is_open.tolist())], pa.string()),
        "ends": pa.array([ended.get(k) if o else None for k, o in enumerate(is_open.tolist())], pa.binary()),
    }
    out = pa.RecordBatch.from_pydict(columns)
    for low in range(0, count, 50_000):
        yield out.slice(low, 50_000)


def _merge(last_round: bool):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Equal open nodes of neighbouring shards become one; those off the outer paths are closed."""
        outer_first = set(rows.key[(rows.shard == rows.shard.min()) & rows.on_first])
        outer_last = set(rows.key[(rows.shard == rows.shard.max()) & rows.on_last])
        sums = {name: "sum" for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
        one = rows.groupby("key", as_index=False).agg({"parent_key": "first", "conv_id": "min", "depth": "first", "last_points": "first", **sums})
        place = {k: i for i, k in enumerate(one.key)}
        nodes = {name: one[name].to_numpy(np.int64).copy() for name in ("depth", "conv_id", "last_points", *sums)}
        nodes["parent"] = np.array([-1 if d == 0 else place[p] for d, p in zip(one.depth, one.parent_key, strict=True)], np.int64)
        on_first, on_last = (np.array([k in s and not last_round for k in one.key], bool) for s in (outer_first, outer_last))
        add_up(nodes, ~(on_first | on_last))
        out = {"open": on_first | on_last, "shard": rows.shard.min() // FAN, "key": one.key, "parent_key": one.parent_key, "conv_id": nodes["conv_id"], "depth": nodes["depth"]}
        out |= {"parent_conv_id": pd.array([None] * len(one), "Int64"), **{name: nodes[name] for name in sums}, "last_points": nodes["last_points"]}
        return pd.DataFrame(out | {"on_first": on_first, "on_last": on_last})

    return merge


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, shard): the hash of each key's blocks, joined by commas. One state is held at a time."""
    now, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, block in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(block.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "_ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "_ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``."""
    spark = conversations.sparkSession
    return trie_of(write_table(rebuilt(sequences(conversations)), "rebuilt"), 2 * spark.sparkContext.defaultParallelism)


def trie_of(found: DataFrame, least_shards: int) -> DataFrame:
    """The nodes of a written table of ``conv_id, turns``; small input is cut into up to ``least_shards`` shards."""
    total = found.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
    shards = max(math.ceil(total / SHARD_TURNS), min(least_shards, math.ceil(total / LEAST_TURNS)), 1)
    table = write_table(found.repartitionByRange(shards, "turns", "conv_id").mapInArrow(_shard_batches, SHARD), "shards")
    drop_table(found)
    level = table.where("open").drop("ends_sha256", "ends")
    last = table.agg(F.max("shard")).first()[0]
    finished = []
    while last is not None:
        merged = write_table(level.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(_merge(last < FAN), MERGED), "merged")
        finished.append(merged.where(~F.col("open")))
        level, last = merged.where("open"), last // FAN if last >= FAN else None
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = table.where(~F.col("open"))
    if not finished:
        return inside.select(columns)
    shared = finished[0]
    for more in finished[1:]:
        shared = shared.unionByName(more)
    blocks = table.where(F.col("ends").isNotNull()).select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    hashes = blocks.mapInArrow(_hash_blocks, "key binary, _ends string")
    shared = write_table(shared.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(NO_ENDS))), "shared")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    below = shared.select("parent_key", *columns).unionByName(inside.where(F.col("parent_key").isNotNull()).select("parent_key", *columns))
    under = below.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent"))
    return inside.where(F.col("parent_key").isNull()).select(columns).unionByName(under.select(columns))
