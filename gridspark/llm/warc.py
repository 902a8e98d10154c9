"""WARC records and their Merkle fixity audit.

An archive is one ordered row of records, each with its place (``pos``), byte offset and length; a record's leaf is the
SHA-256 of its bytes. ``FAN`` neighbouring nodes make a node of the level above: it covers the byte range from its
first to its last child, and its hash is over the children's hashes in order and that range. Two replicas are compared
at their roots; only below nodes whose hashes differ are children looked at, level by level, down to the records.

Records keep the place that the manifest (the leaves of the reference replica) gives them, so a lost or a longer
record leaves its neighbours' places alone. A record of a replica takes the place of an equal record with its identifier; what
is left of an identifier on both sides is paired in order of digests, and records that no place is left for come after the
last. Neither files nor partitions of a replica matter. Offsets come from a distributed running sum (range-partitioned parts, one
sum per part). A level is a map-side combined grouping of at most ``FAN`` rows a group, a level's table is 1/``FAN`` of
the one below, and a descent joins a level with the few mismatching parents.

Defined results: null columns of a page are empty in its record, a null identifier comes first. Repeated rows are
records of their own, told apart by number among those of one identifier and digest. An empty archive has no tree; two of them have no faults.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.scope import running_totals
from gridspark.storage import write_table

FAN = 16
CRLF = "\r\n"


def record(identifier: Column, url: Column, payload: Column) -> Column:
    """A resource record without the two line ends that close it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text(identifier), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), text(url)),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(text(payload)).cast("string")),
        F.lit(""),
        text(payload),
    ]
    return F.concat_ws(CRLF, *head)


def records(pages: DataFrame) -> DataFrame:
    """``page_id, row, record`` of ``page_id, url, html``; ``row`` tells repeated identifiers apart."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.monotonically_increasing_id().alias("row"),
        record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """WARC files under ``path``, one per partition."""
    records(pages).select("record").write.option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file, page_id, url, html, offset, length`` of the records of WARC files, cut by their Content-Length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, at, out = content.as_py(), 0, []
                while (stop := data.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
                    end = stop + 4 + int(fields[b"Content-Length"])
                    number = fields[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
                    out.append((name, int(number) if number else None, fields.get(b"WARC-Target-URI", b"").decode(), data[stop + 4 : end].decode(), at, end + 4 - at))
                    at = end + 4
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "page_id", "url", "html", "offset", "length"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, page_id long, url string, html string, offset long, length long")


def _leaf(found: DataFrame, *keep: str) -> DataFrame:
    """Digest and length in bytes of ``record`` with the two line ends after it."""
    whole = F.concat(F.col("record"), F.lit(CRLF * 2))
    return found.select(*keep, F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))


def manifest(found: DataFrame) -> DataFrame:
    """Leaves in the order of ``page_id``: ``page_id, row, pos, offset, length, digest``, places and offsets from 0."""
    leaves = _leaf(found, "page_id", "row")
    placed = running_totals(leaves, [], [("page_id", True), ("digest", True), ("row", True)], F.col("length"))
    return write_table(placed.select("page_id", "row", (F.col("_pos") - 1).alias("pos"), F.col("_before").alias("offset"), "length", "digest"), "manifest")


def _numbered(leaves: DataFrame, place: str, *of: str) -> DataFrame:
    """``_n``: the number of a leaf among those equal in ``of``, which follow each other in the order of ``place``."""
    keyed = leaves.withColumn("_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    first = keyed.groupBy(*of).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
    return keyed.join(first, list(of), "left").withColumn("_n", F.coalesce(F.col(place) - F.col("_first"), F.lit(0))).drop("_first")


def leaves_by(found: DataFrame, reference: DataFrame) -> DataFrame:
    """A replica's leaves at the places of the reference manifest; records without a place come after its last one."""
    equal, near = ["_id", "digest", "_n"], ["_id", "_n"]
    ours = write_table(_numbered(reference, "pos", "_id", "digest"), "ours")
    theirs = write_table(_numbered(manifest(found), "pos", "_id", "digest"), "theirs")
    columns = ["page_id", "row", "pos", "offset", "length", "digest"]
    place = ours.select(*equal, F.col("pos").alias("_to"), F.col("offset").alias("_at"))
    same = theirs.join(place, equal).withColumns({"pos": F.col("_to"), "offset": F.col("_at")}).select(*columns)

    def rest(one: DataFrame, other: DataFrame) -> DataFrame:
        left = one.join(other.select(*equal), equal, "left_anti").select(*columns)
        in_order = running_totals(left, [], [("page_id", True), ("pos", True)], F.col("length"))
        return write_table(_numbered(in_order, "_pos", "_id"), "rest")

    free, late = rest(ours, theirs), rest(theirs, ours)
    place = free.select(*near, F.col("pos").alias("_to"), F.col("offset").alias("_at"))
    paired = late.join(place, near, "left").drop("_pos", "_before")
    altered = paired.where("_to is not null").withColumns({"pos": F.col("_to"), "offset": F.col("_at")}).select(*columns)
    end = reference.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_end"), F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0)).alias("_stop"))
    added = running_totals(paired.where("_to is null").select(*columns), [], [("page_id", True), ("pos", True)], F.col("length"))
    added = added.crossJoin(F.broadcast(end)).withColumns({"pos": F.col("_end") + F.col("_pos") - 1, "offset": F.col("_stop") + F.col("_before")}).select(*columns)
    return write_table(same.unionByName(altered).unionByName(added), "leaves")


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels ``(pos, offset, stop, digest)``, leaves first and the root last."""
    level = leaves.select("pos", "offset", (F.col("offset") + F.col("length")).alias("stop"), "digest")
    levels = [level]
    for _ in range(height):
        child = F.struct("pos", "digest")
        level = level.withColumn("_up", F.floor(F.col("pos") / FAN)).groupBy("_up").agg(
            F.min("offset").alias("offset"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(child)).alias("_c")
        )
        inside = F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["pos"].cast("string"), c["digest"])), ",")
        digest = F.sha2(F.concat_ws("|", inside, F.col("offset").cast("string"), F.col("stop").cast("string")), 256)
        level = write_table(level.select(F.col("_up").alias("pos"), "offset", "stop", digest.alias("digest")), "level")
        levels.append(level)
    return levels


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """Faulty records of a replica: ``page_id, pos, offset, length, found_length, fault`` (``altered``, ``missing`` or ``extra``).

    ``reference`` and ``replica`` are leaves ``(page_id, pos, offset, length, digest)``.
    """
    last = max((x or 0 for df in (reference, replica) for x in df.agg(F.max("pos")).first()), default=0)
    height = 0
    while FAN**height <= last:
        height += 1
    ours, theirs = tree(reference, height), tree(replica, height)
    differing = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if differing is not None:
            parent = differing.select(F.col("pos").alias("_up"))
            a, b = (x.withColumn("_up", F.floor(F.col("pos") / FAN)).join(parent, "_up", "left_semi") for x in (a, b))
        a, b = a.select("pos", F.col("digest").alias("_a")), b.select("pos", F.col("digest").alias("_b"))
        differing = write_table(a.join(b, "pos", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("pos"), "differing")
    a = reference.join(differing, "pos", "left_semi").select("pos", "page_id", "offset", "length")
    b = replica.join(differing, "pos", "left_semi").select("pos", F.col("page_id").alias("_id"), F.col("offset").alias("_at"), F.col("length").alias("found_length"))
    fault = F.when(F.col("found_length").isNull(), "missing").when(F.col("length").isNull(), "extra").otherwise("altered")
    both = a.join(b, "pos", "full").withColumn("fault", fault)
    return both.select(F.coalesce("page_id", "_id").alias("page_id"), "pos", F.coalesce("offset", "_at").alias("offset"), "length", "found_length", "fault")
