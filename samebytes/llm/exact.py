"""Exact duplicates of texts by Grace hashing.

Records are dealt into buckets by a hash of their content, and each bucket goes through an
open-addressing table that compares complete contents. Spark's shuffle and its external sort are
the spill files of a level: a partition is sorted by bucket, and its task works on one bucket after
the other. The number of buckets follows from the measured bytes, so that a bucket fits its table.

A bucket that does not fit after all is not held: once the table is full, records of other contents
are written to a table in the shared folder, and the next level deals them anew with another seed. A
content that is in the table meets all of its records there, so every level settles some of them.

Equal contents are combined in the map tasks first, so a content that holds a third of all rows
arrives as a few records. Rows find their group by the digest of their content. Should two different
contents share a digest, tables notice it, and rows of that digest find their group by the content.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import Workspace, materialize, ship
from samebytes.operators.scale import lookup_join

#: Bytes of distinct contents that a table holds.
BUCKET_BYTES = 32 * 1024 * 1024
#: Bytes of digests that are kept; tests take fewer, so that different contents meet.
DIGEST_BYTES = 32

_FIRST_SLOTS = 1024
_FLUSH_BYTES = 4 * 1024 * 1024
_ENTRY_BYTES = 200  # besides the content


def later(a, b):
    """The larger of two ids; null is smaller than any."""
    return b if a is None else a if b is None or b < a else b


class ContentTable:
    """Distinct contents with the largest id and the number of rows of each.

    Open addressing with linear probing; two contents are one only if all their bytes are equal.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.slots = [-1] * _FIRST_SLOTS
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keeps: list = []
        self.counts: list[int] = []
        self.clashes: list[bool] = []

    def _grow(self) -> None:
        slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for entry, digest in enumerate(self.digests):
            slot = int.from_bytes(digest[:8]) & mask
            while slots[slot] >= 0:
                slot = (slot + 1) & mask
            slots[slot] = entry
        self.slots = slots

    def add(self, digest: bytes, content: bytes, keep, count: int, clash: bool) -> tuple[bool, bool]:
        """Combine a record with its entry, or make one. Tells whether it is in, and whether its digest clashes.

        A new content stays out once the table is full; an empty table takes any.
        """
        mask = len(self.slots) - 1
        slot = int.from_bytes(digest[:8]) & mask
        while (entry := self.slots[slot]) >= 0:
            if self.digests[entry] == digest:
                if self.contents[entry] == content:
                    self.keeps[entry] = later(self.keeps[entry], keep)
                    self.counts[entry] += count
                    self.clashes[entry] |= clash
                    return True, clash
                self.clashes[entry] = clash = True
            slot = (slot + 1) & mask
        if self.contents and self.bytes + len(content) + _ENTRY_BYTES > self.limit:
            return False, clash
        self.slots[slot] = len(self.contents)
        self.bytes += len(content) + _ENTRY_BYTES
        self.digests.append(digest)
        self.contents.append(content)
        self.keeps.append(keep)
        self.counts.append(count)
        self.clashes.append(clash)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True, clash

    def entries(self) -> Iterator[tuple]:
        return zip(self.digests, self.contents, self.keeps, self.counts, self.clashes, strict=True)


class _Out:
    """Rows as Arrow batches of a few MB."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if self.bytes > _FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
            )
            self.rows, self.bytes = [], 0


def _contents(batch: pa.RecordBatch, digest_bytes: int) -> Iterator[tuple]:
    """Id, digest and normalised content of every row, a slice at a time."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for key, text in zip(part.column("id").to_pylist(), texts, strict=True):
            content = (text or b"").lower()  # of bytes, only A-Z change
            yield key, sha256(content).digest()[:digest_bytes], content


def _records(rows: DataFrame, kind: str, limit: int, digest_bytes: int) -> DataFrame:
    """One record per content and some MB of a map task's distinct contents."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = ContentTable(limit), None
        for batch in batches:
            out = out or _Out(_record_schema(batch.schema.field("id").type))
            for key, digest, content in _contents(batch, digest_bytes):
                if not table.add(digest, content, key, 1, False)[0]:
                    for entry in table.entries():
                        yield from out.add(*entry)
                    table.clear()
                    table.add(digest, content, key, 1, False)
        if out:
            for entry in table.entries():
                yield from out.add(*entry)
            yield from out.flush()

    return rows.mapInArrow(combine, f"digest binary, content binary, keep {kind}, n bigint, clash boolean")


def _record_schema(kind: pa.DataType, *more: tuple) -> pa.Schema:
    fields = [("digest", pa.binary()), ("content", pa.binary()), ("keep", kind), ("n", pa.int64()), ("clash", pa.bool_())]
    return pa.schema(fields + list(more))


def _settle(records: DataFrame, kind: str, limit: int) -> DataFrame:
    """Contents of sorted buckets that have several rows or a digest in common, and records left over (`spilled`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, current = ContentTable(limit), None, None

        def settled():
            for digest, content, keep, n, clash in table.entries():
                if n > 1 or clash:
                    yield from out.add(digest, content if clash else None, keep, n, clash, False)

        for batch in batches:
            out = out or _Out(_record_schema(batch.schema.field("keep").type, ("spilled", pa.bool_())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(c).to_pylist() for c in ("bucket", "digest", "content", "keep", "n", "clash")]
                for bucket, digest, content, keep, n, clash in zip(*columns, strict=True):
                    if bucket != current:
                        yield from settled()
                        table.clear()
                        current = bucket
                    taken, clash = table.add(digest, content, keep, n, clash)
                    if not taken:
                        yield from out.add(digest, content, keep, n, clash, True)
        if out:
            yield from settled()
            yield from out.flush()

    columns = f"digest binary, content binary, keep {kind}, n bigint, clash boolean, spilled boolean"
    return records.mapInArrow(work, columns)


def _groups(rows: DataFrame, kind: str, limit: int, digest_bytes: int) -> DataFrame:
    """`digest`, `content` (where a digest clashes), `keep`, `n` and `clash` of contents with several rows."""
    spark = rows.sparkSession
    tables = Workspace(spark)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + _ENTRY_BYTES)).first()[0] or 0
    records, found, level = _records(rows, kind, limit, digest_bytes), [], 0
    while size:
        # Many small buckets share a partition evenly; more of them where the bytes ask for it.
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(16 * partitions, math.ceil(2 * size / limit))
        bucket = F.pmod(F.xxhash64(F.lit(level), "digest"), F.lit(buckets))
        dealt = records.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket")
        done = tables.write(_settle(dealt, kind, limit))
        found.append(done.filter("NOT spilled").drop("spilled"))
        records = done.filter("spilled").drop("spilled")
        size = records.agg(F.sum(F.octet_length("content") + _ENTRY_BYTES)).first()[0] or 0
        level += 1
    if not found:
        return records
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more)
    groups = materialize(groups)
    tables.drop()
    return groups


def exact_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES, digest_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """One row per row of `docs`: the id, `keep_id`, `group_size`, `kept` and `text_sha256`.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and empty
    texts equal each other. `keep_id` is the largest id of the group, `group_size` counts its rows,
    repeated ones too. A null id is smaller than any other; a group of rows without id has a null
    `keep_id`, and all its rows are kept. Rows that share the largest id are all kept, as they are one
    document. `text_sha256` is the digest of the normalised text in lower-case hex. Texts may be of
    any length: a task holds at most `bucket_bytes` of them, or one text. Other columns are left out,
    so their names do not matter. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    groups = _groups(rows, kind, bucket_bytes, digest_bytes)

    def digested(with_content: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fields = [("id", batch.schema.field("id").type), ("digest", pa.binary()), ("full", pa.binary())]
                out = _Out(pa.schema(fields + [("content", pa.binary())] * with_content))
                for key, digest, content in _contents(batch, 32):
                    yield from out.add(key, digest[:digest_bytes], digest, *[content] * with_content)
                yield from out.flush()

        return rows.mapInArrow(work, f"id {kind}, digest binary, full binary" + ", content binary" * with_content)

    plain = groups.filter("NOT clash").select("digest", "keep", "n")
    out = lookup_join(digested(False), plain, "digest", "left").select("id", "full", "keep", "n")
    clashing = groups.filter("clash").select("digest", "content", "keep", "n")
    if not clashing.isEmpty():
        # Different contents share a digest: their rows look for the content instead.
        shared = materialize(clashing.select("digest").distinct())
        alone = lookup_join(digested(False), shared, "digest", "left_anti")
        out = lookup_join(alone, plain, "digest", "left").select("id", "full", "keep", "n")
        compared = lookup_join(digested(True), shared, "digest", "left_semi")
        out = out.unionByName(compared.join(clashing, ["digest", "content"]).select("id", "full", "keep", "n"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"),
    )
