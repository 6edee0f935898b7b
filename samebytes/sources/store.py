"""Versioned snapshots of catalog tables, and bucketed tables for co-located work."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from samebytes.operators.scale import lookup_join
from samebytes.schemas import TABLES, UNIQUE_KEYS

#: Buckets of a table; more of them make a small change cheaper and a whole rewrite dearer.
BUCKETS = 64

_LOG = "version long, full boolean, bucket int, buckets int, path string, top_id long"
_BUCKET = "_bucket"


class SnapshotStore:
    """Tables under one folder; each publish writes a new version and then commits it.

    Tables with a unique key are stored in buckets by the hash of that key, each in a folder of
    its own. A version names the newest folder of every bucket, so a small change writes the
    buckets it touches (`replace`) and leaves all others where they are.

    Readers see the last committed version and are never disturbed: folders are written
    beside the others and become current by appending one file to the commit log. There
    is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """`buckets` holds for tables that this store publishes in full; 0 keeps them whole."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _log(self, table: str) -> str:
        return f"{self.root}/{table}/commits"

    def versions(self, table: str) -> DataFrame:
        """Committed folders by version. Only a log that does not exist counts as nothing published."""
        try:
            return self.spark.read.schema(_LOG).json(self._log(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def current_version(self, table: str) -> int:
        """0 when nothing was published."""
        return self.versions(table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folders(self, table: str, version: int | None = None) -> list[Row]:
        """The newest folder of each bucket, as of a version: as many rows as buckets."""
        log = self.versions(table).withColumn("full", F.coalesce("full", F.lit(True)))
        log = log.withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
        if version is not None:
            if log.filter(F.col("version") == version).isEmpty():
                raise LookupError(f"{table} has no version {version}")
            log = log.filter(F.col("version") <= version)
        base = log.filter("full").agg(F.max("version")).first()[0]
        if base is None:
            return []
        newest = F.max_by(F.struct("buckets", "path", "top_id"), "version").alias("f")
        rows = log.filter(F.col("version") >= base).groupBy("bucket").agg(newest)
        return rows.select("bucket", "f.*").orderBy("bucket").collect()

    def _count(self, table: str) -> int:
        """Buckets of the current version; 0 when it is stored whole or there is none."""
        return max((row.buckets or 0 for row in self._folders(table)), default=0)

    @staticmethod
    def bucket(table: str, buckets: int) -> Column:
        """Bucket of a row by its unique key."""
        keys = [F.col(k).cast(TABLES[table][k].dataType) for k in UNIQUE_KEYS[table]]
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(
        self, table: str, df: DataFrame, full: bool, buckets: int, touched: Iterable[int],
        cluster_by: list[str] | None, partition_by: list[str] | None = None,
    ) -> int:
        version = self.current_version(table) + 1
        path = f"{self.root}/{table}/data/{version:08d}-{uuid.uuid4().hex}"
        order = cluster_by or []
        if buckets:
            df = df.withColumn(_BUCKET, self.bucket(table, buckets)).repartition(_BUCKET)
            df.sortWithinPartitions(_BUCKET, *order).write.partitionBy(_BUCKET).parquet(path)
            # One row per bucket, from one column of what was written.
            written = self.spark.read.schema(f"id bigint, {_BUCKET} int").parquet(path)
            top = {r[_BUCKET]: r.top for r in written.groupBy(_BUCKET).agg(F.max("id").alias("top")).collect()}
            rows = [
                (version, full, b, buckets, f"{path}/{_BUCKET}={b}" if b in top else None, top.get(b))
                for b in sorted({*touched, *top})
            ]
        else:
            if partition_by:
                df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *order)
            elif order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            writer = df.write.partitionBy(*partition_by) if partition_by else df.write
            writer.parquet(path)
            rows = [(version, full, -1, 0, path, None)]
        commit = self.spark.createDataFrame(rows or [(version, full, -1, buckets, None, None)], _LOG)
        commit.coalesce(1).write.mode("append").json(self._log(table))
        return version

    def publish(
        self, table: str, df: DataFrame, cluster_by: list[str] | None = None,
        partition_by: list[str] | None = None,
    ) -> int:
        """Write a whole new version. `cluster_by` sorts it, so that equality filters on those
        columns skip almost all row groups, as an index would; `partition_by` puts the rows of a
        table without unique key in a folder and a file per value, which should be about as large
        as one another."""
        buckets = self.buckets if table in UNIQUE_KEYS and table in TABLES else 0
        return self._write(table, df, True, buckets, [], cluster_by, partition_by)

    def touched(self, table: str, rows: DataFrame) -> list[int] | None:
        """Buckets that rows with the table's unique key fall into; None if the table has no buckets."""
        buckets = self._count(table)
        if not buckets:
            return None
        found = rows.select(self.bucket(table, buckets).alias("bucket")).distinct().collect()
        return sorted(row.bucket for row in found)

    def replace(
        self, table: str, df: DataFrame, touched: list[int] | None, cluster_by: list[str] | None = None
    ) -> int:
        """A version in which the buckets in `touched` hold the rows of `df`, and no others change.

        None replaces the whole table, which then is stored in buckets.
        """
        buckets = self._count(table)
        if touched is None or not buckets:
            return self.publish(table, df, cluster_by)
        return self._write(table, df, False, buckets, touched, cluster_by)

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The current or an older version, or some buckets of it; an empty table when nothing was published."""
        folders = self._folders(table, version)
        if not folders and table not in TABLES:
            raise LookupError(f"{table} has no version")
        paths = [r.path for r in folders if r.path and (buckets is None or r.bucket in (*buckets, -1))]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        reader = self.spark.read
        return (reader.schema(TABLES[table]) if table in TABLES else reader).parquet(*paths)

    def changed(self, table: str, since: int) -> list[int] | None:
        """Buckets written after a version; None if the whole table was, or is not stored in buckets."""
        log = self.versions(table).filter(F.col("version") > since)
        if not log.filter(F.coalesce("full", F.lit(True))).isEmpty() or not self._count(table):
            return None
        return sorted(row.bucket for row in log.select("bucket").distinct().collect())

    def top_id(self, table: str) -> int:
        """The largest id of the current version, from the log if the table is stored in buckets."""
        folders = self._folders(table)
        if any(r.bucket == -1 and r.path for r in folders):
            return self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return max((r.top_id or 0 for r in folders), default=0)

    def retain(self, table: str, versions: int = 2) -> None:
        """Remove what none of the newest versions names; readers of older ones lose it."""
        current = self.current_version(table)
        kept: set[str] = set()
        for version in range(max(1, current - max(versions, 1) + 1), current + 1):
            kept.update(r.path for r in self._folders(table, version) if r.path)
        # As many paths as buckets and versions kept.
        named = self.spark.createDataFrame([(path,) for path in kept], "path string")
        gone = lookup_join(self.versions(table).select("path").filter("path IS NOT NULL").distinct(), named, "path", "left_anti")
        system = self.spark._jvm.org.apache.hadoop.fs
        for row in gone.toLocalIterator():
            path = system.Path(row.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """A metastore table bucketed and sorted by `keys`.

    Bucketed by (library_id, relative_path) the catalog side of a merge is not shuffled;
    bucketed by (hash_algorithm, content_hash) finding duplicate groups needs no shuffle.
    """
    writer = df.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys)
    writer.sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
