"""What several operators share: folds, bounded samples, word patterns and lazy tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samebytes import sources
from samebytes.operators.scale import materialize, shared_folder

__all__ = ["fold", "hash_share", "materialize", "ship", "slices", "spread", "table", "without", "Workspace"]

#: Bytes of rows that go to a Python task at a time, unless the session says otherwise.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and send them texts some MB at a time."""
    sources.ship(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, to be worked on and handed on one by one."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables under a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of the key as text modulo `folds`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def hash_share(share: Column | float, seed: str, *keys: Column) -> Column:
    """True for about `share` of the rows, always the same ones. Used for bounded samples.

    Rows are told apart by all keys, so an id that many rows share is sampled like any other rows.
    """
    if not isinstance(share, Column):
        share = F.lit(float(share))
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)
    return place < share


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out evenly by keys that no large group shares, for costly work per row."""
    return df.repartition(*keys)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns but some, for passing extra columns through."""
    return [c for c in df.columns if c not in names]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this library has written, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables written to the shared folder by a loop, which drops them as it goes on.

    A checkpoint keeps the size estimate of its plan, and joins multiply estimates: in a loop of joins
    they grow without bound, and so does the time that planning takes. A table that is read again
    has its real size.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/loop-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove all tables; what is needed further has to be materialised before."""
        remove_folder(self.spark, self.folder)
