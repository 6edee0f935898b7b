"""Hashing file contents on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.schemas import HASH_OUTCOMES, HASH_READ_CHUNK_BYTES, LIBRARIES_ROOT
from samebytes.sources import ship
from samebytes.sources.filetree import name_on_disk
from samebytes.sources.rows import record_batch

BYTES_PER_TASK = 8 * 1024**3


def _stat(path: str) -> tuple[int, int, int, int]:
    info = os.stat(path)
    return info.st_size, info.st_mtime_ns, info.st_ino, info.st_dev


def _hasher(algorithm: str):
    """SHA-256, or BLAKE3 where the optional `blake3` package is installed."""
    if algorithm == "sha256":
        return hashlib.sha256()
    if algorithm == "blake3":
        try:
            from blake3 import blake3
        except ImportError as error:
            raise ValueError("hashing with blake3 needs the blake3 package") from error
        return blake3()
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def _digest(path: str, algorithm: str, chunk: int) -> tuple[bytes, int]:
    """Digest of the whole file and the bytes read, in constant memory."""
    hasher, total = _hasher(algorithm), 0
    with open(path, "rb", buffering=0) as file:
        while block := file.read(chunk):
            hasher.update(block)
            total += len(block)
    return hasher.digest(), total


def _hash_one(
    path: str,
    root: str,
    expected: tuple[int, int],
    algorithm: str,
    chunk: int,
    libraries_root: str | None = None,
) -> tuple:
    """(outcome, digest, size, mtime_ns, inode, device, bytes, error) of one candidate.

    The file counts as hashed only if its size and time were the expected ones both before
    and after reading. A file outside its library, or a library outside `libraries_root`, is
    not opened. Whatever is wrong with one path fails that candidate alone.
    """
    nothing = (None, None, None, None)
    try:
        real_root = os.path.realpath(root, strict=True)
        if libraries_root is not None:
            top = os.path.realpath(libraries_root, strict=True)
            if real_root == top or os.path.commonpath([top, real_root]) != top:
                return "failed", None, *nothing, 0, "library lies outside the libraries root"
        real = os.path.realpath(path)
        if os.path.commonpath([real_root, real]) != real_root:
            return "failed", None, *nothing, 0, "candidate path escapes its library"
        if not os.path.isfile(real):
            return "missing", None, *nothing, 0, None
        before = _stat(real)
        if before[:2] != expected:
            return "requeued", None, *before, 0, None
        digest, count = _digest(real, algorithm, chunk)
        after = _stat(real)
        if after[:2] != expected:
            return "requeued", None, *after, count, None
        return "hashed", digest, *after, count, None
    except OSError as error:
        return "failed", None, *nothing, 0, error.strerror or str(error)
    except ValueError as error:
        return "failed", None, *nothing, 0, str(error)


def hash_files(
    candidates: DataFrame,
    *,
    algorithm: str = "sha256",
    chunk_bytes: int = HASH_READ_CHUNK_BYTES,
    bytes_per_task: int = BYTES_PER_TASK,
    libraries_root: str | None = LIBRARIES_ROOT,
) -> DataFrame:
    """Hash every candidate row of `with_root`; one outcome row per candidate.

    Tasks are sized by the bytes to read, and rows are dealt out by id so that a library of
    large files is spread. Only libraries under `libraries_root` are read; None
    lifts that. Write the result before using it twice: it reads the files.
    """
    _hasher(algorithm)
    ship(candidates.sparkSession)
    total = candidates.agg(F.coalesce(F.sum(F.col("expected_size") + 4096), F.lit(0))).first()[0]
    parallel = candidates.sparkSession.sparkContext.defaultParallelism
    tasks = max(parallel, -(-int(total) // bytes_per_task))

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (row["id"], *_hash_one(
                    name_on_disk(os.path.join(row["root_path"], row["relative_path"])),
                    name_on_disk(row["root_path"]),
                    (row["expected_size"], row["expected_mtime_ns"]),
                    algorithm,
                    chunk_bytes,
                    libraries_root,
                ))
                for row in batch.to_pylist()
            ]
            yield record_batch(rows, HASH_OUTCOMES)

    dealt = candidates.select(
        "id", "root_path", "relative_path", "expected_size", "expected_mtime_ns"
    ).repartition(tasks, F.xxhash64("id"))
    return dealt.mapInArrow(hash_batches, HASH_OUTCOMES)
