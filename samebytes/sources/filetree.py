"""File trees as rows, through a Spark data source and a distributed walk.

Every row is one entry: a `file`, a visited `directory`, or an `error` that did not stop the
walk. Symbolic links and anything that is neither file nor directory are skipped, hidden
names and empty files are kept.
"""

from __future__ import annotations

import json
import os
import re
import stat
import time
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
)

from samebytes.operators.scale import materialize
from samebytes.schemas import TREE_ENTRIES
from samebytes.sources import ship
from samebytes.sources.rows import record_batch

Entry = tuple[str, str, str | None, int | None, int | None, int | None, int | None, str | None]

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Marks a byte of a name that is not UTF-8; the byte follows as two hexadecimal digits.
_MARK = "\ufffd"


def name_text(name: str) -> str:
    """A file name as valid text, a different one for every name.

    Bytes that are not UTF-8 become `_MARK` and two digits; the mark itself is doubled.
    """
    if _MARK not in name and name.isascii():
        return name
    out = (
        _MARK * 2 if c == _MARK else f"{_MARK}{ord(c) - 0xDC00:02X}" if "\udc80" <= c <= "\udcff" else c
        for c in name
    )
    return "".join(out)


def name_on_disk(text: str) -> str:
    """The name or path that `name_text` has written as text."""
    if _MARK not in text:
        return text

    def undo(match: re.Match) -> str:
        code = match[1]
        return _MARK if code == _MARK else chr(0xDC00 + int(code, 16))

    return re.sub(f"{_MARK}({_MARK}|[89A-F][0-9A-F])", undo, text)


def _message(error: OSError) -> str:
    return error.strerror or str(error)


def library_names(root: str) -> list[str]:
    """Real directories directly under the root, as text."""
    names = []
    with os.scandir(root) as entries:
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    names.append(name_text(entry.name))
            except OSError:
                continue
    return sorted(names)


def list_directory(
    root: str, library: str, relative: str, changed: tuple[int, int] | None = None
) -> Iterator[tuple[Entry, bool]]:
    """Entries of one directory, and for each whether it is a directory still to be visited.

    With `changed`, only files count that were made, written or moved after the first time and
    not after the second (nanoseconds of their change time). The directory itself must still be a real directory at its own path; a link put in its
    place meanwhile is not followed. Names are given and returned as text (`name_text`).
    """
    base = os.path.join(os.path.realpath(root), name_on_disk(library))
    path = os.path.join(base, name_on_disk(relative)) if relative else base

    def failure(where: str, error: OSError) -> tuple[Entry, bool]:
        return (library, "error", where, None, None, None, None, _message(error)), False

    yield (library, "directory", relative, None, None, None, None, None), False
    try:
        if os.path.realpath(path, strict=True) != path:
            if not relative:
                yield failure(relative, NotADirectoryError("library is not a directory of its own"))
            return
        entries = os.scandir(path)
    except OSError as error:
        yield failure(relative, error)
        return
    with entries:
        while True:
            try:
                entry = next(entries, None)
            except OSError as error:
                yield failure(relative, error)
                return
            if entry is None:
                return
            own = name_text(entry.name)
            name = f"{relative}/{own}" if relative else own
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError as error:
                yield failure(name, error)
                continue
            if stat.S_ISDIR(info.st_mode):
                yield (library, "pending", name, None, None, None, None, None), True
            elif stat.S_ISREG(info.st_mode) and (changed is None or changed[0] < info.st_ctime_ns <= changed[1]):
                yield (
                    (library, "file", name, info.st_size, info.st_mtime_ns,
                     info.st_ino, info.st_dev, None),
                    False,
                )


def walk(
    root: str, library: str, start: str, elsewhere: frozenset[str] = frozenset(),
    changed: tuple[int, int] | None = None,
) -> Iterator[Entry]:
    """Depth-first walk of one subtree, but for the directories that are read `elsewhere`."""
    stack = [start]
    while stack:
        for entry, descend in list_directory(root, library, stack.pop(), changed):
            if not descend:
                yield entry
            elif entry[2] not in elsewhere:
                stack.append(entry[2])


def subdirectories(root: str, library: str, relative: str) -> list[str]:
    """Real directories directly under one, as text; none if it cannot be read."""
    path = os.path.join(os.path.realpath(root), name_on_disk(library), name_on_disk(relative)).rstrip("/")
    try:
        if os.path.realpath(path, strict=True) != path:
            return []
        with os.scandir(path) as entries:
            names = [name_text(e.name) for e in entries if e.is_dir(follow_symlinks=False)]
    except OSError:
        return []
    return [f"{relative}/{name}" if relative else name for name in sorted(names)]


class _Subtrees(InputPartition):
    def __init__(self, starts: list[tuple[str, str]], elsewhere: frozenset[str] = frozenset()):
        super().__init__(tuple(starts))
        self.starts, self.elsewhere = starts, elsewhere


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.libraries = json.loads(options["libraries"]) if "libraries" in options else None
        self.splits = int(options.get("splits", "256"))
        self.only: set[str] | None = None
        self.start, self.top, self.kind = "", False, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Note what makes directories needless to read; Spark tests all filters again.

        A test of `library` leaves out the others, a prefix of `relative_path` is where the walk
        starts, and an empty `relative_path` asks for the libraries themselves, whose directory rows
        follow from the names under the root alone.
        """
        for test in filters:
            match test:
                case EqualTo(("library",), value):
                    self.only = {value} if self.only is None else self.only & {value}
                case In(("library",), values):
                    self.only = set(values) if self.only is None else self.only & set(values)
                case EqualTo(("relative_path",), ""):
                    self.top = True
                case EqualTo(("kind",), value):
                    self.kind = value
                case StringStartsWith(("relative_path",), value):
                    self.start = max(self.start, value.rpartition("/")[0], key=len)
            yield test

    def partitions(self) -> list[_Subtrees]:
        """Subtrees, split from the top until there are about `splits` of them.

        At most `splits` directories are listed here, and only names of directories are read. A
        directory with more subdirectories than that is split all the same: subtrees are then
        shared out evenly. The task of a directory that was split reads it again and walks
        whatever was not handed out, so directories that appear meanwhile are not lost.
        """
        names = library_names(self.root) if self.libraries is None else sorted(set(self.libraries))
        names = [name for name in names if self.only is None or name in self.only]
        if self.top:
            return [_Subtrees([(name, "") for name in names[i :: self.splits]]) for i in range(min(self.splits, len(names)))]
        open_ends = deque((name, self.start) for name in names)
        done: list[_Subtrees] = []
        for _ in range(self.splits):
            if not open_ends or len(open_ends) + len(done) >= self.splits:
                break
            library, relative = open_ends.popleft()
            below = subdirectories(self.root, library, relative)
            done.append(_Subtrees([(library, relative)], frozenset(below)))
            open_ends.extend((library, name) for name in below)
        rest = list(open_ends)
        return done + [_Subtrees(rest[i :: self.splits]) for i in range(min(self.splits, len(rest)))]

    def read(self, partition: _Subtrees) -> Iterator[Entry]:
        if self.top:
            for library, _ in partition.starts:
                if self.kind == "directory":
                    yield library, "directory", "", *[None] * 5
                else:
                    yield from (entry for entry, _ in list_directory(self.root, library, "") if entry[2] == "")
            return
        for library, start in partition.starts:
            yield from walk(self.root, library, start, partition.elsewhere)


class FileTreeStreamReader(DataSourceStreamReader):
    """Files by the time of their last change; an offset is a time.

    A batch holds the files that changed after its first and not after its last time, so what was
    seen once comes again only if it changes. Batches end `lag` seconds before now, so that files that are
    just being written, or clocks that differ by less, belong to a later one. A file that changes again before
    a batch is replayed comes in the later batch alone, with its newest state. Files that go are not noticed.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.lag = options, float(options.get("lag", "2"))

    def initialOffset(self) -> dict[str, int]:
        return {"ns": 0}

    def latestOffset(self) -> dict[str, int]:
        return {"ns": time.time_ns() - int(self.lag * 1e9)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_Changes]:
        between = (start["ns"], end["ns"])
        return [_Changes(part, between) for part in FileTreeReader(self.options).partitions()]

    def read(self, partition: _Changes) -> Iterator[Entry]:
        for library, start in partition.part.starts:
            entries = walk(self.options["path"], library, start, partition.part.elsewhere, partition.between)
            yield from (entry for entry in entries if entry[1] == "file")


class _Changes(InputPartition):
    def __init__(self, part: _Subtrees, between: tuple[int, int]):
        super().__init__((part, between))
        self.part, self.between = part, between


class FileTreeDataSource(DataSource):
    """`spark.read.format("filetree").option("path", root).load()`

    Filters on `library`, on a prefix of `relative_path` and on the libraries themselves save reading
    directories. Options: `path`, the folder that holds the libraries; `libraries`, a JSON list of names
    to walk instead of all; `splits`, about how many partitions to make (256).
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> T.StructType:
        return TREE_ENTRIES

    def reader(self, schema: T.StructType) -> FileTreeReader:
        return FileTreeReader(self.options)

    def streamReader(self, schema: T.StructType) -> FileTreeStreamReader:
        return FileTreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known, and let filters reach it unless the session says otherwise."""
    ship(spark)
    if spark.conf.get(_PUSHDOWN, None) is None:
        spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(FileTreeDataSource)


def read_tree(
    spark: SparkSession, root: str, libraries: list[str] | None = None, splits: int = 256
) -> DataFrame:
    """S2 and S3 through the data source; fine when subtrees near the top are balanced."""
    register(spark)
    reader = spark.read.format("filetree").option("path", root).option("splits", str(splits))
    if libraries is not None:
        reader = reader.option("libraries", json.dumps(libraries))
    return reader.load()


def changed_files(spark: SparkSession, root: str, lag_seconds: float = 2.0) -> DataFrame:
    """A stream of the files that were made, written or moved under the libraries of a root.

    Every batch walks the tree for their names and times; nothing of it is remembered but a time.
    """
    register(spark)
    return spark.readStream.format("filetree").option("path", root).option("lag", str(lag_seconds)).load()


def walk_tree(
    spark: SparkSession, root: str, libraries: list[str] | None = None, budget: int = 100_000
) -> DataFrame:
    """S2 and S3 for trees of any shape: tasks hand back what they did not get to.

    Each task walks its directories until it has seen `budget` entries and returns the rest
    as `pending` rows, which are spread over all tasks in the next round. A library or a
    subtree that holds most of the files is thus shared out after one round.
    """
    ship(spark)
    names = library_names(root) if libraries is None else sorted(set(libraries))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = 0, []
        for batch in batches:
            stack = [(row["library"], row["relative_path"]) for row in batch.to_pylist()]
            while stack:
                library, relative = stack.pop()
                if seen >= budget:
                    rows.append((library, "pending", relative, *[None] * 5))
                else:
                    for entry, descend in list_directory(root, library, relative):
                        seen += 1
                        if descend:
                            stack.append((library, entry[2]))
                        else:
                            rows.append(entry)
                        if len(rows) >= 10_000:
                            yield record_batch(rows, TREE_ENTRIES)
                            rows = []
        yield record_batch(rows, TREE_ENTRIES)

    # A fixed number of tasks: few short rows may stand for most of the tree.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spark.sparkContext.defaultParallelism, partitions)
    schema = "library string, relative_path string"
    frontier = spark.createDataFrame([(name, "") for name in names], schema)
    rounds = []
    while True:
        dealt = frontier.repartition(tasks, "library", "relative_path")
        found = materialize(dealt.mapInArrow(visit, TREE_ENTRIES))
        rounds.append(found.filter(F.col("kind") != "pending"))
        frontier = found.filter(F.col("kind") == "pending").select("library", "relative_path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
