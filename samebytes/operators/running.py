"""Running state along sorted rows of a partition, an Arrow batch at a time.

Each function makes a pass for `ordered_slices`: it sees the batches of one slice in order, keeps what
the last row left behind, and adds columns that hold within the slice. What came before the slice is
added later, from one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal within a batch where values are, nulls being equal to one another."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _more(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _starts(codes: np.ndarray, goes_on: bool) -> np.ndarray:
    """Whether a row is the first one of its key; the first row of a batch may go on with the key before it."""
    starts = np.append(True, codes[1:] != codes[:-1])
    starts[0] = not goes_on
    return starts


def previous_rows(key: str, columns: dict[str, str]) -> Pass:
    """The values that `columns` (names by source) had in the row before, if it has the same key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            goes_on = last is not None and batch.column(key)[0].as_py() == last.column(key)[0].as_py()
            starts = pa.array(_starts(_codes(batch.column(key)), goes_on))
            added = {}
            for source, name in columns.items():
                column = batch.column(source)
                before = last.column(source) if last is not None else pa.nulls(1, column.type)
                shifted = pa.concat_arrays([before, column.slice(0, batch.num_rows - 1)])
                added[name] = pc.if_else(starts, pa.scalar(None, column.type), shifted)
            yield _more(batch, **added)
            last = batch.slice(batch.num_rows - 1)

    return work


def running_sum(value: str, name: str) -> Pass:
    """The sum of a column up to and including each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sums = total + np.cumsum(_numbers(batch, value))
            if len(sums):
                total = int(sums[-1])
            yield _more(batch, **{name: pa.array(sums, pa.int64())})

    return work


def _running_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The largest value so far within each segment, for rows whose segments are numbered in order."""
    known, place = np.unique(values, return_inverse=True)
    best = np.maximum.accumulate(segment * np.int64(len(known)) + place)
    return known[best - segment * len(known)]


def running_charge(key: str, arrival: str, charge: str, total: str, slack: str) -> Pass:
    """Per key the sum of charges (`total`), and the latest that any arrival lies behind the charges before it (`slack`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = (0, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            goes_on = last is not None and batch.column(key)[0].as_py() == last[0]
            starts = _starts(_codes(batch.column(key)), goes_on)
            segment = np.cumsum(starts) - starts[0]
            charges = _numbers(batch, charge)
            sums = np.cumsum(charges)
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            totals = sums - (sums[first] - charges[first])[segment]
            if goes_on:
                totals += np.where(segment == 0, before[0], 0)
            slacks = _running_max(_numbers(batch, arrival) - (totals - charges), segment)
            if goes_on:
                slacks = np.where(segment == 0, np.maximum(slacks, before[1]), slacks)
            before, last = (int(totals[-1]), int(slacks[-1])), (batch.column(key)[batch.num_rows - 1].as_py(),)
            yield _more(batch, **{total: pa.array(totals, pa.int64()), slack: pa.array(slacks, pa.int64())})

    return work
