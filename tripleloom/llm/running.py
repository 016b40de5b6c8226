"""Running sums within keys, in order, without gathering a key in one task.

Rows are dealt by ranges of (key, order), so a key with very many rows lies in several tasks. Each task sums what it
has; what earlier tasks hold of a task's first key is one row a task, and is added in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import shuffle_parts, stored

#: How a running column combines: sums, or exclusive or.
SUM, XOR = np.add, np.bitwise_xor


def segmented(values: np.ndarray, starts: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """Running combination that begins anew at every True of ``starts``; the first row begins one."""
    run = combine.accumulate(values)
    first = np.nonzero(starts)[0]
    before = np.zeros(len(first), values.dtype)
    before[1:] = run[first[1:] - 1]
    taken = np.repeat(before, np.diff(np.append(first, len(values))))
    return run - taken if combine is SUM else run ^ taken


def _local(batches: Iterator[pa.RecordBatch], key: str, columns: dict[str, tuple[str, np.ufunc]]) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId(), 0
    opening = last = None
    carry: dict[str, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        opening = keys[0] if opening is None else opening
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        length = int(np.argmin(np.concatenate([keys == keys[0], [False]])))
        made = []
        for name, (source, combine) in columns.items():
            run = segmented(batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64), starts, combine)
            if last == keys[0]:
                run[:length] = combine(run[:length], np.int64(carry[name]))
            carry[name] = int(run[-1])
            made.append(pa.array(run))
        last = keys[-1]
        at = np.arange(seen, seen + batch.num_rows)
        seen += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *made, pa.array(np.full(batch.num_rows, task), pa.int32()), pa.array(at), pa.array(keys == opening)],
            [*batch.schema.names, *columns, "_task", "_at", "_opening"],
        )


def _carried(batches: Iterator[pa.RecordBatch], carries: dict[int, dict[str, int]], columns: dict[str, tuple[str, np.ufunc]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tasks, opening = batch.column("_task").to_numpy(zero_copy_only=False), batch.column("_opening").to_numpy(zero_copy_only=False)
        out = batch
        for name, (_, combine) in columns.items():
            values = batch.column(name).to_numpy(zero_copy_only=False).copy()
            for task in np.unique(tasks[opening]).tolist() if opening.any() else ():
                where = opening & (tasks == task)
                values[where] = combine(values[where], np.int64(carries[task][name]))
            at = out.schema.get_field_index(name)
            out = out.set_column(at, name, pa.array(values))
        yield out.select([n for n in batch.schema.names if n not in ("_task", "_at", "_opening")])


def running(frame: DataFrame, key: str, order: list[Column], columns: dict[str, tuple[str, np.ufunc]], label: str) -> DataFrame:
    """``frame`` with running columns: name -> (source column, SUM or XOR), inclusive, per ``key``, in ``order``.

    ``key`` and sources are whole numbers without null; names that begin with ``_`` are not used in ``frame``. Sums wrap
    at 64 bits. The result is read from a stored table; the driver holds one row per task.
    """
    parts = shuffle_parts(frame.sparkSession)
    dealt = frame.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    made = T.StructType([*frame.schema.fields, *(T.StructField(name, T.LongType()) for name in columns)])
    held = T.StructType([*made.fields, T.StructField("_task", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_opening", T.BooleanType())])
    local = stored(dealt.mapInArrow(lambda batches: _local(batches, key, columns), held), label)
    ends = local.groupBy("_task").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), *(F.max_by(name, "_at").alias(f"end_{name}") for name in columns)
    )
    carries: dict[int, dict[str, int]] = {}
    last, held_over = None, dict.fromkeys(columns, 0)
    for row in sorted(ends.collect(), key=lambda r: r["_task"]):
        carries[row["_task"]] = dict(held_over) if row["first"] == last else dict.fromkeys(columns, 0)
        for name, (_, combine) in columns.items():
            end = np.array([row[f"end_{name}"]], np.int64)
            if row["first"] == row["last"]:
                end = combine(end, np.array([carries[row["_task"]][name]], np.int64))
            held_over[name] = int(end[0])
        last = row["last"]
    return local.mapInArrow(lambda batches: _carried(batches, carries, columns), made)
