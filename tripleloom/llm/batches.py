"""What the text operators share: slices of Arrow batches, words, stable hashes, stored intermediate tables.

Batches are cut into slices of a few megabytes of text, so memory in a task does not depend on how Spark cuts its
batches or on how long texts are (a single text is never cut).
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.session import remove_path, scratch_path

SLICE_BYTES = 4 << 20
#: Sorts before every document; stands for a null id inside the operators.
NO_ID = -(1 << 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    # Workers are used again: what Arrow holds in reserve would add to the next task's memory.
    pa.default_memory_pool().release_unused()


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as 64-bit integers; null becomes NO_ID."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def plain(column: pa.Array) -> pa.Array:
    """Texts as Arrow strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


class Words(NamedTuple):
    """Words of several texts in one array; text i has words ``starts[i]`` to ``starts[i + 1]``."""

    flat: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words in the order of their numbers."""
        coded = self.flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def joined(self) -> pa.Array:
        """Each text as its words with one space between them."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), self.flat), " ")


def words_of(texts: pa.Array) -> Words:
    """Maximal runs of anything but space and the characters 9 to 13."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    starts = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = starts - starts[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
    return Words(flat, starts)


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words, alike on every machine."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(word, seed) for word in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling sums below.
STEP = np.uint64(0x9E3779B97F4A7C15)


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values; shorter than the input by ``width`` - 1."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * STEP + values[j : j + n]
    return mixed(out)


def nested(docs: DataFrame, results: list[str], own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns named like results: the columns an operator works on and the caller's others in one,
    ``_row``, so that no name of theirs meets one of ours; and the expressions that give the caller's columns back."""
    docs = docs.drop(*results)
    others = [c for c in docs.columns if c not in own]
    row = [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others]).alias("_row")] if others else []
    return docs.select(*own, *row), [F.col(c) if c in own else F.col("_row").getField(c).alias(c) for c in docs.columns]


def extended(frame: DataFrame, added: str) -> T.StructType:
    """The schema of a frame with further columns behind; names inside structs need no quoting here."""
    return T.StructType([*frame.schema.fields, *T.StructType.fromDDL(added).fields])


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: read again, never computed again, safe from lost executors."""
    spark: SparkSession = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(frame.schema).parquet(path)
    _STORED[held] = path
    return held


_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for frame in frames:
        remove_path(frame.sparkSession, _STORED.pop(frame))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package's code to the executors, once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for file in sorted(root.rglob("*.py")):
            held.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
