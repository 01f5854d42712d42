"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import cut, shared_dir  # noqa: F401  cut is for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession) -> str:
    """The shared folder as a URI; a path without a scheme is of Spark's default file system, as Spark takes it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_of(name: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, at_once: int = 2000) -> DataFrame:
    """Run a helper over Arrow batches of the only column ``text`` and the key columns before it.

    ``make`` is called once per task and returns ``rows -> rows``: it gets the batch's columns as lists,
    and returns the output columns as lists. ``at_once`` rows, not partitions, are what is in memory.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at_once):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(work([c.to_pylist() for c in part.columns]), out, strict=True)], schema=out)

    return df.mapInArrow(run, fields)


def cells(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset).tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


_SPACES = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])


def split_words(content: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of UTF-8 texts, as divided by the six ASCII spaces: (number of each word in turn, the different ones, how many
    each text has). The different ones may have spaces after them, so that one word can have several numbers."""
    data, ends = b"".join(content), np.cumsum([len(c) for c in content])
    white = _SPACES[np.frombuffer(data, np.uint8)]
    start = ~white
    start[1:] &= white[:-1]
    sizes = np.array([len(c) for c in content], np.int64)
    first = (ends - sizes)[sizes > 0]
    start[first] = ~white[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.int64), [], np.zeros(len(content), np.int64)
    offsets = np.append(starts, len(data))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(), cells(words.dictionary), np.diff(np.searchsorted(starts, np.append(0, ends)))


_held: dict = {}


def held(key, make: Callable):
    """What a worker keeps between tasks for the operator it runs. Workers serve many operators in turn, so what
    another one kept is dropped first: the memory of one operator at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that the Python objects of one part at a time are alive."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def by_bytes(batch: pa.RecordBatch, name: str, most: int = 8_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of the text column ``name`` (or one row), and ``rows`` rows at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        so_far = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, so_far + most, "right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


#: Rows of a table up to which it is broadcast, and parts in which the other side of a join is dealt beyond that.
SMALL, SALTS = 100_000, 64


def join_small(rows: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join with a table of few rows for each key, broadcast if it has ``SMALL`` rows at most.

    Otherwise it is repeated for ``SALTS`` parts of each key, by the integer column ``spread`` of ``rows``, so that no key meets in
    one task.
    """
    if small.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(small), on, how)
    salt = free_name(rows, "salt")
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [*on, salt], how).drop(salt)
