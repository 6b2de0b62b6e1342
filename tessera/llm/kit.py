"""Shared pieces of the corpus operators: shared-folder tables, Arrow batches as bytes, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.shipping import ship

#: Odd 64-bit constants of the mixing functions (fixed values of the public splitmix64 generator).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder and any
    other one gets a folder below the warehouse, which is shared as well.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        return _own[context.applicationId]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"


#: Folder that tables are made in while ``scratch`` is open.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


class Tables:
    """Intermediate tables in the shared folder; they cut lineage, so a lost executor costs one stage at most.

    They go when the driver ends, if nothing drops them before.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root, self.made = spark, f"{_scratch.get() or shared_dir(spark)}/tessera-{uuid.uuid4().hex}", False

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.made:
            files, root = _files(self.spark, self.root)
            self.made = files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no pending DataFrame reads any more."""
        for name in names:
            files, path = _files(self.spark, f"{self.root}/{name}")
            files.delete(path, True)


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def scratch(spark: SparkSession):
    """Tables made within are dropped at the end: write what is still needed of them before."""
    root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    token = _scratch.set(root)
    try:
        yield
    finally:
        _scratch.reset(token)
        files, path = _files(spark, root)
        files.delete(path, True)


def fresh(df: DataFrame, *stems: str) -> str | list[str]:
    """A column name for each stem that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = next(n for n in (f"_{stem}{i or ''}" for i in count()) if n.lower() not in taken)
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value of a string column, without going through str."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    absent = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if absent and absent[i] else whole[ends[i] : ends[i + 1]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n consecutive words; with fewer words, one for the whole sequence."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    out = np.full(size, np.uint64(n), np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + size] + GOLDEN)
    return out


def arrow(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def groups(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict[str, list]]]]:
    """Rows of a stream that is sorted by ``keys``, as (key values, [column name -> array of one slice, ...]).

    A group may run over many batches; its slices are given as a lazy iterator, so that only one is held.
    """
    rows = _slices(batches, keys)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own(key=key):
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                part, ahead = ahead[1], None
                yield part
                ahead = next(rows, None)

        it = own()
        yield key, it
        for _ in it:  # what the caller left
            pass


def _slices(batches, keys):
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        values = list(zip(*columns))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                yield values[start], batch.slice(start, i - start)
                start = i
