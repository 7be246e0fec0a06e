"""What the operators share: the shared folder, staged tables and Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls \t \n \v \f \r.
#: ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a temporary
    folder that is remembered in the session, on one machine alone: a cluster must name one."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not (spark.sparkContext.master or "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="forgelens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/forgelens-{uuid.uuid4().hex}/{name}"


#: Row groups of staged tables: a task that writes holds one of them.
ROW_GROUP = 16 << 20


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again. This cuts the
    lineage: what is lost with an executor is read again, not computed again."""
    path = staged_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame, parts: list[str] | None = None) -> None:
    """Deletes a staged table that nothing reads any more, or some of its partitions."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {f.split("/part-")[0].split("/kind=")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in parts or [""]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{part}".rstrip("/")), True)
    gc.collect()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns, as ``wanted`` or longer, that differ from all columns of
    ``df`` whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of just this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of ``df`` whose names are none of ``replaced``, whatever the case."""
    gone = {name.lower() for name in replaced}
    return [named(c) for c in df.columns if c.lower() not in gone]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; else the optimizer may copy it to each use,
    also into lambdas, where it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def per_slice(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``rows`` rows and, but for a single longer row, ``size``
    bytes of strings: bounds what a worker holds at once. Cutting loses no row."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(weight)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task: one thing at a time, so that the caches of one
    stage go when another stage's begin."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


class WordHashes(dict):
    """word -> unsigned 64-bit hash, kept up to a bounded number of bytes."""

    #: What an entry takes beside its word's own bytes.
    ENTRY = 170

    def __init__(self, limit: int = 64 << 20):
        super().__init__()
        self.limit, self.used = limit, 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.used >= self.limit:
            self.clear()
            self.used = 0
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        self.used += len(word) + self.ENTRY
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes() -> WordHashes:
    """One for all tasks of a worker."""
    return kept(("words",), WordHashes)
