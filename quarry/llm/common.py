"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder; on a cluster, executors
    wouldn't share it, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is still there when the application ends is deleted then."""
    made = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    path, files = _file_system(spark, made)
    files.deleteOnExit(path)
    return made


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


#: Session settings that hold while tables are written. Shuffle files go once a query has run, as a written table needs
#: them no more; fewer rows than Spark's 10,000 go to Python at once, as texts may be long: both sides hold a batch or two in memory.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
_writers: dict[str, tuple[int, dict[str, str]]] = {}
_lock = threading.Lock()


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Holds _SETTINGS while at least one table is being written, and puts back what the session had before the first."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        users, before = _writers.get(key) or (0, {k: spark.conf.get(k, None) for k in _SETTINGS})
        _writers[key] = users + 1, before
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            users, before = _writers[key]
            _writers[key] = users - 1, before
            if users == 1:
                del _writers[key]
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors, leaves no shuffle files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path from scratch."""
    found, files = _file_system(spark, path)
    files.delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def give_back() -> None:
    """Gives the system back the memory that this process holds but doesn't use: workers are kept between tasks, beside the JVM's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives back unused memory once a task has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def map_rows(df: DataFrame, columns: Sequence[str | Column], schema: str, start: Callable[[], Callable[..., dict]], rows: int = 512) -> DataFrame:
    """Maps df's columns by Arrow batches of at most so many rows.

    start runs once a task and returns a function from column lists to a dict of output lists.
    """
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(giving_back(run), out)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an integer column as text, modulo n; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit(column: str, salt: str) -> Column:
    """A hash-random number in [0, 1) for each value of a column."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(f":{salt}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
