"""What the training-data operators share: tables, the shared folder, batching."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD_SEPARATORS = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset (tests on one machine) a temporary
    folder is made and set for the session.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own below the shared one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_dir(spark)
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder: computed once, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Lets the files of shuffles and checkpoints go that nothing refers to any more.

    Spark removes them only when the driver's JVM collects its garbage; until then the files of
    every step lie on the disks together. Queries that Spark has not yet told of as over refer to theirs.
    """
    gc.collect()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JJavaError:  # busy for longer
        pass
    spark.sparkContext._jvm.System.gc()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of queries made within, the files of shuffles go when a query is over, whatever still refers to it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """checkpointed(), and the shuffles that it took are gone: for steps that move much."""
    out = checkpointed(df)
    del df
    release(out.sparkSession)
    return out


#: Records of an Arrow batch on its way to Python, at most: long texts come in bounded pieces.
BATCH_ROWS = 1_000
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES, where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, clear: Callable[[], None]) -> None:
    """Names what empties the caches that an operator keeps in a Python worker."""
    _held[owner] = clear


def _clear_others(owner: str) -> None:
    for name, clear in _held.items():
        if name != owner:
            clear()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its pages
        pass


def tidied(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
    """run for mapInArrow, in a worker that is used again: caches of other operators go first, free pages last."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # both by reference: what is pickled by value would be a copy of the driver's caches
        _clear_others(owner)
        yield from run(batches)
        _trim()

    return tidy


def free(columns: Iterable[str], name: str) -> str:
    """A column name that none of columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, for use inside array expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from every fit: crc32 of its id as text divides by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
