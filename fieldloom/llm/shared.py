"""What the operators share: the session's shared folder, staged tables and text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_staged: dict[str, list[str]] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own does on a
    local master, as in tests; on a cluster it is an error, as no other machine would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fieldloom-"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it goes when the driver ends, or with drop_staged()."""
    path = f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


#: The paths that the running scope of this thread has got.
_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging() -> Iterator[list[str]]:
    """A scope: the list of the paths that this thread gets meanwhile, so that an operator drops its own tables and no others.
    What is still there in the end belongs to the scope around it."""
    outer, own = _scope.get(), []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        if outer is not None:
            outer.extend(own)


def drop_staged(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Deletes staged tables: the given ones, or all of this session."""
    own = _staged.get(spark.sparkContext.applicationId, [])
    for path in list(own if paths is None else paths):
        _delete(spark, path)
        for listed in (own, _scope.get() or []):
            if path in listed:
                listed.remove(path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_staged(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


atexit.register(_at_exit)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its rows no longer depend on any executor or on a re-run of nondeterministic parts."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most, where rows are documents; Spark's own default, and its bound on a batch's bytes.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, after lowering the session's Arrow batches to BATCH_ROWS if nobody has set them: with the default an executor
    holds tens of MB of texts several times over for each task, in the JVM's buffers and in Python's. The setting is read
    when a plan runs, so it can't be put back before; a session that has one of its own keeps it (see pieces())."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession
    if spark.conf.get(key) == DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return docs


def release() -> None:
    """Gives memory that this Python worker has freed back to the system. Workers serve one operator after the other, and
    what the allocators keep for later counts against the executor all the while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, so that what is made of them for a while stays small."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


#: Rows of a staged table up to which it may be broadcast; such tables have a few short columns.
BROADCAST_ROWS = 100_000


def small_side(staged: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table as a join's side: broadcast if it has been counted to have at most so many rows, else dealt by key."""
    return F.broadcast(staged) if staged.count() <= most else staged.hint("merge")


#: Bits of a row's number for its place in a file; those above are the file's number.
PLACE_BITS = 40


def identified(docs: DataFrame, name: str, at_rest: bool) -> DataFrame:
    """docs with _row, a number that each row has for itself in every job.

    at_rest says that docs is what Parquet files hold, row by row, as a stage of the pipeline gets it: then a row's file and
    its place there number it, and nothing is copied. Otherwise, or where there are more files than may be broadcast, the
    numbers are those of a staged copy."""
    if at_rest and "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        except AnalysisException:  # it isn't read from Parquet files
            placed = None
        if placed is not None:
            # a row for each file, numbered in one task
            files = stage(placed.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file"))), f"{name}-files")
            if files.count() <= BROADCAST_ROWS:
                number = F.shiftleft(F.col("_number").cast("long"), PLACE_BITS) + F.col("_at")
                return placed.join(F.broadcast(files), "_file").select(*[F.col(f"`{c}`") for c in docs.columns], number.alias("_row"))
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")


def lookup_side(staged: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of short rows as the side in which the rows of a wide one are looked up: broadcast if counted small, else
    hashed in each task, so that the wide rows are dealt but not sorted."""
    return F.broadcast(staged) if staged.count() <= most else staged.hint("shuffle_hash")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does this for pure ASCII, by bytes; other texts take the character map."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class Bounded(dict):
    """A cache of make(key): cleared when it holds `most` entries, so its memory doesn't grow with the corpus. Keys over `longest` aren't kept."""

    def __init__(self, make: Callable, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
