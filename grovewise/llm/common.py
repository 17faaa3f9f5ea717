"""What several operators share: words, shared scratch tables, and broadcasts behind a size check."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, in spark.checkpoint.dir or as its checkpoint folder.

    Where none is named, a local session gets a temporary one; on a cluster that is an error, as executors don't share the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="grovewise-")


def fresh(taken: DataFrame | list[str], *names: str) -> list[str]:
    """Column names like those wanted, but unlike any that is there in any case."""
    there = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def name_of(column: str) -> str:
    """A column's name for SQL text and for select, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


#: Frequent keys that are broadcast at most.
BROADCAST_KEYS = 1_000_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="grovewise-ship-")) / "grovewise.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Gives a worker's free memory back, as workers live on for the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (c := _libc()) and hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, which gives its memory back when its rows are done."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return outer


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Arrow batches through a Python function, where no built-in expresses the work."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


@contextlib.contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Cuts the plans' texts while many steps run: the driver keeps the text of each of the last thousand queries."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps of a loop have left: broadcasts, shuffles and plans are cleaned up only when its garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Gives the free memory outside the driver's heap back: its hundreds of threads leave it in pieces, which does not shrink by itself.

    The JVM has a command for that from JDK 17.0.9 on; an older one keeps the memory."""
    context = spark.sparkContext
    java, array = context._jvm.java, context._gateway.new_array
    server = java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = array(java.lang.Object, 4)
    call[0], call[1] = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call[2], call[3] = array(java.lang.Object, 0), array(java.lang.String, 0)
    with contextlib.suppress(Py4JError):
        invoke.invoke(server, call)


def crowded(spark: SparkSession) -> bool:
    """Whether the driver's heap has grown beyond half of what it may take: most of that is what finished queries have left, and it does not shrink by itself."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return 2 * heap.totalMemory() > heap.maxMemory()


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, readable by every executor, without lineage.

    Operators store dozens of tables one after the other, so the plan's text is cut, and the driver gives back what the queries before have left: outside its heap each time, in it as soon as it has grown.

    narrow: no more files than the cluster has cores, for tables of a few numbers per row that a shuffle has
    spread over many partitions; each file costs its writer a process or more."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with short_plans(df.sparkSession):
        (df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)) if narrow else df).write.parquet(path)
    if crowded(df.sparkSession):
        release(df.sparkSession)
    else:
        trim_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def steady(df: DataFrame, name: str) -> DataFrame:
    """The same rows, dealt to partitions alike whenever they are read: files and local rows are, what comes out of a shuffle is stored."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, name) if "Exchange" in plan or "Sample" in plan or "Limit" in plan else df


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing to come reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; beyond it, the join stays a shuffled one."""
    return F.broadcast(df) if rows <= most else df


def join_on_hot(rows: DataFrame, sizes: DataFrame, key: str, size: str, hot: int) -> DataFrame:
    """The inner join of rows with a table of one row per key that carries `size`, the key's number of rows, without all rows of a frequent key in one task.

    Keys of `hot` rows or more are at most (rows / hot); they are broadcast where their count is within bounds, and the others meet in a shuffle."""
    often = sizes.where(F.col(size) >= hot)
    n = often.count()
    if n == 0 or n > BROADCAST_KEYS:
        return rows.join(sizes, key)
    few = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(sizes.where(F.col(size) < hot), key)
    return rows.join(F.broadcast(often), key).unionByName(few)


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def byte_words(text: str | None) -> list[bytes]:
    """The same words in Python, as UTF-8: bytes.split() splits at exactly the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def one_of(df: DataFrame, *need: str) -> None:
    """Fails early and plainly where a needed column is missing or ambiguous."""
    for c in need:
        if df.columns.count(c) != 1:
            raise ValueError(f"exactly one column {c} is needed, there are {df.columns.count(c)}")
