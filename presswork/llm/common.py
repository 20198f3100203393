"""What the operators of this subpackage share: the cluster's shared folder and table loading."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_owned: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only in local mode (tests, one machine) a temporary folder stands in for an absent setting; on a
    cluster that is an error, because each machine would write to a disk of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="presswork-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _owned:
        try:
            _remove(spark, path)
        except (Py4JError, AttributeError, OSError):  # the session has ended already; its scratch folder goes with the cluster
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends (or by ``discard``)."""
    path = f"{shared_dir(spark)}/presswork/{name}-{uuid.uuid4().hex}"
    if not _owned:
        atexit.register(_remove_all)
    _owned.append((spark, path))
    return path


_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = _path_of.pop(df)
        _remove(df.sparkSession, path)
        _owned[:] = [x for x in _owned if x[1] != path]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


_STEP = 256


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has gathered from ``first`` on before each element, and in the end. ``step`` is associative and
    ``first`` its neutral element. Two levels, so that long arrays cost little more than their length."""
    n = F.size(values)
    prefix = lambda a, start: F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _STEP)), lambda c: F.slice(values, (c * _STEP + 1).cast("int"), F.lit(_STEP)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, first, lambda a, x: step(a, x)))
    firsts = prefix(totals, first)
    parts = F.transform(F.zip_with(chunks, F.slice(firsts, 1, F.size(chunks)), lambda c, f: F.struct(c.alias("c"), f.alias("f"))), lambda s: F.slice(prefix(s["c"], s["f"]), 1, F.size(s["c"])))
    return F.when(n > 0, F.concat(F.flatten(parts), F.slice(firsts, -1, 1))).otherwise(F.array(first))


def running_sums(sizes: Column) -> Column:
    """The sums of all elements (long) before each one, and of all."""
    return running(sizes, F.lit(0).cast("long"), lambda a, x: a + x)


#: Texts are handed to Python code in slices of so many rows, whatever the session's Arrow batches hold.
BATCH_ROWS = 1_000

#: What operators keep in a worker from one task to the next: module -> function that drops it.
kept: dict[str, Callable[[], None]] = {}


def let_go(user: str) -> None:
    """Drops what other operators than ``user`` kept in this worker and gives freed memory back."""
    for name, drop in kept.items():
        if name != user:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, user: str) -> DataFrame:
    """``df.mapInArrow(run, schema)``; ``run`` gets slices of at most ``BATCH_ROWS`` rows.

    Workers outlive tasks and stages, so each task frees what others left, before and after its work.
    The session's settings stay as they are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(user)
        yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        let_go(user)

    return df.mapInArrow(task, schema)
