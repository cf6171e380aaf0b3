"""Tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it again, so a lost executor never
loses the only copy.  The folder is what the cluster names in
``spark.checkpoint.dir``; only where that is unset and driver and executors are one
process (tests, one machine) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most ids that a broadcast may hold: 16 MB of longs.
MAX_BROADCAST_IDS = 1_000_000
#: Bytes that an Arrow batch may hold, but for its last row.
BATCH_BYTES = 16 << 20


#: Folders of our own making, and tables written and not yet removed, by application.
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, set[str]] = {}


def one_process(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    return re.fullmatch(r"local(\[[^\[\]]*\])?", master) is not None


def configured_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session; a local one if none is set and nothing runs elsewhere."""
    found = configured_dir(spark)
    if not found:
        if not one_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="kinfold-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = "file://" + _OWN[app]
    return found.rstrip("/")


def _remember(spark: SparkSession, path: str) -> None:
    """Results are read from tables after a query has returned, so what no query removes goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = set()
        atexit.register(drop_rest, spark)
    _WRITTEN[app].add(path)


def drop_rest(spark: SparkSession) -> None:
    """Remove all tables of this application that are still in the shared folder, if its context is alive."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        drop_shared(spark, *_WRITTEN.get(sc.applicationId, ()))


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once; return it as read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{uuid.uuid4().hex[:12]}-{name}"
    _remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    """``write_shared`` with the number of rows, counted while they are written."""
    seen = Observation()
    out, path = write_shared(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, path, seen.get["n"]


def shared(df: DataFrame, name: str) -> DataFrame:
    return write_shared(df, name)[0]


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    paths = tuple(paths)
    jvm = spark.sparkContext._jvm
    written = _WRITTEN.get(spark.sparkContext.applicationId, set())
    for path in paths:
        written.discard(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers import this package, and bound an Arrow batch's rows and bytes, as one text can be very long."""
    env = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parent.parent)
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), here)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run):
    """A function of batches that gives freed memory back before and after.

    Python workers are used again by later stages; what one stage leaves in the
    allocator would count against the next.
    """

    def outer(batches):
        give_back(young=True)
        yield from run(batches)
        give_back(young=True)

    return outer


def give_back(young: bool = False) -> None:
    """Return freed memory to the system; ``young``: without a look at all objects, which takes tens of milliseconds."""
    gc.collect(1 if young else 2)
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def bounded(ids: DataFrame, rows: int, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """A table marked for broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if rows <= most else ids


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on one id; ``ids`` is written and counted first and broadcast only if small, else both sides shuffle."""
    ids, _, rows = write_counted(ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct(), "ids")
    return df.join(bounded(ids, rows), key, how)
