"""Session construction, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Settings of a local or test session. On a cluster the submitter's settings hold.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", *, app: str = "tidemark", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir. Only a local session may do without one: it gets a temporary
    folder that is removed when the process ends. On a cluster a folder of one machine would not be seen by the others, so that raises."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder, for tables that outlive one job."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared checkpoint folder: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(*steps: Callable[[], T]) -> list[T]:
    """What independent steps give, each of which starts jobs of its own: small jobs that don't fill the cluster share it."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


#: Bytes of a side that is broadcast: what its columns' texts and numbers take, counted before the join.
MAX_BROADCAST_BYTES = 256 << 20


def broadcast_within(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` in all, else as it is, so that the join shuffles.

    The count stops at ``max_rows`` + 1 rows; bytes are counted where a column has no fixed width. Give a table that is cheap to
    read: a file, or the result of :func:`cut`.
    """
    some = df.limit(max_rows + 1)
    width = sum(f.dataType.typeName() not in _WIDE for f in df.schema) * 8
    wide = [F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0)).cast("bigint") for f in df.schema if f.dataType.typeName() in _WIDE]
    bytes_ = F.sum(sum(wide, F.lit(width).cast("bigint"))) if wide else F.count(F.lit(1)) * width
    n, size = some.agg(F.count(F.lit(1)), bytes_).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


_WIDE = ("string", "binary", "array", "map", "struct", "variant")
