"""Small helpers for columns and storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = Path(__file__).resolve().parents[2]


#: What a task reads or hands to Python at a time, at most: bytes of an Arrow batch, rows of a Parquet batch (arrays of tokens
#: take 12 bytes a token there), bytes of a row group that is written. Spark's own bounds are in rows, whatever their size.
BATCH_BYTES, SCAN_ROWS, GROUP_BYTES = 8 << 20, 256, 32 << 20


def bounded(spark: SparkSession) -> None:
    """The session's batches are bounded by bytes; bounds that are lower already stay."""
    number = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        if not 0 < number(spark.conf.get(name)) <= most:
            spark.conf.set(name, most)


def ship(spark: SparkSession) -> None:
    """Bound the session's batches, and hand this package to Python workers that don't see the driver's ``sys.path``; the
    latter once for a session."""
    bounded(spark)
    sc = spark.sparkContext
    seen = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} | {str(Path.cwd())}
    if str(_ROOT) in seen or getattr(sc, "_lodestone_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (_ROOT / "lodestone").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(target)
    sc._lodestone_shipped = True


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset in local mode (tests), a folder of
    this machine; on a cluster it must be set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables of ``stored`` that the innermost ``scratch`` deletes.
_HELD: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``stored`` makes inside are deleted at the end: for work whose result is written elsewhere by then."""
    held: list[DataFrame] = []
    outer = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(outer)
        forget(*held)


def written(df: DataFrame, path: str) -> None:
    """``df`` as Parquet, in row groups of which a task can hold several."""
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage is cut in a way that survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    if (held := _HELD.get()) is not None:
        held.append(out)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestone_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
