"""Sessions, table access and lineage cuts.

Nothing here keeps state on a machine's own disk when a cluster names a shared
folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "siftmark", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    for k, v in (LOCAL_CONF | {"spark.sql.shuffle.partitions": str(cpus)} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that executors need no installation.

    The driver serves one small archive; nothing is read from its disk by anyone else.
    """
    context = spark.sparkContext
    if getattr(context, "_siftmark_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():
        folder = tempfile.mkdtemp(prefix="siftmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / "siftmark-package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"siftmark/{f.relative_to(home)}")
        context.addPyFile(str(archive))
    context._siftmark_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A local session without the setting gets a folder of its own, removed at its end;
    on a cluster its absence is an error, since no machine's own folder would do.
    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` where a session lives long:
    Spark then removes what no result needs any more.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    current = spark.sparkContext.getCheckpointDir() or ""
    if named or current:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return current or named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"siftmark-checkpoints-{os.getpid()}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    For results that several branches read: they are computed once, every branch
    sees the same rows, and a lost executor costs a re-read rather than a re-run.
    """
    ship(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_folder(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A folder of its own within the shared checkpoint folder, removed afterwards."""
    root = f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    try:
        yield root
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table. ``timestamp_ntz`` columns become UTC timestamps, so that watermarks accept them."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
