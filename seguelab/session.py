"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIR: list[str] = []
#: Folders of the tables that :func:`materialize` wrote and that are still there.
_TABLES: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and the master is local (tests).

    A cluster without that setting is an error: a folder of the driver's machine would be another one on each executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="seguelab-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def _delete(spark: SparkSession, path: str) -> None:
    _TABLES.discard(path)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session or its gateway has already ended
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table goes with :func:`drop_table`, or when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _TABLES.add(path)
    atexit.register(_delete, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the tables that ``df`` reads and :func:`materialize` made, once nothing reads them any more; others' files stay."""
    plain = lambda path: path.split(":", 1)[-1].lstrip("/") if path.startswith("file:") else path
    read = {plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    for path in [p for p in _TABLES if plain(p) in read]:
        _delete(df.sparkSession, path)


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    Column expressions don't record the Python calls that made them: in wide plans
    that takes longer than all else.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
