"""Session helpers: building a local session, finding tables, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter makes the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, which all executors share.

    It is spark.checkpoint.dir where the cluster names one, else the folder that the context was
    given. Only where both are unset and the session is local, as in tests, a folder of this machine
    is used; elsewhere that is an error, since executors don't share one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"siltstone-{os.getuid()}")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_table(spark: SparkSession, name: str) -> str:
    """The path of a table in the shared folder, which is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    """(path, file system) of Hadoop."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(sc._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if there is one already. Of several callers one succeeds."""
    place, fs = _place(spark, path)
    try:
        fs.create(place, False).close()
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    return True


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever it lies on the driver."""
    sc = spark.sparkContext
    done = getattr(sc, "_siltstone_shipped", False)
    if done:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltstone-ship-")  # the driver's; executors get the file from Spark
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "siltstone_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".txt", ".yaml") and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._siltstone_shipped = True
