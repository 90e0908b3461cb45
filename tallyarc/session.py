"""Sessions: defaults for one machine, and the package itself sent to executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_zip: str | None = None
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallyarc")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: functions in DataFrames are pickled by reference."""
    global _zip
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if _zip is None:
        top = os.path.dirname(os.path.abspath(__file__))
        _zip = os.path.join(tempfile.mkdtemp(prefix="tallyarc-"), "tallyarc.zip")
        with zipfile.ZipFile(_zip, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(_zip)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; whole texts are large rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table: in the shared folder that the session names, else, where Spark is this process, in
    a folder of it."""
    import uuid

    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or tempfile.mkdtemp(prefix="tallyarc-")
        root = f"file://{_own}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """What a query has written is read until the driver's process ends; then it goes."""
    with contextlib.suppress(Exception):  # the engine may be gone already
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_own: str | None = None
