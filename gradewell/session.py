"""Session construction and shared-folder helpers.

Library functions never create a session themselves; they take DataFrames.
This module is used by tests, the bench and the entry points.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "gradewell") -> SparkSession:
    master = master or os.environ.get("GRADEWELL_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("GRADEWELL_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRADEWELL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets this to a shared file system. Only when it
    is unset (local tests) do we create a private folder under the temp dir.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="gradewell-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a stage table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gradewell`` importable in Python workers (once per SparkContext).

    Functions run by ``mapInPandas`` / pandas UDFs are pickled by module
    reference, so executors need the package. When it is loaded from a source
    checkout (not an installed distribution) it is zipped and added with
    ``addPyFile``, which uploads it to every executor. The zip goes to the
    shared checkpoint folder when that is a local path, else to a driver temp
    file that only serves the upload.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    if "site-packages" in pkg_dir:
        _SHIPPED.add(key)
        return
    ckpt = spark.conf.get("spark.checkpoint.dir", None)
    base = ckpt[len("file:"):] if ckpt and ckpt.startswith("file:") else ckpt
    if not base or "://" in base or not os.path.isdir(base):
        base = tempfile.mkdtemp(prefix="gradewell-pkg-")
    path = os.path.join(base, f"gradewell-{uuid.uuid4().hex[:8]}.zip")
    root = os.path.dirname(pkg_dir)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, names in os.walk(pkg_dir):
            if "__pycache__" in folder:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
