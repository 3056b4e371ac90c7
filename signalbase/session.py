"""Session defaults and shipping of the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` entries win."""
    builder = SparkSession.builder.appName("signalbase")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def package_zip() -> bytes:
    """This package as an archive that Python can import from."""
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*")):
            if path.suffix in {".py", ".json", ".yaml"}:
                z.write(path, f"{root.name}/{path.relative_to(root)}")
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors once a context, through Spark's own files.

    Arrow batches, unless the session names their size, get ``BATCH_ROWS`` rows, so
    that batches of whole texts stay small in Python workers.
    """
    context = spark.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if getattr(context, "_signalbase_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="signalbase-")
    path = os.path.join(folder, "signalbase.zip")
    Path(path).write_bytes(package_zip())
    context.addPyFile(path)
    context._signalbase_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a temporary folder of its own. On a
    cluster that would scatter files over machines, so it is an error there.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(context, "_signalbase_folder", None):
        context._signalbase_folder = "file://" + tempfile.mkdtemp(prefix="signalbase-")
    return context._signalbase_folder


def checkpoint(df):
    """Cut a frame's lineage with a reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_signalbase_checkpoints", False):
        context.setCheckpointDir(shared_folder(df.sparkSession))
        context._signalbase_checkpoints = True
    return df.checkpoint()
