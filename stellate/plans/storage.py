"""Where iterative operators cut their lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between the JVM and Python, where the session has Spark's default of 64 MB: texts are long, and both sides hold batches.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver has it, also if the driver was started without PYTHONPATH.

    The session's limit on the bytes of an Arrow batch is lowered if it is Spark's default; all else stays as the user set it."""
    if (spark.conf.get(BATCH_KEY, None) or "").rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local mode gets a new folder that is then kept in the session.

    On a cluster it must be set: executors don't see each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that no plan will read any more; frames of other origin and None are passed over."""
    for t in tables:
        if t is not None and (path := t.__dict__.get("written_to")):
            spark = t.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
