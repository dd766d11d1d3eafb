"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; any other session is refused, since
    executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="run-"))
        base = _LOCAL[0]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: as a zip file in the shared folder, unless PYTHONPATH names its place."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    context = spark.sparkContext
    if getattr(context, "_shipped_packages", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, files in sorted(os.walk(package)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    uri = shared_folder(spark, "code")
    fs, path = file_system(uri)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/{name}.zip", compression=None) as out:
        out.write(raw.getvalue())
    context.addPyFile(f"{uri}/{name}.zip")
    context._shipped_packages = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    schema = df.schema
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds ``uri`` and the path inside it; works in tasks and on the driver."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)
