"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="quillstack-")
    return _own_roots[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor never loses them.

    ``keep`` writes a frame as Parquet and reads it back, ``drop`` removes one that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.base}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        # Parquet files may hold no nulls although the column allows them: read with the frame's own types.
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        table = self.spark.read.schema(schema).parquet(path)
        self._paths[id(table)] = path
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under a name that shows it whole or not at all."""
    jvm = spark._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not files.rename(draft, target):
        files.delete(draft, False)
        raise OSError(f"{path} cannot be put in place")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []
