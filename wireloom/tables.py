"""Tables that jobs write for themselves."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MARKED: set[str] = set()
_TABLES: list[DataFrame | None] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (one machine, as in tests) gets a
    temporary folder; a cluster is refused, as its executors wouldn't see each
    other's files.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="wireloom-")
    return _LOCAL[app]


def _file_system(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and every reader sees the same rows.

    All tables of an application are deleted when its driver ends; ``forgotten`` deletes one before.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/wireloom/{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        _MARKED.add(folder)
        path, system = _file_system(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    _TABLES.append(out)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that grows with the input: never broadcast.

    Spark goes by the size of a file, and packed coordinates and names take a
    hundred times that in the driver's memory; behind an explode it is off once more.
    """
    return df.hint("merge")


def tables_since(mark: int) -> list[DataFrame]:
    """The tables that are there and were written after so many others."""
    return [t for t in _TABLES[mark:] if t is not None]


def table_count() -> int:
    return len(_TABLES)


def forgotten(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        path, system = _file_system(table.sparkSession, table.written_at)
        system.delete(path, True)
        for i, other in enumerate(_TABLES):
            if other is table:
                _TABLES[i] = None


def let_go(spark: SparkSession) -> None:
    """Has the shuffle files of finished queries dropped now, and not when the driver next happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
