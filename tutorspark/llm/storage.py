"""Tables kept between jobs, in the folder that the cluster shares, and columns by any name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a single machine without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tutorspark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tutorspark-{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table once and read it back, so that a lost executor costs a file read and no rerun."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete this application's kept tables, when no frame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exactly(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and back-ticks included."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def numbered(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """Some columns as c0, c1, ..., for kernels, which Spark gives no columns with dots in their names; and the new
    names by the old ones."""
    plain = {name: f"c{n}" for n, name in enumerate(dict.fromkeys(names))}
    return docs.select(*exactly(plain)).toDF(*plain.values()), plain


def neutral(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0, c1, ..., which no name of an operator's own can meet, and the new names of some."""
    names = [f"c{n}" for n in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in wanted]
