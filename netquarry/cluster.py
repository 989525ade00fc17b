"""Makes the package importable on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="nq-"), "netquarry_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"netquarry/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "netquarry-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nq-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nq_path = path
    return out


def replaced(df: DataFrame, step: Callable[[DataFrame], DataFrame], parts: int = 4) -> list[DataFrame]:
    """``cut`` of ``step`` for each of some parts of a table made by ``cut``; a part's files are deleted once its result is written,
    so that the two tables are never both whole on the disk."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    system = path(df._nq_path).getFileSystem(context._jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in system.listStatus(path(df._nq_path)) if f.getPath().getName().startswith("part-"))
    out = []
    for k in range(max(1, min(parts, len(files)))):
        own = files[k::parts]
        out.append(cut(step(spark.read.schema(df.schema).parquet(*own) if own else df)))
        for f in own:
            system.delete(path(f), False)
    discard(df)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_nq_path", None)
        if path is not None:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
