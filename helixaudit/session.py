"""Session facts every multi-stage operator needs: where durable intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session (as in the tests) may leave that setting out: a temporary folder of
    this machine is taken then and registered as the session's checkpoint folder. On a cluster each executor would
    write to a disk of its own, so the setting's absence is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
    known = getattr(context, "_helixaudit_shared", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="helixaudit-")
        context._helixaudit_shared = known
        context.setCheckpointDir(known)
    return known


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder as parquet and reading it back.

    The files survive the loss of any executor, unlike a local checkpoint, and the reader gets
    column pruning and filters, unlike an RDD checkpoint. They stay until :func:`forget` or the end of the program, as
    results that are not read yet need them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_forget_all)
    _WRITTEN.append((spark.sparkContext, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Intermediate tables of this program, with the context that wrote them.
_WRITTEN: list = []


def marked(spark: SparkSession) -> int:
    """A mark for :func:`forget`: tables written from now on."""
    return len(_WRITTEN)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables written since a mark. Results that were not read yet can't be read any more."""
    context = spark.sparkContext
    paths = [path for owner, path in _WRITTEN[since:] if owner is context]
    _WRITTEN[since:] = [x for x in _WRITTEN[since:] if x[0] is not context]
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _forget_all() -> None:
    for context in {id(owner): owner for owner, _ in _WRITTEN}.values():
        # The session may be gone; its folder is then the cluster's to clean.
        with contextlib.suppress(Exception):
            forget(SparkSession(context))


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The rows on at least as many partitions as the session has cores.

    For stages whose work is far larger than their bytes: a small input of one file would run on one core.
    Inputs of enough partitions, as all large ones are, come back unchanged and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that executors need no install."""
    context = spark.sparkContext
    if getattr(context, "_helixaudit_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="helixaudit-code-")) / "helixaudit.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in {".py", ".html", ".css", ".js", ".json"}:
                out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._helixaudit_shipped = True
