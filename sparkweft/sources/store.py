"""Tables and indexes in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one where it is unset and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: what follows does not depend on what made it."""
    return stored_at(df, scratch(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``stored_at``."""
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing to come reads."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm, True)


def _leaves(df: DataFrame) -> list:
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def roots(*sources: DataFrame) -> list[str]:
    """The folders and files that some frames read, as they were named to the reader."""
    out = set()
    for df in sources:
        for leaf in _leaves(df):
            if leaf.getClass().getSimpleName().startswith("LogicalRelation") and hasattr(leaf.relation(), "location"):
                paths = leaf.relation().location().rootPaths()
                out |= {paths.apply(i).toString() for i in range(paths.size())}
    return sorted(out)


def fingerprint(*sources: DataFrame) -> str:
    """The state of the files behind some frames: another value means another state.

    Names, lengths and modification times of all files as their store tells
    them. Spark lists them and adds up their hashes in tasks that open none of
    them; one row comes back.
    """
    paths = roots(*sources)
    if not paths:
        return hashlib.md5(b"").hexdigest()
    files = sources[0].sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    h = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    told = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum(h).alias("h")).first()
    return hashlib.md5(repr((told.n, told.bytes, str(told.h))).encode()).hexdigest()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as tasks run at once, where its files make fewer: work on long texts then does not wait for one task."""
    wide = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wide) if df._jdf.queryExecution().toRdd().getNumPartitions() < wide else df


#: Another number when what is written below a store's path changes its form.
FORM = 2

_open: dict[tuple[str, str], object] = {}


def kept(spark: SparkSession, name: str, sources: list[DataFrame], make: Callable[[str], object], load: Callable[[str], object] | None = None):
    """What ``load`` reads of what ``make`` wrote below the path it is handed; a table, where nothing else is said.

    It is made once for each state of the sources' files and stays in the
    shared folder, where later sessions find it. Each state has a path of its
    own, whole once it has its name: it is written under another one and
    renamed. States before the last two are deleted when a new one is made.
    """
    state = fingerprint(*sources)
    about = hashlib.md5(repr(roots(*sources)).encode()).hexdigest()[:12]
    folder = f"{shared_folder(spark)}/stores/{name}-{FORM}-{about}"
    path = f"{folder}/{state}"
    key = (spark.sparkContext.applicationId, path)
    there = exists(spark, path)
    if not there:
        under = scratch(spark, f"making-{name}")
        make(under)
        _fs(spark, folder).mkdirs(_path(spark, folder))
        if not _fs(spark, path).rename(_path(spark, under), _path(spark, path)) or not exists(spark, path):
            raise OSError(f"{under} could not become {path}")
        _forget(spark, folder, state)
    if not there or key not in _open:
        _open[key] = load(path) if load else read_stored(spark, path)
    return _open[key]


def _forget(spark: SparkSession, folder: str, state: str) -> None:
    """Delete a store's states but the one just made and the newest before it."""
    fs = _fs(spark, folder)
    old = sorted((s for s in fs.listStatus(_path(spark, folder)) if s.getPath().getName() != state), key=lambda s: s.getModificationTime())
    for s in old[:-1]:
        fs.delete(s.getPath(), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
